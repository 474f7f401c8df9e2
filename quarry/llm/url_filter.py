"""URL verdicts from rules and a path-template tree (DataFrame functions only).

Method. A rule is (verdict, host, path); the longest that fits a url decides.
Urls that no rule fits are judged by a tree of path templates per host:

1. Lexical step: runs of digits and long hexadecimal names become ``*``. Urls
   are aggregated to one row per host and lexical template before anything is
   joined, so a hot host is a few rows.
2. Variable segments: from the root down, a position with more than
   ``MAX_KIDS`` different segments under one parent turns each segment that
   holds less than 1 / ``MAX_KIDS`` of the parent's urls into ``*``.
3. Labels are the verdicts of the rules. Branches of one parent whose block
   rate isn't told apart from the parent's by a two-proportion z test pool
   their counts; a branch without labels pools with none.
4. The block rate of a branch is smoothed towards that of the same template
   over all hosts, this towards that of the template's parent over all hosts,
   and this towards the overall rate. A template with a rate of
   at least ``REJECT`` is blocked.

Cases: a null url, or one without ``://``, has empty host and path and gets the
verdict of the empty template, which no label reaches but through the overall
rate. Segments beyond ``MAX_DEPTH`` count as one. Repeated rows count each and
get equal verdicts. Without any label the overall rate is 1/2 and urls are
blocked only if ``REJECT`` is at most that. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

Rule = tuple[str, str, str]
#: fixed values: the rules of the contract
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
MAX_DEPTH = 6
MAX_KIDS = 20
Z_SAME = 1.96
WEIGHT = 4.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NAMES = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}|[0-9]+"


def host_of(url) -> F.Column:
    """After the first ``://`` up to the path, A-Z lower-cased; null: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def parsed(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("page_id"),
                     host_of(url).alias("host"),
                     F.regexp_extract(url, PARTS, 2).alias("path"))


def with_rule(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``rule`` and ``ruled``: the longest fitting rule and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host))
                & F.col("path").startswith(path))
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def templates(counted: DataFrame, max_depth: int = MAX_DEPTH, max_kids: int = MAX_KIDS) -> DataFrame:
    """From ``host, lexical, n, blocked, labelled`` to the same rows with
    ``template`` and its ``parent``."""
    parts = F.split(F.col("lexical"), "/")
    deep = F.size(parts) > max_depth + 1
    segs = F.when(deep, F.concat(F.slice(parts, 2, max_depth - 1), F.array(F.lit("**")))).otherwise(
        F.slice(parts, 2, max_depth))
    tree = written(counted.withColumn("segs", segs).withColumn("template", F.lit(""))
                   .withColumn("parent", F.lit("")), "url-tree")
    depth = tree.agg(F.max(F.size("segs"))).first()[0] or 0
    for k in range(depth):
        here = tree.where(F.size("segs") > k).select("host", "template", F.col("segs")[k].alias("seg"), "n")
        kids = here.groupBy("host", "template", "seg").agg(F.sum("n").alias("kid_n"))
        places = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kid_count"),
                                                      F.sum("kid_n").alias("all_n"))
        rare = (kids.join(places.where(F.col("kid_count") > max_kids), ["host", "template"])
                .where(F.col("kid_n") * max_kids < F.col("all_n"))
                .select("host", "template", "seg", F.lit(True).alias("rare")))
        at = F.get(F.col("segs"), F.lit(k))
        step = F.when(F.col("rare"), "*").otherwise(at)
        tree = written(
            tree.withColumn("seg", at).join(rare, ["host", "template", "seg"], "left")
            .withColumn("parent", F.when(at.isNull(), F.col("parent")).otherwise(F.col("template")))
            .withColumn("template", F.when(at.isNull(), F.col("template"))
                        .otherwise(F.concat_ws("/", "template", step)))
            .drop("seg", "rare"), "url-tree")
    return tree.drop("segs")


def block_rates(tree: DataFrame, z_same: float = Z_SAME, weight: float = WEIGHT) -> DataFrame:
    """Smoothed block rate of every host and template."""
    both = [F.sum("blocked").alias("b"), F.sum("labelled").alias("l")]
    leaf = tree.groupBy("host", "parent", "template").agg(*both)
    total = leaf.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    overall = (total["b"] + 1) / (total["l"] + 2)
    branch = leaf.groupBy("parent").agg(*[F.sum(c).alias(f"s_{c}") for c in "bl"]).select(
        "parent", ((F.col("s_b") + weight * overall) / (F.col("s_l") + weight)).alias("branch"))
    shared = (leaf.groupBy("parent", "template").agg(F.sum("b").alias("t_b"), F.sum("l").alias("t_l"))
              .join(branch, "parent")
              .select("parent", "template", ((F.col("t_b") + weight * F.col("branch"))
                                             / (F.col("t_l") + weight)).alias("prior")))
    above = leaf.groupBy("host", "parent").agg(F.sum("b").alias("p_b"), F.sum("l").alias("p_l"))
    p = F.col("p_b") / F.greatest(F.col("p_l"), F.lit(1))
    spread = F.sqrt(p * (1 - p) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(F.col("p_l"), F.lit(1))))
    far = F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - p)
    marked = (leaf.join(above, ["host", "parent"])
              .withColumn("same", (F.col("l") > 0) & (far <= z_same * spread)))
    pools = (marked.where("same").groupBy("host", "parent")
             .agg(F.sum("b").alias("g_b"), F.sum("l").alias("g_l")).withColumn("same", F.lit(True)))
    b = F.coalesce("g_b", "b")
    n = F.coalesce("g_l", "l")
    return (marked.join(pools, ["host", "parent", "same"], "left").join(shared, ["parent", "template"])
            .select("host", "parent", "template", ((b + weight * F.col("prior")) / (n + weight)).alias("block_rate")))


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, reject: float = REJECT,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the method's ``template`` and
    ``block_rate`` for every row."""
    rows = (with_rule(parsed(df, id_col, url_col), rules)
            .withColumn("lexical", F.regexp_replace("path", NAMES, "*")))
    counted = rows.groupBy("host", "lexical").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("ruled").eqNullSafe("block")).cast("long")).alias("blocked"),
        F.sum(F.col("ruled").isNotNull().cast("long")).alias("labelled"))
    tree = templates(counted)
    rates = block_rates(tree)
    verdicts = (tree.select("host", "lexical", "parent", "template")
                .join(rates, ["host", "parent", "template"]).drop("parent"))
    learnt = F.when(F.col("block_rate") >= reject, "block").otherwise("allow")
    return rows.join(verdicts, ["host", "lexical"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "template", "block_rate")
