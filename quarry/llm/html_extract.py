"""Main text of web pages, with site templates found by counting subtrees.

Method. Pages are parsed into elements, and every block element's subtree (tag,
class, id and everything below it) is hashed. Spark counts, per host and per
section (host and first directory of the path), on how many different pages
each hash stands: pages with the same article text count once, so copies of an
article aren't taken for a template. Template is what stands on at least
``MIN_PAGES`` and a ``MIN_SHARE`` of the different pages of its host, or of its
section there, and a container on at least ``MANY_PAGES`` different pages of
its host, however large the host is. These subtrees are deleted, together with
the parts that HTML itself names as outside of the article (navigation, forms,
scripts and so on, by tag or role, or by a class or id that names such a part and
nothing else), and the blocks left are joined. A marked part or a form that has the
page's article and most of its text is a wrapper, and stays. If a page has article
elements, or else a main element, that aren't mere teasers, only text in them
counts, and there only containers are deleted as template, never a paragraph or
heading by itself, since pages may quote the same passage.

The counts are taken over all pages. Pages get from their hosts' templates only
the hashes that they hold: up to ``BROADCAST_MARKS`` of them are looked up in a
broadcast array, more are joined with the pages' hashes, salted.

Cases: null or empty html gives an empty text. Unclosed elements end with their
parent, stray end tags are skipped, cut tags at the end are dropped. White
space is what Unicode says. A null url belongs to the empty host. Repeated rows
give repeated results. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick, written
from quarry.llm.url_filter import host_of

MIN_PAGES = 10
MIN_SHARE = 0.3
MANY_PAGES = 100
BROADCAST_MARKS = 1_000_000
SALTS = 32
#: the first directory of the path
SECTION = r"(?s)^.*?://[^/?#]*/([^/?#]+)/"

#: fixed values: HTML's elements by what they do to text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "tfoot thead tr ul caption".split())
CONTAINER = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption tr summary".split())
BLANK = frozenset("br td th option img".split())
OUTSIDE = frozenset(
    "head nav footer aside form button select option datalist label input textarea script style noscript template "
    "iframe object svg canvas audio video dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                  "toolbar".split())
#: words of class or id that mark a part outside of the article
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "side aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead comment "
    "comments commentlist discussion disqus replies respond share sharing social related recommended recommendations "
    "widget widgets toolbar search form hidden skip".split())
#: words that such a mark may stand with: ``cookie-banner-box``, ``site-footer`` and
#: ``related-posts`` are parts, ``has-sidebar``, ``comments-open`` and ``search-term`` aren't
WITH = frozenset(
    "area articles bar block bottom box button buttons card cards col column container content div element footer global "
    "header home icon icons image img inline inner item items js left link links list lists main message messages "
    "mobile module outer page panel post posts primary right row secondary section site slot small sticky story "
    "stories text thread title top unit user view wrap wrapper".split())
#: what may stand in a head; any other start tag ends it
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: a marked part that has an article, main or h1 element and this share of the text is the page's wrapper
WRAPPER = 0.5
#: the same for a form without
FORM_WRAPPER = 0.8
#: articles that have no h1 and less than this share of the text are teasers
ARTICLES = 0.4
#: words that mark a header as the article's own
OWN = frozenset("article post entry story content".split())
#: a start tag of the first kind closes an open element of the second
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}}
FENCE = frozenset("article aside body button div dl fieldset footer form header html main nav ol section table td "
                  "th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|([^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def marked(name: str, in_article: bool) -> bool:
    """Whether a class or id names a part outside of the article."""
    words = [w for w in (x.rstrip("0123456789") for x in WORD.findall(HUMP.sub(" ", name).lower())) if w]
    if not all(w in WORDS or w in WITH for w in words):
        return False
    return any(w in WORDS for w in words) or "header" in words and not in_article and not OWN & set(words)


def outside(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether an element does not belong to the article: 2 by its tag, role or
    hiding, 1 by its class or id, or as a form, unless it is the page's wrapper."""
    if tag == "form":
        return 1
    if tag in OUTSIDE:
        return 2
    if tag == "header" and not in_article:
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return 2
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    if tag in ("article", "main") or in_article and tag not in BLOCK:
        return 0
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    return 1 if any(marked(n, in_article) for n in names) else 0


class Element:
    __slots__ = ("tag", "off", "soft", "article", "main", "start", "parts", "key", "plain")

    def __init__(self, tag, off, soft, article, main, start, key, plain):
        self.tag, self.off, self.article, self.main = tag, off, article, main
        self.soft = soft  # the marked elements that it stands in
        self.start, self.key, self.plain = start, key, plain
        self.parts: list = []


class Marked:
    """A part that is marked as outside, unless it turns out to be the wrapper."""

    __slots__ = ("form", "heads", "size")

    def __init__(self, form):
        self.form, self.heads, self.size = form, False, 0

    def stays(self, total: int) -> bool:
        return self.heads and self.size > WRAPPER * total or self.form and self.size > FORM_WRAPPER * total


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The blocks of the page's article, and (hash, first block, end) of every
    block element that may be deleted; odd hashes are containers'."""
    found: list[tuple[int, int, int]] = []
    blocks: list[tuple[str, bool, bool, tuple]] = []
    line: list[str] = []
    stack = [Element("", False, (), False, False, 0, "", False)]
    opened: Counter[str] = Counter()  # elements on the stack, by tag
    headed = False  # an article has an h1

    def flush():
        if line:
            text = " ".join("".join(line).split())
            if text:
                top = stack[-1]
                blocks.append((text, top.article, top.main, top.soft))
            line.clear()

    def close():
        e = stack[-1]
        if e.tag in BLOCK:
            flush()
        stack.pop()
        opened[e.tag] -= 1
        if e.tag in BLOCK and not e.off:
            told = hashlib.blake2b("\x1f".join([e.key, *e.parts]).encode("utf-8", "replace"), digest_size=8)
            h = int.from_bytes(told.digest(), "little", signed=True) & ~1 | (e.tag in CONTAINER)
            if not e.plain and e.parts:
                found.append((h, e.start, len(blocks)))
            stack[-1].parts.append(str(h))
        else:
            stack[-1].parts.append(e.key)
            stack[-1].parts += e.parts

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[7]
        if text is not None:
            top = stack[-1]
            if not top.off:
                text = entities.unescape(text) if "&" in text else text
                line.append(text)
                if bare := text.strip():
                    top.parts.append(bare)
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if opened[tag]:
                if tag not in BLOCK and any(e.tag in BLOCK for e in stack[next(
                        i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag) + 1:]):
                    continue  # an inline end tag doesn't end blocks
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in ("p", "br"):
                flush()
            continue
        if opened["head"] and tag not in HEAD:
            while opened["head"]:
                close()
        if tag in BLOCK:
            flush()
            i = len(stack) - 1
            while i and opened["p"] and stack[i].tag not in FENCE:
                if stack[i].tag == "p":
                    while len(stack) > i:
                        close()
                    break
                i -= 1
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            i = len(stack) - 1
            while i and stack[i].tag not in ("ul", "ol", "dl", "table", "menu"):
                if stack[i].tag in CLOSES[tag]:
                    while len(stack) > i:
                        close()
                i -= 1
        if tag in BLANK:
            line.append(" ")
        if tag in VOID:
            continue
        raw = m[3] if m[2] else m[6]
        attrs = attributes(raw) if raw and "=" in raw or raw and "hidden" in raw else {}
        top = stack[-1]
        how = 0 if top.off else outside(tag, attrs, top.article)
        off, soft = top.off or how == 2, (*top.soft, Marked(tag == "form")) if how == 1 else top.soft
        inner = top.article or tag == "article" or "articlebody" in attrs.get("itemprop", "").lower()
        main = top.main or tag == "main" or attrs.get("role") == "main"
        if not off:
            if tag in ("article", "main", "h1"):
                for part in soft:
                    part.heads = True
            headed |= inner and tag == "h1" and not soft
        key = f"{tag} {attrs.get('class', '')} {attrs.get('id', '')}"
        plain = (inner or main) and tag not in CONTAINER or tag in ("html", "body", "article", "main")
        opened[tag] += 1
        stack.append(Element(tag, off, soft, inner, main, len(blocks), key, plain))
        if tag in RAW and not raw.endswith("/"):
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else size
    while len(stack) > 1:
        close()
    flush()
    total = sum(len(b[0]) for b in blocks)
    for b in blocks:
        for part in b[3]:
            part.size += len(b[0])
    stays = [all(part.stays(total) for part in b[3]) for b in blocks]
    share = [sum(len(b[0]) for b, ok in zip(blocks, stays) if ok and (not i or b[i])) for i in (0, 1, 2)]
    inside = 1 if share[1] and (headed or share[1] >= ARTICLES * share[0]) else 2 if share[2] >= ARTICLES * share[0] and share[2] else 0
    place, kept = [0], []
    for b, ok in zip(blocks, stays):
        if ok and (not inside or b[inside]):
            kept.append(b[0])
        place.append(len(kept))
    return kept, [(h, place[i], place[j]) for h, i, j in found]


PARSED = ("page_id long, url string, row long, host string, section string, page long, blocks array<string>, "
          "hashes array<long>, starts array<int>, ends array<int>")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, row, host, section`` of every page with its blocks and
    deletable subtrees; ``page`` is the hash of the page's text, equal for
    copies."""

    def work(batches):
        for batch in batches:
            out = []
            for html in batch.column(5).to_pylist():
                blocks, found = parse(html or "")
                key = hashlib.blake2b("\n".join(blocks).encode("utf-8", "replace"), digest_size=8).digest()
                out.append((int.from_bytes(key, "little", signed=True), blocks, *([f[i] for f in found] for i in range(3))))
            cols = [[o[i] for o in out] for i in range(5)]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:5] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["page_id", "url", "row", "host", "section", "page", "blocks", "hashes", "starts", "ends"])

    return pages.select("page_id", "url", "row", "host", "section", "html").mapInArrow(work, PARSED)


def site_marks(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
               many_pages: int = MANY_PAGES) -> DataFrame:
    """``mark``: a hash of place (host, or host and section) and subtree hash of
    every subtree that is template there."""
    each = found.select("host", "section", "page", F.explode("hashes").alias("hash"))
    marks = []
    for place in (["host"], ["host", "section"]):
        totals = (found.select(*place, "page").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("pages"))
                  .where(F.col("pages") >= min_pages))
        # a hash that one task sees often is one row of its partial distinct
        counts = (each.select(*place, "page", "hash").distinct().groupBy(*place, "hash")
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
        often = F.col("n") >= F.col("pages") * min_share
        if place == ["host"]:
            often |= (F.col("hash").bitwiseAND(1) == 1) & (F.col("n") >= many_pages)
        marks.append(counts.join(totals, place).where(often).select(F.xxhash64(*place, "hash").alias("mark")))
    return marks[0].unionByName(marks[1]).distinct()


def page_templates(found: DataFrame, marks: DataFrame) -> DataFrame:
    """``row, template``: the page's hashes that are template on its place."""
    places = F.array(F.xxhash64("host", "hash"), F.xxhash64("host", "section", "hash"))
    each = (found.select("row", "host", "section", F.explode(F.array_distinct("hashes")).alias("hash"))
            .select("row", "hash", F.explode(places).alias("mark")))
    spread = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["mark", "salt"], "left_semi")
    return hits.groupBy("row").agg(F.collect_set("hash").alias("template"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    url = F.col(url_col).cast("string")
    rows = pick(df, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                                                      F.col(html_col).cast("string").alias("html"))
    rows = (rows.withColumn("row", F.xxhash64("page_id", "url", "html")).withColumn("host", host_of(F.col("url")))
            .withColumn("section", F.regexp_extract(F.coalesce("url", F.lit("")), SECTION, 1)))
    found = written(parsed_pages(rows), "parsed-pages")
    marks = written(site_marks(found, min_pages, min_share, many_pages), "templates")
    slim = ["page_id", "url", "blocks", "starts", "ends"]
    few = marks.count() <= BROADCAST_MARKS
    if few:
        known = np.sort(marks.toPandas()["mark"].to_numpy(np.int64))
        known = df.sparkSession.sparkContext.broadcast(known)
        joined = found.select(*slim, F.transform("hashes", lambda h: F.xxhash64("host", h)).alias("at_host"),
                              F.transform("hashes", lambda h: F.xxhash64("host", "section", h)).alias("at_section"))
    else:
        joined = found.join(page_templates(found, marks), "row", "left").select(*slim, "hashes", "template")

    def hits(a, b):
        """Of every page, whether its subtrees are template."""
        if few:
            a, b, marks = a.flatten().to_numpy(), b.flatten().to_numpy(), known.value
            if not len(marks):
                return iter([False] * len(a))
            found = lambda x: marks[np.minimum(np.searchsorted(marks, x), len(marks) - 1)] == x
            return iter((found(a) | found(b)).tolist())
        pages = zip(a.to_pylist(), b.to_pylist())
        return (h in t for hashes, t in ((x, frozenset(y or ())) for x, y in pages) for h in hashes)

    def work(batches):
        for batch in batches:
            text, hit = [], hits(batch.column(5), batch.column(6))
            for blocks, starts, ends in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                gone = bytearray(len(blocks))
                for i, j in zip(starts, ends):
                    if next(hit):
                        gone[i:j] = b"\1" * (j - i)
                text.append("\n".join([b for b, g in zip(blocks, gone) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(work, "page_id long, url string, text string, n_chars long")
