"""Exact data profile of any DataFrame.

Plan shape. No cell and no text is shuffled or written, whatever the table:

* per-column counts and moments (``stats_frame``): one map-side aggregate of
  the input, all columns at once;
* order statistics (``order_stats``): a mergeable quantile summary per column
  gives a bracket around every wanted rank; one counting pass proves that the
  rank lies inside, or widens the bracket; brackets that still hold many values
  get a summary of their own, and of the last, bounded ones only the values
  inside are grouped. Outliers are counted against the fences in one aggregate;
* distinct counts and top counts of text columns: counts by 128-bit digest, so
  that a distinct value is some 50 bytes in the shuffle, however long its text;
* top values: a mergeable heavy-hitter summary of hashes names candidates, a
  second pass counts them exactly, and they are taken if the summary's bound
  proves that no other value can reach them; otherwise the digests tell which
  values have the top counts, and only their texts are fetched.

What several plans read is written once to the shared folder, where every later
plan reads it, also after executors are lost.

Column kinds are decided on the driver from the per-column stats (one row
per column, so its size is bounded by the schema, not the data).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import cells
from quarry.functions.numbers import fixed_value
from quarry.session import scratch_path

# --- fixed values: the reference's thresholds ------------------------------
TOP_K = 5
NUMERIC_SHARE = 0.5          # numeric cells > 0.5 x populated -> numeric
CATEGORICAL_SHARE = 0.5      # distinct < 0.5 x populated (and > 1) -> categorical
IQR_FENCE = 1.5
SKEW_BAND = 0.1              # |mean - median| < 0.1 sd -> symmetric
SKEW_EPS = 0.0001
VAR_HIGH, VAR_MODERATE = 0.5, 0.2
CARD_HIGH, CARD_LOW = 0.8, 10
CONC_SEVERE, CONC_MODERATE = 0.9, 0.5
QUALITY = ((95, "excellent"), (80, "good"), (60, "moderate"))
DIM_LOW, DIM_MODERATE = 0.01, 0.1
MISSING_NOTE_PCT = 5
# ---------------------------------------------------------------------------
ACCURACY = 10_000                # of the quantile summaries: rank error 1 / ACCURACY
BRACKET_ROWS = 100_000         # values grouped per bracket, at any size of the table
HITTERS = 64                     # candidates for top values, per column
TRACKED = 10_000                 # items of the heavy-hitter summary
PREFIX = 16                      # letters kept beside a digest, to order ties

STATS_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("populated", T.LongType()),
    T.StructField("numeric_n", T.LongType()),
    T.StructField("sum", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("var_pop", T.DoubleType()),
])


@dataclass(frozen=True)
class ColumnSpec:
    position: int
    name: str
    dtype: T.DataType

    @property
    def col(self) -> Column:
        """The column under its internal, positional name, which neither
        upper and lower case nor quotes in the name can make ambiguous."""
        return F.col(f"c{self.position}")

    def value(self) -> Column:
        """Trimmed text of the cell ('' when missing); null for typed numbers."""
        return (F.lit(None).cast("string") if cells.is_numeric_type(self.dtype)
                else cells.as_cell(self.col, self.dtype))

    def number(self) -> Column:
        return cells.as_number(self.col, self.dtype)

    def populated(self) -> Column:
        return self.number().isNotNull() if cells.is_numeric_type(self.dtype) else self.value() != ""


class TableProfile:
    """Profile of one DataFrame. Methods return lazy DataFrames, except that
    the per-column stats are collected once (one row per column)."""

    def __init__(self, df: DataFrame, bracket_rows: int = BRACKET_ROWS, accuracy: int = ACCURACY):
        self.df = df
        self.spark: SparkSession = df.sparkSession
        self.specs = [ColumnSpec(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
        self.table = df.toDF(*[f"c{s.position}" for s in self.specs])
        self.bracket_rows, self.accuracy = bracket_rows, accuracy
        self._columns: dict[tuple[bool, bool], DataFrame] = {}

    # -- counts and moments ----------------------------------------------------
    def stats_frame(self) -> DataFrame:
        """Per-column counts and moments, one row per column, from one
        aggregate whose state is a few numbers per column and task."""
        if not self.specs:
            return self.spark.createDataFrame([], STATS_SCHEMA)
        parsed = self.table.select(*[x for s in self.specs for x in (
            s.populated().alias(f"p{s.position}"), s.number().alias(f"v{s.position}"))])

        def measures(s: ColumnSpec) -> Column:
            v = F.col(f"v{s.position}")
            parts = [F.lit(s.position), F.lit(s.name), F.count(F.lit(1)), F.count_if(f"p{s.position}"), F.count(v),
                     F.sum(v), F.min(v), F.max(v), F.var_pop(v)]
            return F.struct(*[x.cast(f.dataType).alias(f.name) for x, f in zip(parts, STATS_SCHEMA.fields)])

        return parsed.agg(F.array(*[measures(s) for s in self.specs]).alias("columns")).select(F.inline("columns"))

    def cell_counts(self) -> DataFrame:
        """``(position, value, v, k)``: how often each cell occurs, for every
        column, as a plan. It is mergeable by addition: the state of the
        streaming profile."""
        if not self.specs:
            return self.spark.createDataFrame([], "position INT, value STRING, v DOUBLE, k BIGINT")
        sets = F.array(*[F.struct(F.lit(s.position).alias("position"), s.value().alias("value"),
                                  s.number().alias("v")) for s in self.specs])
        return (self.table.select(F.inline(sets))
                .groupBy("position", "value", "v").agg(F.count(F.lit(1)).alias("k")))

    @cached_property
    def stats_rows(self) -> list[Row]:
        return sorted(self.stats_frame().collect(), key=lambda r: r["position"])

    @cached_property
    def row_count(self) -> int:
        return self.stats_rows[0]["rows"] if self.stats_rows else self.df.count()

    @cached_property
    def numeric_positions(self) -> list[int]:
        return [r["position"] for r in self.stats_rows
                if r["populated"] > 0 and r["numeric_n"] > NUMERIC_SHARE * r["populated"]]

    @cached_property
    def text_positions(self) -> list[int]:
        num = set(self.numeric_positions)
        return [r["position"] for r in self.stats_rows
                if r["populated"] > 0 and r["position"] not in num]

    def stats(self) -> DataFrame:
        """The collected stats as a small DataFrame (one row per column)."""
        return self.spark.createDataFrame(self.stats_rows, STATS_SCHEMA)

    # -- text columns: digests and heavy hitters ---------------------------------
    def _texts(self, positions: list[int]) -> DataFrame:
        """``(position, value)`` of the non-blank cells of the given columns."""
        wanted = [s for s in self.specs if s.position in set(positions)]
        if not wanted:
            return self.spark.createDataFrame([], "position INT, value STRING")
        return self.table.select(F.inline(F.array(*[
            F.struct(F.lit(s.position).alias("position"), s.value().alias("value")) for s in wanted]))
        ).where(F.col("value") != "")

    @cached_property
    def digests(self) -> DataFrame:
        """``(position, d1, d2, k, prefix)``: the counts of the distinct values of
        the non-numeric columns by 128-bit digest, written once."""
        if not self.text_positions:
            return self.spark.createDataFrame([], "position INT, d1 BIGINT, d2 BIGINT, k BIGINT, prefix STRING")
        rows = self._texts(self.text_positions).select("position", *_digest(F.col("value")), _prefix().alias("prefix"))
        return _written(rows.groupBy("position", "d1", "d2").agg(
            F.count(F.lit(1)).alias("k"), F.min("prefix").alias("prefix")), "text-digests")

    def cardinality(self) -> DataFrame:
        """``(position, distinct_n, top_k)`` for the non-numeric columns."""
        return self.digests.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_n"), F.max("k").alias("top_k"))

    def top_values(self, k: int = TOP_K) -> DataFrame:
        """``(position, value, k, rank)``: the top ``k`` values per non-numeric
        column by count, ties by value."""
        proven, rest = self._heavy_hitters(k)
        found = proven
        if rest:
            found = proven.unionByName(self._top_by_digest(k, rest))
        w = Window.partitionBy("position").orderBy(F.col("k").desc(), F.col("value").asc())
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _heavy_hitters(self, k: int) -> tuple[DataFrame, list[int]]:
        """``(position, value, k)`` that hold the top values of the columns for which
        the summary proves it, and the columns for which it doesn't. The summaries
        and the candidates are bounded per column."""
        none = self.spark.createDataFrame([], "position INT, value STRING, k BIGINT")
        specs = [self.specs[p] for p in self.text_positions]
        if not specs:
            return none, []
        def hashed(s):
            return f"xxhash64(v{s.position})"
        cells_ = self.table.select(*[s.value().alias(f"v{s.position}") for s in specs])
        tops = cells_.agg(*[F.expr(f"approx_top_k(if(v{s.position} <> '', {hashed(s)}, null), {HITTERS}, {TRACKED})").alias(f"t{s.position}")
                            for s in specs]).first()
        populated = {r["position"]: r["populated"] for r in self.stats_rows}
        candidates, bounds = [], {}
        for s, top in zip(specs, tops):
            items = [(r["item"], r["count"]) for r in top or [] if r["item"] is not None]
            candidates += [(s.position, h) for h, _ in items]
            # a value that isn't named counts no more than the last one named, plus
            # the summary's error on both sides; all are named if they are few
            rest = min(c for _, c in items) if len(items) >= HITTERS else 0
            bounds[s.position] = rest + (2 * 3.5 * populated[s.position] / TRACKED if populated[s.position] > TRACKED else 0)
        few = self.spark.createDataFrame(candidates, "position INT, h BIGINT")  # HITTERS rows per column
        exact = _written(
            self._texts([s.position for s in specs]).withColumn("h", F.xxhash64("value"))
            .join(F.broadcast(few), ["position", "h"]).groupBy("position", "value").agg(F.count(F.lit(1)).alias("k")), "hitters")
        counts: dict[int, list[int]] = {}
        for r in exact.select("position", "k").collect():
            counts.setdefault(r["position"], []).append(r["k"])
        proven = set()
        for s in specs:
            own = sorted(counts.get(s.position, []), reverse=True)
            if sum(own) == populated[s.position] or (len(own) >= k and own[k - 1] > bounds[s.position]):
                proven.add(s.position)
        return (exact.where(F.col("position").isin(list(proven))) if proven else none,
                [s.position for s in specs if s.position not in proven])

    def _top_by_digest(self, k: int, positions: list[int]) -> DataFrame:
        """``(position, value, k)`` with the top values, from the digests: the counts
        of the k-th place, then, of the digests with that count, those with the
        smallest prefixes. Only texts up to that prefix are read again."""
        d = self.digests.where(F.col("position").isin(positions))
        by_count = Window.partitionBy("position").orderBy(F.col("k").desc(), "prefix")
        last = (d.withColumn("n", F.row_number().over(by_count)).where(F.col("n") <= k)
                .groupBy("position").agg(F.max(F.struct("n", "k", "prefix")).alias("at"))
                .select("position", F.col("at.k").alias("least"), F.col("at.prefix").alias("upto")))
        # written, so that Spark knows its size when it picks the join
        chosen = _written(
            d.join(F.broadcast(last), "position")  # a row per column
            .where((F.col("k") > F.col("least")) | (F.col("k") == F.col("least")) & (F.col("prefix") <= F.col("upto")))
            .select("position", "d1", "d2", "k"), "top-digests")
        texts = self._texts(positions).select("position", "value", *_digest(F.col("value")))
        return (texts.join(chosen, ["position", "d1", "d2"]).groupBy("position", "d1", "d2")
                .agg(F.min("value").alias("value"), F.max("k").alias("k")).select("position", "value", "k"))

    # -- order statistics ------------------------------------------------------------
    def order_stats(self, positions: list[int] | None = None) -> DataFrame:
        """``(position, q1, median, q3)``, exact, for the numeric columns (or those
        of them that are given).

        q1 = sorted[floor(n/4)], q3 = sorted[floor(3n/4)] (0-based, no
        interpolation), median = mean of the two middle values when n is even.
        """
        wanted: dict[tuple[int, int], list[str]] = {}
        for r in self.stats_rows:
            p, n = r["position"], r["numeric_n"]
            if p in self.numeric_positions and (positions is None or p in positions):
                for name, rank in (("q1", math.floor(n * 0.25)), ("q3", math.floor(n * 0.75)),
                                   ("m_lo", (n - 1) // 2), ("m_hi", n // 2)):
                    wanted.setdefault((p, rank), []).append(name)
        values = self._at_ranks(list(wanted))
        found: dict[int, dict[str, float]] = {}
        for (p, rank), names in wanted.items():
            found.setdefault(p, {}).update({n: values[p, rank] for n in names})
        return self.spark.createDataFrame(
            [(p, f["q1"], (f["m_lo"] + f["m_hi"]) / 2, f["q3"]) for p, f in found.items()],
            "position INT, q1 DOUBLE, median DOUBLE, q3 DOUBLE")

    def _numbers(self, positions: set[int]) -> DataFrame:
        return self.table.select(*[self.specs[p].number().alias(f"v{p}") for p in sorted(positions)])

    def _at_ranks(self, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """The value at each (position, 0-based rank) of the sorted numbers (a NaN is
        a missing cell). A bracket is a closed interval of values with the number of
        values below it; all brackets of all columns share a pass."""
        # rank: (lowest value, highest value, values below, values inside)
        numbers = {r["position"]: r["numeric_n"] for r in self.stats_rows}
        done: dict[tuple[int, int], float] = {}
        open_ = {w: (None, None, 0, numbers[w[0]]) for w in wanted}
        margin = 1.5
        while open_:
            small = {w: b for w, b in open_.items() if b[3] <= self.bracket_rows}
            large = {w: b for w, b in open_.items() if w not in small}
            if small:
                done |= self._ranked_inside(small)
            open_ = {}
            if not large:
                break
            cuts = self._summaries(large, margin)
            counts = self._counts(large, cuts)
            stuck = True
            for w, (lo, hi, below, inside) in large.items():
                a, b = cuts[w]
                n_below, n_inside = counts[w]
                if not n_below <= w[1] < n_below + n_inside:
                    open_[w] = (lo, hi, below, inside)  # the summary was off: again, with a wider margin
                elif a == b:
                    done[w] = a
                    stuck = False
                else:
                    stuck = stuck and n_inside >= inside
                    open_[w] = (a, b, n_below, n_inside)
            margin *= 4 if stuck else 1
            if stuck and margin > self.accuracy:
                done |= self._ranked_inside(open_)
                break
        return done

    @staticmethod
    def _inside(col: Column, b) -> Column:
        """Whether a value lies in a bracket."""
        cond = col.isNotNull()
        if b[0] is not None:
            cond = cond & (col >= F.lit(b[0])) & (col <= F.lit(b[1]))
        return cond

    def _summaries(self, brackets: dict, margin: float) -> dict:
        """A narrower bracket for each rank, by a quantile summary of the values in
        the present one."""
        same: dict[tuple, list] = {}
        for w, b in brackets.items():
            same.setdefault((w[0], b), []).append(w)
        aggs = []
        for (p, b), keys in same.items():
            off = margin / self.accuracy
            at = [(rank - b[2] + 0.5) / b[3] for _, rank in keys]
            points = [x for q in at for x in (max(0.0, q - off), min(1.0, q + off))]
            v = F.when(self._inside(F.col(f"v{p}"), b), F.col(f"v{p}"))
            aggs.append(F.percentile_approx(v, points, self.accuracy))
        row = self._numbers({p for p, _ in brackets}).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        return {w: (float(row[i][2 * j]), float(row[i][2 * j + 1]))
                for i, keys in enumerate(same.values()) for j, w in enumerate(keys)}

    def _counts(self, brackets: dict, cuts: dict) -> dict:
        """How many values lie below and inside of each new bracket."""
        aggs, keys = [], list(brackets)
        for p, rank in keys:
            v, (a, b) = F.col(f"v{p}"), cuts[p, rank]
            aggs += [F.count_if(v < F.lit(a)), F.count_if((v >= F.lit(a)) & (v <= F.lit(b)))]
        row = self._numbers({p for p, _ in keys}).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        return {k: (row[2 * i], row[2 * i + 1]) for i, k in enumerate(keys)}

    def _ranked_inside(self, brackets: dict) -> dict:
        """The values at the ranks, by grouping only what lies in the brackets."""
        keys = list(brackets)
        # ranks of one column with the same bracket share its values
        same = {}
        for k in keys:
            same.setdefault((k[0], brackets[k]), []).append(k)
        groups = list(same)
        rows = self._numbers({p for p, _ in keys}).select(F.inline(F.filter(F.array(*[
            F.struct(F.lit(i).alias("g"), F.when(self._inside(F.col(f"v{p}"), b), F.col(f"v{p}")).alias("v"))
            for i, (p, b) in enumerate(groups)]), lambda x: x["v"].isNotNull())))
        freq = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
        upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranks = self.spark.createDataFrame(
            [(i, p, rank, rank - b[2]) for i, (p, b) in enumerate(groups) for p, rank in same[p, b]],
            "g INT, position INT, rank BIGINT, local BIGINT")
        hit = (freq.withColumn("end", F.sum("k").over(upto)).join(F.broadcast(ranks), "g")  # 4 rows per column
               .where((F.col("end") - F.col("k") <= F.col("local")) & (F.col("local") < F.col("end"))))
        return {(r["position"], r["rank"]): r["v"] for r in hit.select("position", "rank", "v").collect()}

    def outlier_counts(self, quartiles: DataFrame) -> DataFrame:
        """``(position, outliers)``: numeric values strictly outside the IQR
        fences (two numbers per column), in one aggregate of the input."""
        fences = {r["position"]: (r["q1"] - IQR_FENCE * (r["q3"] - r["q1"]), r["q3"] + IQR_FENCE * (r["q3"] - r["q1"]))
                  for r in quartiles.collect()}
        if not fences:
            return self.spark.createDataFrame([], "position INT, outliers BIGINT")
        aggs = [F.count_if((F.col(f"v{p}") < F.lit(a)) | (F.col(f"v{p}") > F.lit(b))).alias(f"a{p}")
                for p, (a, b) in fences.items()]
        row = self._numbers(set(fences)).agg(*aggs).first()
        return self.spark.createDataFrame([(p, row[f"a{p}"]) for p in fences], "position INT, outliers BIGINT")

    def top_values_named(self, k: int = TOP_K) -> DataFrame:
        """Top values with column name and share of populated cells, for the
        non-numeric columns (the report's category distribution)."""
        st = self.stats().select("position", "column_name", "populated")
        return (self.top_values(k).join(F.broadcast(st), "position")
                .withColumn("share", F.col("k") / F.col("populated")))

    def fences(self, name: str) -> tuple[float, float] | None:
        """IQR fences of one numeric column (two numbers, on the driver)."""
        pos = self._position(name)
        if pos not in self.numeric_positions:
            return None
        q = self.order_stats([pos]).collect()
        if not q:
            return None
        q1, q3 = q[0]["q1"], q[0]["q3"]
        return q1 - IQR_FENCE * (q3 - q1), q3 + IQR_FENCE * (q3 - q1)

    def outlier_rows(self, name: str) -> DataFrame:
        """The input rows whose value in ``name`` lies outside its fences."""
        f = self.fences(name)
        if f is None:
            return self.df.limit(0)
        v = self.specs[self._position(name)].number()
        return self.table.where((v < F.lit(f[0])) | (v > F.lit(f[1]))).toDF(*self.df.columns)

    def _position(self, name: str) -> int:
        for s in self.specs:
            if s.name == name:
                return s.position
        raise KeyError(name)

    # -- whole-row measures ---------------------------------------------------
    def row_counts(self) -> DataFrame:
        """``(d1, d2, k)``: how often each row occurs, by a 128-bit digest of its
        normalised cells, each with its length in front, so that no two tuples of
        cells read alike. A row is 24 bytes in the shuffle, however wide."""
        def told(s: ColumnSpec) -> Column:
            if isinstance(s.dtype, T.StringType):
                text = s.value()
            elif isinstance(s.dtype, (T.FloatType, T.DoubleType)):
                text = (s.col + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
            else:
                text = s.col.cast("string")
            return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

        row = F.concat(F.lit(""), *[told(s) for s in self.specs])
        return (self.table.select(row.alias("row")).select(*_digest(F.col("row")))
                .groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k")))

    def duplicate_count(self) -> DataFrame:
        """``(rows, distinct_rows, duplicates)``: rows minus distinct rows,
        comparing normalised cell tuples (not joined text)."""
        return self.row_counts().agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("rows"),
                                     F.count(F.lit(1)).cast("long").alias("distinct_rows")).select(
            "rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))

    # -- the per-column profile ----------------------------------------------
    def columns(self, order_stats: bool = True, text: bool = True) -> DataFrame:
        """One row per column with every per-column measure and label.
        Computed once (one plan) and kept as a small local frame. Without
        ``order_stats`` the quartiles, median and outliers and the labels
        derived from them are null; without ``text`` the distinct and top
        counts of the columns that aren't numeric are, and their kind is that
        of a column with no distinct count. Callers ask for what they return."""
        key = (order_stats, text)
        for have, frame in self._columns.items():
            if have >= key and have[1] >= text:
                return frame
        frame = self._columns_plan(order_stats, text)
        self._columns[key] = self.spark.createDataFrame(frame.collect(), frame.schema)
        return self._columns[key]

    def _columns_plan(self, order_stats: bool, text: bool) -> DataFrame:
        none = lambda schema: self.spark.createDataFrame([], schema)
        quart = self.order_stats() if order_stats else none("position INT, q1 DOUBLE, median DOUBLE, q3 DOUBLE")
        outl = self.outlier_counts(quart) if order_stats else none("position INT, outliers BIGINT")
        card = self.cardinality() if text else none("position INT, distinct_n BIGINT, top_k BIGINT")
        df = self.stats().join(quart, "position", "left").join(outl, "position", "left").join(card, "position", "left")
        return _label_columns(df, set(self.numeric_positions))

    def overview(self) -> DataFrame:
        """Rows, columns, cells, empty cells, completeness and its labels."""
        st = self.stats()
        ncols = len(self.specs)
        o = st.agg(F.max("rows").alias("rows"),
                   F.sum(F.col("rows") - F.col("populated")).cast("long").alias("empty_cells"))
        if not self.specs:
            o = self.spark.createDataFrame([(self.df.count(), 0)], "rows BIGINT, empty_cells BIGINT")
        o = o.select(F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                     F.lit(ncols).cast("long").alias("columns"),
                     F.coalesce("empty_cells", F.lit(0)).cast("long").alias("empty_cells"))
        o = o.withColumn("total_cells", F.col("rows") * F.col("columns"))
        o = o.withColumn("populated_cells", F.col("total_cells") - F.col("empty_cells"))
        o = o.withColumn("completeness", F.try_divide(
            F.col("populated_cells") * F.lit(100.0), F.col("total_cells")))
        q = F.col("completeness")
        label = F.when(q.isNull(), F.lit("no data"))
        for bound, name in QUALITY:
            label = label.when(q >= bound, F.lit(name))
        o = o.withColumn("quality", label.otherwise(F.lit("limited")))
        ratio = F.try_divide(F.col("columns").cast("double"), F.col("rows").cast("double"))
        return o.withColumn(
            "dimensionality",
            F.when(ratio.isNull(), F.lit("no data"))
            .when(ratio < DIM_LOW, F.lit("low")).when(ratio < DIM_MODERATE, F.lit("moderate"))
            .otherwise(F.lit("high")))


def _written(frame: DataFrame, name: str) -> DataFrame:
    """Write a table that several plans read to the shared folder."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _digest(value: Column) -> list[Column]:
    """A 128-bit digest, as two hashes with different seeds."""
    return [F.xxhash64(value).alias("d1"), F.xxhash64(F.lit("second"), value).alias("d2")]


def _prefix() -> Column:
    return F.substring("value", 1, PREFIX)


def _label_columns(df: DataFrame, numeric: set[int]) -> DataFrame:
    """Kinds, missing share, moments and every label, as column expressions."""
    c = F.col
    is_num = c("position").isin(list(numeric)) if numeric else F.lit(False)
    kind = (F.when(c("populated") == 0, F.lit("empty"))
            .when(is_num, F.lit("numeric"))
            .when((c("distinct_n") < CATEGORICAL_SHARE * c("populated")) & (c("distinct_n") > 1),
                  F.lit("categorical"))
            .otherwise(F.lit("text")))
    df = df.withColumn("kind", kind)
    df = df.withColumn("missing", c("rows") - c("populated"))
    df = df.withColumn("missing_pct", F.try_divide(c("missing") * F.lit(100.0), c("rows")))
    df = df.withColumn("missing_pct_1dp", fixed_value(c("missing_pct"), 1))
    num = c("kind") == "numeric"
    df = df.withColumn("mean", F.when(num, c("sum") / c("numeric_n")))
    df = df.withColumn("sd", F.when(num, F.sqrt(c("var_pop"))))
    df = df.withColumn("range", F.when(num, c("max") - c("min")))
    for name in ("min", "max", "sum", "var_pop", "q1", "q3", "median"):
        df = df.withColumn(name, F.when(num, c(name)))
    df = df.withColumn("iqr", c("q3") - c("q1"))
    df = df.withColumn("lower_fence", c("q1") - IQR_FENCE * c("iqr"))
    df = df.withColumn("upper_fence", c("q3") + IQR_FENCE * c("iqr"))
    df = df.withColumn("outliers", F.when(num, F.coalesce(c("outliers"), F.lit(0))))
    df = df.withColumn("outlier_pct", c("outliers") * F.lit(100.0) / c("numeric_n"))
    # comparisons with NaN are false here, while Spark takes it for the largest number
    less = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a < b)
    diff = c("mean") - c("median")
    df = df.withColumn("skew_score", diff / (c("sd") + SKEW_EPS))
    df = df.withColumn("skew", F.when(~num | c("median").isNull(), F.lit(None))
                       .when(less(F.abs(diff), c("sd") * SKEW_BAND), F.lit("symmetric"))
                       .when(less(c("median"), c("mean")), F.lit("right"))
                       .otherwise(F.lit("left")))
    cv = F.try_divide(c("sd"), c("mean"))
    df = df.withColumn("variability", F.when(~num, F.lit(None))
                       .when(c("mean") == 0, F.when(less(F.lit(0.0), c("sd")), F.lit("high")).otherwise(F.lit("low")))
                       .when(less(F.lit(VAR_HIGH), cv), F.lit("high"))
                       .when(less(F.lit(VAR_MODERATE), cv), F.lit("moderate"))
                       .otherwise(F.lit("low")))
    df = df.withColumn("distribution", F.when(~num | c("median").isNull(), F.lit(None))
                       .when(less(c("median"), c("mean")), F.lit("higher"))
                       .when(less(c("mean"), c("median")), F.lit("lower"))
                       .otherwise(F.lit("similar")))
    text = c("kind").isin("categorical", "text")
    df = df.withColumn("distinct_n", F.when(text, c("distinct_n")))
    df = df.withColumn("cardinality_ratio", F.when(text, c("distinct_n") / c("populated")))
    df = df.withColumn("cardinality", F.when(~text, F.lit(None))
                       .when(c("distinct_n") == c("populated"), F.lit("identifier"))
                       .when(c("distinct_n") > CARD_HIGH * c("populated"), F.lit("high"))
                       .when(c("distinct_n") < CARD_LOW, F.lit("low"))
                       .otherwise(F.lit("moderate")))
    share = c("top_k") / c("populated")
    df = df.withColumn("top_share", F.when(text, share))
    df = df.withColumn("concentration", F.when(~text, F.lit(None))
                       .when(share > CONC_SEVERE, F.lit("severe"))
                       .when(share > CONC_MODERATE, F.lit("moderate"))
                       .otherwise(F.lit("balanced")))
    return df.drop("top_k")


def profile(df: DataFrame) -> TableProfile:
    return TableProfile(df)
