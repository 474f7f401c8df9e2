"""Delimited text files and cell grids as all-text tables.

Both produce the reference's table shape: header names trimmed, every cell
a trimmed string, missing cells as the empty string.

A quoted cell may hold line breaks, so whether a line of text starts a record
depends on all quotes before it. Files are still read in splits, as Spark cuts
them, and every split by its own task:

1. each line's effect on "inside quotes" is one of four (keep, flip, inside,
   outside), told from the line alone; a split's lines compose to such an effect
   too, for both states that it could start with;
2. the effects of a file's splits, one small row each, are scanned in order,
   which fixes the true state at the start of every split;
3. each split's lines are numbered by record. Lines that are whole records, by far
   the most, are parsed where they are; only the pieces of records over several
   lines are brought together, also across splits.

Only two small numbers per line pass through Python; the text stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.cells import WS_CHARS, cell, is_blank
from quarry.session import scratch_path

KEEP, FLIP, OUTSIDE, INSIDE = 0, 1, 2, 3
BOM = "\ufeff"


def unique_headers(names: list[str]) -> list[str]:
    """Trim header names and suffix repeats ``_1``, ``_2``. Names that differ
    in case only are repeats too (Spark resolves names without case), and a
    suffixed name never takes one that is given out or comes later."""
    plain = [(raw or "").strip(WS_CHARS) for raw in names]
    taken: set[str] = set()
    later = [n.lower() for n in plain]
    out = []
    for i, name in enumerate(plain):
        new, k = name, 0
        while new.lower() in taken or (k and new.lower() in later[i + 1:]):
            k += 1
            new = f"{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


# -- which lines belong together -------------------------------------------------

def _effect(pieces: str, sep: str) -> str:
    """SQL: 4 x the state at the end of a line that starts outside of quotes + that
    of one that starts inside, from the line's ``pieces`` between quotes. The state
    is 0 after a closing quote, 1 inside, 2 in plain text with a literal quote and 3
    at the start of the line; a quote opens only at the start of a field, and one
    right after a closing quote is a doubled one."""
    def step(s: str) -> str:
        return f"case when {s} = 1 then 0 when p = '' and {s} in (0, 3) or endswith(p, {_lit(sep)}) then 1 else 2 end"

    return (f"aggregate(slice({pieces}, 1, size({pieces}) - 1), 13, "
            f"(s, p) -> 4 * {step('shiftright(s, 2)')} + {step('(s % 4)')})")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lines(spark: SparkSession, path: str | list[str], sep: str, multiline: bool) -> DataFrame:
    """``file, split, seq, line, kind`` of every line; ``seq`` ascends in a split."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_path"].alias("path"),
                       meta["file_block_start"].alias("split"), F.col("value").alias("line"))
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    if not multiline:
        return rows.withColumn("kind", F.lit(KEEP))
    quoted = rows.withColumn("pieces", F.when(F.contains("line", F.lit('"')), F.split("line", '"', -1)))
    ends = quoted.withColumn("ends", F.expr(_effect("pieces", sep)))
    out, inn = F.shiftright("ends", 2) == 1, F.col("ends") % 4 == 1
    kind = (F.when(F.col("ends").isNull() | (~out & inn), KEEP).when(out & inn, INSIDE)
            .when(out, FLIP).otherwise(OUTSIDE))
    return ends.withColumn("kind", kind).drop("pieces", "ends")


def states(kind: np.ndarray, first: int) -> np.ndarray:
    """The state (1: inside) before each line and after the last."""
    flips = np.concatenate([[0], np.cumsum(kind == FLIP)])
    fixed = np.concatenate([[-1], np.where(kind >= OUTSIDE, np.arange(len(kind)), -1)])
    last = np.maximum.accumulate(fixed)
    base = np.where(last < 0, first, kind[last] - OUTSIDE) if len(kind) else np.full(1, first)
    return (base + flips - flips[last + 1]) % 2


def _effects(batches):
    """Of every split: its end state and number of records, for both start states,
    and, of a file's first split, its first record with anything in it."""
    now, out = None, []

    def close():
        if now:
            out.append((now["file"], now["path"], now["split"], *now["state"], *now["records"], now["rec"], now["head"]))

    for batch in batches:
        file, path, split, head, kind = (batch.column(i) for i in range(5))
        kind, split_ = kind.to_numpy(), split.to_numpy()
        file_ = file.to_numpy()
        cut = np.flatnonzero((np.diff(file_) != 0) | (np.diff(split_) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kind)]):
            if a == b:
                continue
            key = (int(file_[a]), int(split_[a]))
            if now is None or (now["file"], now["split"]) != key:
                close()
                now = {"file": key[0], "split": key[1], "path": path[a].as_py(), "state": [0, 1], "records": [0, 0],
                       "rec": None, "head": None, "open": key[1] == 0}
            s = [states(kind[a:b], now["state"][k]) for k in (0, 1)]
            if now["open"]:
                _first_record(now, head.slice(a, b - a), s[0])
            for k in (0, 1):
                now["records"][k] += int((s[k][:-1] == 0).sum())
                now["state"][k] = int(s[k][-1])
    close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.int64(), pa.string(), pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
        names=["file", "path", "split", "s0", "s1", "n0", "n1", "head_rec", "head"])


def _first_record(now: dict, lines: pa.Array, state: np.ndarray) -> None:
    for i, line in enumerate(lines.to_pylist()):
        if now["head"] is None:
            if line.strip("\r" + BOM) == "":
                continue
            now["head"], now["rec"] = line.removeprefix(BOM), now["records"][0] + int((state[:i + 1] == 0).sum())
        else:
            now["head"] += "\n" + line
        if state[i + 1] == 0:
            now["open"] = False
            return


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: its true start state, the split and record that its first
    lines belong to if they go on with one, and its file's header."""
    head = F.when(F.col("split") == 0, F.col("line"))
    effects = lines.select("file", "path", "split", head.alias("head"), "kind").mapInArrow(
        _effects, "file long, path string, split long, s0 byte, s1 byte, n0 long, n1 long, head_rec long, head string")
    path = scratch_path(lines.sparkSession, "delimited-splits")
    effects.write.parquet(path)
    effects = lines.sparkSession.read.schema(effects.schema).parquet(path)
    if effects.agg(F.countDistinct("file") != F.countDistinct("path")).first()[0]:
        raise ValueError("two paths have equal 64-bit hashes: read them in two calls")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("s0") == 1) & (F.col("s1") == 0)
    fixed = F.col("s0") == F.col("s1")
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    scan = (effects.withColumn("flips", F.sum(flip.cast("int")).over(upto))
            .withColumn("last", F.last(F.when(fixed, F.struct("s0", "flips")), ignorenulls=True).over(before))
            .withColumn("flips_before", F.coalesce(F.sum(flip.cast("int")).over(before), F.lit(0)))
            .withColumn("start", ((F.coalesce(F.col("last.s0"), F.lit(0)) + F.col("flips_before")
                                   - F.coalesce(F.col("last.flips"), F.lit(0))) % 2).cast("int")))
    records = F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    return (scan.withColumn("records", records)
            .withColumn("owner", F.last(F.when(F.col("records") > 0, F.struct("split", "records")), ignorenulls=True).over(before))
            .withColumn("head", F.first("head", ignorenulls=True).over(Window.partitionBy("file")))
            .withColumn("head_rec", F.when(F.col("split") == 0, F.col("head_rec")))
            .select("file", "path", "split", "start", F.col("owner.split").alias("own_split"),
                    F.col("owner.records").alias("own_rec"), "head", "head_rec"))


_NUMBERED = T.StructType([T.StructField("state", T.IntegerType()), T.StructField("rec", T.LongType())])


@F.pandas_udf(_NUMBERED)
def _numbered(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """State and record number of each line, in the order of the lines; lines that
    go on with a record of an earlier split have number 0."""
    key, state, count = None, 0, 0
    for file, split, start, kind in batches:
        file, split, start, kind = (x.to_numpy() for x in (file, split, start, kind))
        before, rec = np.zeros(len(kind), np.int32), np.zeros(len(kind), np.int64)
        cut = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kind)]):
            if a == b:
                continue
            if key != (file[a], split[a]):
                key, state, count = (file[a], split[a]), int(start[a]), 0
            s = states(kind[a:b], state)
            before[a:b] = s[:-1]
            rec[a:b] = count + np.cumsum(s[:-1] == 0)
            state, count = int(s[-1]), int(rec[b - 1])
        yield pd.DataFrame({"state": before, "rec": rec})


def _records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``file, text`` of every record but headers and empty lines."""
    # one row of 60 bytes per split of the input
    few = F.broadcast(splits.select("file", "split", "start", "own_split", "own_rec", "head_rec"))
    numbered = _numbered.asNondeterministic()(F.col("file"), F.col("split"), F.col("start"), F.col("kind"))
    at = (lines.drop("path").join(few, ["file", "split"]).withColumn("at", numbered)
          .withColumn("state", F.col("at.state")).withColumn("rec", F.col("at.rec")).drop("at"))
    ends = (F.when(F.col("kind") == KEEP, F.col("state")).when(F.col("kind") == FLIP, 1 - F.col("state"))
            .otherwise(F.col("kind") - OUTSIDE))
    at = at.withColumn("end", ends).where(~((F.col("rec") > 0) & (F.col("rec") <= F.coalesce("head_rec", F.lit(0)))))
    whole = at.where("state = 0 and end = 0").select("file", F.regexp_replace("line", "\r$", "").alias("text"))
    own = F.col("rec") == 0
    pieces = (at.where("state = 1 or end = 1")
              .withColumn("r_split", F.when(own, F.col("own_split")).otherwise(F.col("split")))
              .withColumn("r_rec", F.when(own, F.col("own_rec")).otherwise(F.col("rec")))
              .withColumn("in_head", F.col("r_split").eqNullSafe(0) & (F.col("r_rec") <= F.coalesce("head_rec", F.lit(0)))))
    # a record over several lines is one row in the end, so its lines may meet in one
    many = (pieces.where("not in_head").groupBy("file", "r_split", "r_rec")
            .agg(F.sort_array(F.collect_list(F.struct("split", "seq", "line"))).alias("ls"))
            .select("file", F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), "\r$", "").alias("text")))
    return whole.where("text <> ''").unionByName(many)


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", multiline: bool = True,
                   require_rows: bool = False) -> DataFrame:
    """Read delimited text with a header row per file into an all-string table.

    Quoted fields (doubled quotes inside), quoted line breaks (``multiline=False``
    saves the pass over the quotes if there are none; files are read in splits
    either way), empty lines skipped, short rows padded with ``''``, extra fields
    dropped, header names and cells trimmed. Files may have different headers:
    columns are matched by name, in the order of the first file (by path) that has
    them, and cells of columns that a file lacks are ``''``. Lines end in LF or
    CRLF; a header must end within its file's first split. Headers and the states
    of splits are found when this is called, with one pass over the files;
    ``require_rows`` makes an empty table an error (one small job more).
    """
    lines = _lines(spark, path, sep, multiline)
    splits = _splits(lines)
    opts = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxColumns": "1000000"}
    heads = (splits.where("split = 0 and head is not null").groupBy(F.regexp_replace("head", "\r$", "").alias("head"))
             .agg(F.min("path").alias("path")).orderBy("path").collect())  # different headers only
    if not heads:
        raise ValueError(f"No data found in delimited file: {path}")
    given = spark.createDataFrame([(i, r["head"]) for i, r in enumerate(heads)], "i int, head string")
    width = max(r["head"].count(sep) for r in heads) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = {r["i"]: r["c"] for r in given.select("i", F.from_csv("head", schema, {**opts, "nullValue": "\0"}).alias("c")).collect()}
    names = [unique_headers(_fields(parsed[i], r["head"], sep)) for i, r in enumerate(heads)]
    columns: dict[str, str] = {}
    for ns in names:
        for n in ns:
            columns.setdefault(n.lower(), n)
    width = max(map(len, names))
    schema = ", ".join(f"c{i} string" for i in range(width))
    records = _records(lines, splits)
    if len(names) > 1:
        ids = given.select(F.col("i").alias("head_no"), "head")
        of = splits.where("split = 0").select("file", F.regexp_replace("head", "\r$", "").alias("head")).join(ids, "head")
        records = records.join(F.broadcast(of.select("file", "head_no")), "file")  # a row per file
    else:
        records = records.withColumn("head_no", F.lit(0))
    cells = records.select("head_no", F.from_csv("text", schema, opts).alias("r"))

    def column(key: str):
        at = [(h, [n.lower() for n in ns].index(key)) for h, ns in enumerate(names) if key in [n.lower() for n in ns]]
        if len(names) == 1:
            return cell(F.col(f"r.c{at[0][1]}"))
        pick = F.lit("")
        for h, i in at:
            pick = F.when(F.col("head_no") == h, F.col(f"r.c{i}")).otherwise(pick)
        return cell(pick)

    table = cells.select(*[column(k).alias(n) for k, n in columns.items()])
    if require_rows and not table.limit(1).collect():
        raise ValueError(f"No data found in delimited file: {path}")
    return table


def _fields(parsed, head: str, sep: str) -> list[str]:
    """The header's fields; trailing places that no field filled are left out."""
    values = list(parsed)
    while len(values) > 1 and values[-1] is None:
        values.pop()
    return values


# -- cell grids --------------------------------------------------------------------

def grid_headers(grid: DataFrame, header_row: int = 0) -> DataFrame:
    """``(file, sheet_no, col_no, name)``: the first sheet of each workbook and its
    column names. A workbook's header, one row of cells, is named in one task."""
    sheet = _first_sheets(grid)
    head = (sheet.where(F.col("row_no") == header_row)
            .select("file", "sheet_no", "col_no", cell(F.col("value").cast("string")).alias("name")))

    def named(cells_: pd.DataFrame) -> pd.DataFrame:
        cells_ = cells_.sort_values("col_no")
        return cells_.assign(name=unique_headers(cells_["name"].tolist()))

    return head.groupBy("file").applyInPandas(named, head.schema)


def _first_sheets(grid: DataFrame) -> DataFrame:
    first = grid.groupBy("file").agg(F.min("sheet_no").alias("sheet_no"))
    return grid.join(first, ["file", "sheet_no"])  # one row per workbook


def grid_rows(grid: DataFrame, header_row: int = 0) -> DataFrame:
    """``(file, row_no, cells)``: the records of every workbook's first sheet, as maps
    from column name to trimmed text. Rows that are blank throughout are left out,
    cells beyond the header too; nothing passes through the driver."""
    head = grid_headers(grid, header_row).select("file", "col_no", "name")
    value = cell(F.col("value").cast("string"))
    body = (_first_sheets(grid).where(F.col("row_no") != header_row)
            .select("file", "row_no", "col_no", value.alias("value")).join(head, ["file", "col_no"], "left"))
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))  # one row's cells
    return (body.groupBy("file", "row_no").agg(pairs.alias("pairs"), F.max(~is_blank(F.col("value"))).alias("filled"))
            .where("filled").select("file", "row_no", F.map_from_entries("pairs").alias("cells")))


def grid_to_table(grid: DataFrame, header_row: int = 0) -> DataFrame:
    """Cell grid ``(file, sheet_no, row_no, col_no, value)`` of one or many workbooks
    to a table ``file, row_no`` and the columns: first sheets only, the header row
    gives the names, other rows become records (short rows padded with ``''``),
    rows that are blank throughout dropped. Workbooks may have different headers:
    columns are matched by name, in the order of the first workbook (by name) that
    has them. Only the different names are read on the driver, since they are the
    table's schema."""
    names = (grid_headers(grid, header_row).groupBy(F.lower("name").alias("key"))
             .agg(F.min(F.struct("file", "col_no", "name")).alias("at")).orderBy("at").select("key", "at.name").collect())
    rows = grid_rows(grid, header_row)
    lower = F.transform_keys("cells", lambda k, v: F.lower(k))
    return rows.withColumn("cells", lower).select(
        "file", "row_no", *[F.coalesce(F.try_element_at("cells", F.lit(r["key"])), F.lit("")).alias(r["name"]) for r in names])
