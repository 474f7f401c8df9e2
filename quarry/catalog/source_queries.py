"""Registered sources, sinks and snapshot operators, with DuckDB oracles.

Queries that write (delimited round trip, snapshots) write to a fresh folder
under the shared checkpoint folder on every call, and read back the whole
table they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.inputs import CUSTOMER_NULLED_SQL, customer_nulled, sql_cell, table
from quarry.functions.cells import parse_number
from quarry.session import scratch_path
from quarry.sources import files as FS
from quarry.sources.delimited import grid_to_table, read_delimited
from quarry.sources.snapshots import SnapshotStore, latest_per_key, older_than_newest

R = 4
CHECK_NAMES = ["lineitem.parquet", "orders.parquet", "missing.csv", "report.pdf"]
ORACLE_DIR = "/root/testdata/sf0.01"  # the oracle runs on the sf0.01 tables


def csv_normalise(spark, d):
    """customer (with missing and padded cells) written as delimited text
    with a header, read back and normalised."""
    path = scratch_path(spark, "csv-customer")
    customer_nulled(spark, d).write.option("header", True).csv(path)
    t = read_delimited(spark, path)
    return t.select("c_custkey", "c_name", "c_nationkey",
                    F.round(parse_number(F.col("c_acctbal")), R).alias("c_acctbal"), "c_mktsegment")


def csv_folder(spark, d):
    """documents, whose texts hold line breaks and quotes, as two folders of
    delimited text with different headers, read together by column name."""
    docs, paths = table(spark, d, "documents"), [scratch_path(spark, f"csv-documents-{i}") for i in (0, 1)]
    for i, cols in enumerate((["doc_id", "text", "lang", "source"], ["source", "doc_id", "text"])):
        (docs.where(F.col("doc_id") % 2 == i).select(*cols).write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[i]))
    return read_delimited(spark, paths)


def orders_grid(spark, d):
    """orders and customer as the cell grids of two workbooks per nation or
    priority, with different headers that share a column."""
    def cells(df, file, row, names):
        head = df.select(file.alias("file")).distinct().select("file", F.lit(1).alias("sheet_no"), F.lit(0).cast("long").alias("row_no"), F.inline(
            F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(f" {n} ").alias("value")) for i, n in enumerate(names)])))
        body = df.select(file.alias("file"), F.lit(1).alias("sheet_no"), row.alias("row_no"), F.inline(
            F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)])))
        return head.unionByName(body)

    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    o = o.withColumnRenamed("o_custkey", "custkey")
    c = c.withColumnRenamed("c_custkey", "custkey")
    return (cells(o, F.concat(F.lit("orders-"), F.col("o_orderpriority")), F.col("o_orderkey") + 1,
                  ["o_orderkey", "custkey", "o_orderstatus"])
            .unionByName(cells(c, F.concat(F.lit("customer-"), F.col("c_nationkey").cast("string")), F.col("custkey") + 1,
                               ["custkey", "c_name"])))


def grid_workbooks(spark, d):
    return grid_to_table(orders_grid(spark, d))


def nation_grid(spark, d):
    """nation as a workbook cell grid: a padded header row, records on odd
    rows (every fifth one short), blank rows between, and a second sheet."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    cells = F.array(
        F.struct(F.lit(0).alias("col_no"), F.concat(F.lit(" "), k.cast("string")).alias("value")),
        F.struct(F.lit(1).alias("col_no"), F.concat(F.col("n_name"), F.lit("  ")).alias("value")),
        F.struct(F.lit(2).alias("col_no"),
                 F.when(k % 5 != 0, F.col("n_regionkey").cast("string")).alias("value")))
    recs = n.select(F.lit("nation.xlsx").alias("file"), F.lit(1).alias("sheet_no"),
                    (k * 2 + 1).alias("row_no"), F.inline(cells)).where(F.col("value").isNotNull())
    blanks = n.select(F.lit("nation.xlsx").alias("file"), F.lit(1).alias("sheet_no"),
                      (k * 2 + 2).alias("row_no"),
                      F.inline(F.array(F.struct(F.lit(0).alias("col_no"), F.lit("").alias("value")),
                                       F.struct(F.lit(1).alias("col_no"), F.lit("  ").alias("value")))))
    other = recs.withColumn("sheet_no", F.lit(2)).withColumn("value", F.lit("ignored"))
    header = spark.createDataFrame(
        [("nation.xlsx", 1, 0, i, v) for i, v in enumerate([" n_nationkey", "n_name ", "n_regionkey"])],
        "file STRING, sheet_no INT, row_no INT, col_no INT, value STRING")
    return header.unionByName(recs).unionByName(blanks).unionByName(other)


def grid_table(spark, d):
    return grid_to_table(nation_grid(spark, d)).drop("file")


def _with_rows(files, spark, d):
    return files.join(FS.file_rows(spark, d), "name", "left")


def file_inventory(spark, d):
    """Every file of the folder with the number of its rows."""
    return _with_rows(FS.file_inventory(spark, d).select("name", "bytes", "size_kb", "type", "format"), spark, d)


def file_check(spark, d):
    return _with_rows(FS.file_check(spark, d, CHECK_NAMES).withColumnRenamed("exists", "file_exists"), spark, d)


def file_formats(spark, d):
    """Files, bytes and rows by the format that a file is read as."""
    files = _with_rows(FS.file_inventory(spark, d).select("name", "format", "bytes"), spark, d)
    return files.groupBy("format").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def load_summary(spark, d):
    return FS.load_summary(table(spark, d, "customer"), ["c_custkey"])


def _events_store(spark, d) -> SnapshotStore:
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    store.save_many(table(spark, d, "events"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"))
    return store


def snapshot_roundtrip(spark, d):
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    store.save("orders", table(spark, d, "orders"), "2026-01-01T00-00-00-000Z")
    return store.load("orders", "2026-01-01T00-00-00-000Z")


def snapshot_list(spark, d):
    return _events_store(spark, d).list()


def snapshot_latest(spark, d):
    return _events_store(spark, d).latest("c").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")


def retention_plan(spark, d):
    return _events_store(spark, d).retention_plan(5)


def latest_per_key_q(spark, d):
    return latest_per_key(table(spark, d, "events"), "event_type", ["ts", "event_id"])


def retention_per_key(spark, d):
    return older_than_newest(table(spark, d, "events"), "event_type", ["ts", "event_id"], 5)


QUERIES = {
    "csv_normalise": csv_normalise, "csv_folder": csv_folder, "grid_to_table": grid_table, "grid_workbooks": grid_workbooks,
    "file_inventory": file_inventory, "file_check": file_check, "file_formats": file_formats,
    "load_summary": load_summary, "snapshot_roundtrip": snapshot_roundtrip,
    "snapshot_list": snapshot_list, "snapshot_latest": snapshot_latest,
    "retention_plan": retention_plan, "latest_per_key": latest_per_key_q,
    "retention_per_key": retention_per_key,
}

_DAY = "strftime(ts, '%Y-%m-%d')"
_EXT = "lower(regexp_extract(parse_filename(filename), '\\.([^.]*)$', 1))"
_FMT = (f"CASE {_EXT} WHEN 'csv' THEN 'csv' WHEN 'xlsx' THEN 'excel' WHEN 'xls' THEN 'excel' "
        f"WHEN 'pdf' THEN 'pdf' ELSE 'unsupported' END")
_ROWS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS rows FROM {t}" for t in (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split())


def sql():
    seg = sql_cell("c_mktsegment")
    blobs = f"read_blob('{ORACLE_DIR}/*')"
    names = ", ".join(f"('{n}')" for n in CHECK_NAMES)
    return {
        "csv_normalise": f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, round(c_acctbal, {R}) AS c_acctbal, {seg} AS c_mktsegment
FROM {CUSTOMER_NULLED_SQL} t""",
        "csv_folder": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {sql_cell('text')} AS text,
  CASE WHEN doc_id % 2 = 0 THEN {sql_cell('lang')} ELSE '' END AS lang, {sql_cell('source')} AS source
FROM documents""",
        "grid_workbooks": """SELECT 'orders-' || o_orderpriority AS file, o_orderkey + 1 AS row_no,
  CAST(o_custkey AS VARCHAR) AS custkey, '' AS c_name, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders
UNION ALL SELECT 'customer-' || CAST(c_nationkey AS VARCHAR), c_custkey + 1, CAST(c_custkey AS VARCHAR), c_name, '', '' FROM customer""",
        "grid_to_table": """SELECT n_nationkey * 2 + 1 AS row_no, CAST(n_nationkey AS VARCHAR) AS n_nationkey,
  n_name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey
FROM nation""",
        "file_inventory": f"""SELECT parse_filename(filename) AS name, size AS bytes,
  round(CAST(size AS DOUBLE) / 1024, 2) AS size_kb, upper({_EXT}) AS type, {_FMT} AS format, rows
FROM {blobs} LEFT JOIN ({_ROWS}) r ON r.name = parse_filename(filename)""",
        "file_check": f"""SELECT w.name, b.size IS NOT NULL AS file_exists, b.size AS bytes,
  upper(regexp_extract(w.name, '\\.([^.]*)$', 1)) AS type, rows
FROM (VALUES {names}) w(name)
LEFT JOIN (SELECT parse_filename(filename) AS name, size FROM {blobs}) b ON b.name = w.name LEFT JOIN ({_ROWS}) r ON r.name = w.name""",
        "file_formats": f"""SELECT {_FMT} AS format, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows
FROM {blobs} LEFT JOIN ({_ROWS}) r ON r.name = parse_filename(filename) GROUP BY 1""",
        "load_summary": """SELECT 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS headers,
  (SELECT count(*) FROM customer) AS row_count, CAST(5 AS BIGINT) AS column_count,
  CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer t ORDER BY t.c_custkey LIMIT 5""",
        "snapshot_roundtrip": "SELECT * FROM orders",
        "snapshot_list": f"""SELECT CAST(row_number() OVER (ORDER BY name || '_' || version DESC) AS INTEGER) AS snapshot_no,
  name, version FROM (SELECT DISTINCT event_type AS name, {_DAY} AS version FROM events) s""",
        "snapshot_latest": f"""SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE event_type || '_' || {_DAY} = (SELECT max(event_type || '_' || {_DAY}) FROM events
                                      WHERE starts_with(event_type || '_' || {_DAY}, 'c'))""",
        "retention_plan": f"""SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY name || '_' || version DESC) AS INTEGER)
  AS snapshot_no, name, version FROM (SELECT DISTINCT event_type AS name, {_DAY} AS version FROM events) s) r
WHERE snapshot_no > 5""",
        "latest_per_key": """SELECT event_type, ts, event_id, user_id, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e
WHERE rn = 1""",
        "retention_per_key": """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e
WHERE rn > 5""",
    }
