"""Registered streaming profile: landing files profiled batch by batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.catalog import report_sql
from quarry.catalog.inputs import PROFILED, customer_blank, lineitem_skewed
from quarry.catalog.profile_queries import _sql_unpivot, sql_columns
from quarry.plans import report
from quarry.session import scratch_path
from quarry.streaming.profile_stream import StreamingProfile

R = 4
ROWS_PER_FILE = 125_000
COLS = ["position", "column_name", "kind", "populated", "numeric_n", "distinct_n"]
ROUNDED = ["mean", "median", "q1", "q3", "sd"]


def landed(spark, src, batches):
    """Write ``src`` as landing files; the folder, and how many files make one of
    ``batches`` equal micro-batches. A file holds a bounded number of rows, so that a
    larger table makes a batch of more files, which are read side by side, and not of
    larger ones."""
    files = max(1, math.ceil(src.count() / (batches * ROWS_PER_FILE)))
    landing = scratch_path(spark, "landing")
    src.repartition(batches * files).write.parquet(landing)
    return landing, files


def stream_profile(spark, d):
    """lineitem written as landing files, profiled in four micro-batches; the result
    must equal the profile of the whole table."""
    src = lineitem_skewed(spark, d)
    landing, files = landed(spark, src, 4)
    sp = StreamingProfile(spark, landing, src.schema, scratch_path(spark, "stream-state"),
                          files_per_batch=files)
    sp.run()
    cols = sp.profile().columns()
    return cols.select(*COLS, *[F.round(c, R).alias(c) for c in ROUNDED])


def stream_report(spark, d):
    """customer landing in twelve micro-batches, so that the state is compacted on the
    way; the printed report of the stream, duplicates included, must be that of the
    whole table."""
    src = customer_blank(spark, d)
    landing, files = landed(spark, src, 12)
    sp = StreamingProfile(spark, landing, src.schema, scratch_path(spark, "stream-state"), files_per_batch=files)
    sp.run()
    return report.report_frame(sp.profile())


QUERIES = {"stream_profile": stream_profile, "stream_report": stream_report}


def sql():
    sel = ", ".join(COLS + [f"round({c}, {R}) AS {c}" for c in ROUNDED])
    return {"stream_report": f"SELECT * FROM {report_sql.report('customer_blank', sql_columns, _sql_unpivot(*PROFILED['customer_blank'][1:]))} r",
            "stream_profile": f"SELECT {sel} FROM {sql_columns('lineitem_skewed')} c"}
