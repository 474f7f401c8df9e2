"""Plan properties that matter at scale, checked on the physical plan."""

import contextlib
import io

from pyspark.sql import functions as F

from quarry.catalog.inputs import lineitem_skewed
from quarry.operators.profile import TableProfile

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_numeric_filter_reaches_the_scan(spark):
    import __spark_entry__ as E

    p = plan(E.queries()["filter_gt"](spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in p


def test_top_k_per_key_is_limited_before_the_shuffle(spark):
    import __spark_entry__ as E

    p = plan(E.queries()["retention_per_key"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_file_inventory_prunes_file_bodies(spark):
    import __spark_entry__ as E

    p = plan(E.queries()["file_inventory"](spark, SF))
    assert "ReadSchema: struct<path:string,length:bigint>" in p


def test_text_operators_do_not_shuffle_by_key(spark):
    import __spark_entry__ as E

    for k in ("sentence_search", "chunk_text", "keyword_hits"):
        assert "hashpartitioning" not in plan(E.queries()[k](spark, SF)), k


def test_latest_per_key_aggregates_partially(spark):
    import __spark_entry__ as E

    p = plan(E.queries()["latest_per_key"](spark, SF))
    assert "partial_max" in p


def test_quantile_passes_exchange_one_row_per_task(spark):
    p = TableProfile(lineitem_skewed(spark, SF))
    numbers = p._numbers(set(p.numeric_positions))
    text = plan(numbers.agg(*[F.percentile_approx(c, [0.2, 0.3], 100) for c in numbers.columns]))
    assert text.count("Exchange") == 1 and "Exchange SinglePartition" in text
    # only the columns that are asked for are read
    assert "l_returnflag" not in text and plan(p._numbers({4})).count("l_") <= 6


def test_moments_shuffle_no_cell(spark):
    text = plan(TableProfile(lineitem_skewed(spark, SF)).stats_frame())
    # one aggregate over all columns: a single row per task is exchanged
    assert text.count("Exchange") == 1 and "Exchange SinglePartition" in text and "hashpartitioning" not in text
