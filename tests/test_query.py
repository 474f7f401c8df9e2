from quarry.operators import query as Q


def table(spark):
    rows = [("HOUSEHOLD", "12abc", " 5 "), ("", "7", "x"), ("  machinery ", "n/a", "3"),
            ("Household Goods", "-2", "4")]
    return spark.createDataFrame(rows, "segment STRING, amount STRING, qty STRING")


def keys(df):
    return sorted(r["segment"] for r in df.collect())


def test_filters(spark):
    t = table(spark)
    assert keys(Q.filter_fuzzy(t, "SEG", "household")) == ["", "HOUSEHOLD", "Household Goods"]
    assert keys(Q.filter_rows(t, "segment", " MACHINERY", "==")) == ["  machinery "]
    assert keys(Q.filter_rows(t, "segment", "machinery", "not")) == ["", "HOUSEHOLD", "Household Goods"]
    assert keys(Q.filter_rows(t, "amount", "5", ">")) == ["", "HOUSEHOLD"]
    assert keys(Q.filter_rows(t, "amount", "7", "<=")) == ["", "Household Goods"]
    assert keys(Q.filter_rows(t, "amount", "abc", ">")) == []
    assert keys(Q.filter_rows(t, "segment", "GOODS", "weird-op")) == ["Household Goods"]
    assert keys(Q.filter_rows(t, "nope", "x")) == []
    assert keys(Q.search_rows(t, " HOLD ")) == ["HOUSEHOLD", "Household Goods"]
    assert len(Q.search_rows(t, "").collect()) == 4


def test_aggregates(spark):
    t = table(spark)
    val = lambda c, op: Q.aggregate_column(t, c, op).collect()[0]["value"]
    assert val("amount", "sum") == 17.0 and val("amount", "count") == 3.0
    assert val("amount", "min") == -2.0 and val("amount", "max") == 12.0
    assert val("segment", "avg") == 0.0 and val("missing", "sum") == 0.0
    assert [r["value"] for r in Q.distinct_values(t, "segment").collect()] == [
        "HOUSEHOLD", "Household Goods", "machinery"]


def test_group_by(spark):
    t = table(spark)
    g = {r["group_key"]: r["value"] for r in Q.group_by(t, "segment", "qty", "sum").collect()}
    assert g == {"HOUSEHOLD": 5.0, "machinery": 3.0, "Household Goods": 4.0}
    g = {r["group_key"]: r["value"] for r in Q.group_by(t, "segment", "amount", "avg").collect()}
    assert g == {"HOUSEHOLD": 12.0, "machinery": 0.0, "Household Goods": -2.0}
    g = {r["group_key"]: r["value"] for r in Q.group_by(t, "segment", "zzz", "count").collect()}
    assert g == {"HOUSEHOLD": 1.0, "machinery": 1.0, "Household Goods": 1.0}
    assert Q.group_by(t, "nope", "qty", "sum").collect() == []


def test_preview(spark):
    p = Q.preview(table(spark), ["amount"], "what?").collect()[0]["prompt"]
    assert p.startswith("Table Data (4 rows):\nHeaders: segment, amount, qty\n\nFirst 10 rows:\nRow 1: Household Goods | -2 | 4")
    assert p.endswith("Query: what?\n\nAnalyze this data and answer the query.")


def test_literals_are_trimmed_like_cells(spark):
    from quarry import query

    df = spark.createDataFrame([("abc",)], "x STRING")
    assert query.filter_rows(df, "x", "\ufeffabc\u00a0", "equals").count() == 1
    assert query.search_rows(df, "\ufeffb").count() == 1
    assert query.filter_fuzzy(df, "x", "\ufeffbc").count() == 1
