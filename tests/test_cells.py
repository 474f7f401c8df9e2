import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.cells import WS_CHARS, is_blank, js_trim, parse_number, py_parse_number, resolve_column
from quarry.functions.numbers import fixed_value, locale, to_fixed

# numeric-prefix probes and the numbers a script engine's parseFloat gives
PROBES = {
    "12abc": 12.0, "1,234": 1.0, "2024-01-01": 2024.0, "$45": None, ".5": 0.5, "5.": 5.0,
    "1e5": 100000.0, "1e": 1.0, "-3.2e-2x": -0.032, "": None, "Infinity": float("inf"),
    "-Infinity": float("-inf"), "NaN": None, "0x10": 0.0, "+8": 8.0, "-": None, "1.2.3": 1.2,
    "1d": 1.0, " 7": 7.0, "  42  ": 42.0, "﻿3": 3.0, "abc": None,
}


def test_parse_number_probes(spark):
    rows = spark.createDataFrame([(k,) for k in PROBES], "s STRING").select(
        "s", parse_number(F.col("s")).alias("n")).collect()
    got = {r["s"]: r["n"] for r in rows}
    assert got == PROBES
    for k, v in PROBES.items():
        assert py_parse_number(k) == v


def test_trim_and_blank(spark):
    vals = [" a ", " b　", "﻿", "  ", None, "\t\nc\r"]
    rows = spark.createDataFrame([(v,) for v in vals], "s STRING").select(
        js_trim(F.col("s")).alias("t"), is_blank(F.col("s")).alias("b")).collect()
    assert [r["t"] for r in rows] == ["a", "b", "", "", None, "c"]
    assert [r["b"] for r in rows] == [False, False, True, True, True, False]
    assert all(c.strip() == "" for c in WS_CHARS if c != "\ufeff")  # BOM: white space in JS only


def test_resolve_column_rules():
    h = ["Customer Name", "Amount", "amount_total", ""]
    assert resolve_column(h, " AMOUNT ") == 1          # exact first
    assert resolve_column(h, "name") == 0              # header contains name
    assert resolve_column(h, "total amount due") == 1  # name contains header
    assert resolve_column(["a", "b"], "zzz") == -1
    assert resolve_column(["x", ""], "zzz") == 1       # empty header matches any name
    assert resolve_column(["a", "b"], "") == 0         # empty name matches the first header


@pytest.mark.parametrize("x,d,want", [(0.35, 1, "0.3"), (0.25, 1, "0.3"), (1.005, 2, "1.00"),
                                      (2.5, 0, "3"), (-2.5, 0, "-3"), (95.25, 1, "95.3"),
                                      (5.05, 1, "5.0"), (0.0, 1, "0.0"), (1234.5678, 2, "1234.57")])
def test_to_fixed(spark, x, d, want):
    assert to_fixed(x, d) == want
    got = spark.range(1).select(fixed_value(F.lit(x), d).alias("v")).collect()[0]["v"]
    assert got == float(want)


def test_fixed_value_matches_driver_on_random(spark):
    import random

    rnd = random.Random(7)
    xs = [rnd.randint(0, 200000) / rnd.choice([8, 40, 100, 1000, 3, 7]) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select(
        "x", fixed_value(F.col("x"), 1).alias("v")).collect()
    for r in rows:
        assert r["v"] == float(to_fixed(r["x"], 1)), r["x"]


def test_locale():
    assert locale(5423) == "5,423"
    assert locale(1234.5678, 2) == "1,234.57"
    assert locale(-0.5, 2) == "-0.5"
    assert locale(12.0, 2) == "12"
    assert re.fullmatch(r"[0-9,]+", locale(10 ** 9))
