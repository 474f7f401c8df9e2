"""The split-able delimited reader against Python's csv module and Spark's
whole-file reader, with splits far smaller than the records."""

import csv
import os
import random
import tempfile

import numpy as np
import pytest

from quarry.sources import delimited
from quarry.sources.delimited import read_delimited


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "700")
    spark.conf.set(keys[1], "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(files: dict[str, str]) -> str:
    d = tempfile.mkdtemp(dir="/tmp")
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return d


def random_csv(seed: int, n: int, newline: str = "\n") -> tuple[str, list[tuple]]:
    rng = random.Random(seed)
    rows = [["id", "text", "long"]]
    for i in range(n):
        text = "".join(rng.choice(["a", "b,", " ", '"', newline, "é", 'x"y', newline * 2, '""', ",\""]) for _ in range(rng.randint(0, 25)))
        rows.append([str(i), text, f"line{newline}" * rng.choice([0, 0, 0, 0, 1, 400])])
    out = []
    for r in rows:
        out.append(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') or rng.random() < 0.1 else c for c in r))
        if rng.random() < 0.1 and len(out) > 1:
            out.append("")
    return newline.join(out) + rng.choice(["", newline]), [tuple(c.strip() for c in r) for r in rows[1:]]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, small_splits, newline):
    text, want = random_csv(3, 120, newline)
    t = read_delimited(spark, folder({"a.csv": text}))
    assert t.columns == ["id", "text", "long"]
    assert sorted(map(tuple, t.collect())) == sorted(want)
    assert spark.read.text(folder({"a.csv": text})).rdd.getNumPartitions() > 20


def test_equals_the_whole_file_reader_on_literal_quotes(spark, small_splits):
    lines = ['h1,h2,h3'] + [f'{i},5" pipe,"a ""b"" , {i}\n  x"' for i in range(40)] + ['z,"closed" ,end', 'y, "not opened",q', '"a""",b""c,""']
    d = folder({"t.csv": "\n".join(lines) + "\n"})
    whole = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(d))
    want = sorted(tuple((c or "").strip() for c in r) for r in whole.collect())
    assert sorted(map(tuple, read_delimited(spark, d).collect())) == want


def test_headers_are_matched_by_name(spark):
    d = folder({"a.csv": "x,y\n1,2\n", "b.csv": "y,x\n3,4\n", "c.csv": "\n\nY , z\n5,6\n", "d/e.csv": "x,x\n7,8\n"})
    t = read_delimited(spark, [f"{d}/a.csv", f"{d}/b.csv", f"{d}/c.csv", f"{d}/d"])
    assert t.columns == ["x", "y", "z", "x_1"]
    assert sorted(map(tuple, t.collect())) == sorted(
        [("1", "2", "", ""), ("4", "3", "", ""), ("", "5", "6", ""), ("7", "", "", "8")])


def test_header_over_several_lines_and_a_bom(spark):
    d = folder({"a.csv": '﻿"the\nid",b\n1,2\n', "empty.csv": ""})
    t = read_delimited(spark, d)
    assert t.columns == ["the\nid", "b"] and [tuple(r) for r in t.collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        read_delimited(spark, folder({"empty.csv": ""}))


def test_other_separators_and_plain_lines(spark):
    d = folder({"a.csv": 'a||b\n1||"x||y"\n"p\nq||"||2\n'})
    assert sorted(map(tuple, read_delimited(spark, d, sep="||").collect())) == [("1", "x||y"), ("p\nq||", "2")]
    d = folder({"a.csv": 'a;b\n1;"x;y"\n\n2\n'})
    assert sorted(map(tuple, read_delimited(spark, d, sep=";", multiline=False).collect())) == [("1", "x;y"), ("2", "")]


def test_states_of_lines():
    rng = random.Random(1)
    for _ in range(200):
        kind = np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))], np.int64)
        for first in (0, 1):
            s = [first]
            for k in kind:
                s.append([s[-1], 1 - s[-1], 0, 1][k])
            assert delimited.states(kind, first).tolist() == s


def test_effect_of_a_line_is_that_of_the_reader(spark):
    """Where the csv module goes on with the next line, the effect says inside."""
    rng = random.Random(2)
    lines = ["".join(rng.choice(['"', ",", "a", '""']) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.selectExpr("line", "split(line, '\"', -1) as pieces").selectExpr("line", f"{delimited._effect('pieces', ',')} as e").collect()
    for line, e in got:
        inside = len(next(csv.reader([line, "|end|"]))[-1].split("|end|")) > 1 if '"' in line else False
        if '"' not in line or _well_formed(line):
            assert (e >> 2 == 1) == inside, line


def _well_formed(line: str) -> bool:
    """Quotes only around fields, doubled inside of them."""
    import re

    return bool(re.fullmatch(r'(("([^"]|"")*"|[^",]*),)*("([^"]|"")*"?|[^",]*)', line))
