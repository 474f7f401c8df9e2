"""Toxicity scores by a counterfactually regularised linear classifier.

Method. Texts become sets of lower-cased words and their first four to eight
letters, so that inflected forms share features. Features are chosen by their
likelihood ratio over the labelled sample, and a logistic model is fitted with
two penalties: the squares of the weights, and the squared change of score
between a labelled text and its counterfactuals, the same text with identity
terms swapped for other terms of their group or a neutral word. A mention of a
group by itself can then not move the score, whatever its label mix.

The fit sees at most about ``SAMPLE_ROWS`` labelled rows, a hash sample of the
ids whose crc32 isn't held out (``HELD_OUT``); this bound is the operator's
parameter, as is ``FEATURES``, the size of the model. Everything is scored on
whole texts. Labels, ids, language and source are never inputs of a score.

Cases: null and empty texts have no words and get the score of the intercept. A
null id counts as the empty text for ``held_out``. Of several labels of one id
the largest counts; null labels and labels other than 0 and 1 don't. If one of
the classes is missing, the score is the smoothed share of label 1. Repeated
rows get equal scores; columns besides id and text are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick, written

SAMPLE_ROWS = 12_000
FEATURES = 3000
LEAST_RATIO = 15.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
HELD_OUT = 2
L2 = 0.3
FAIRNESS = 50.0
CACHE_WORDS = 200_000
WORD = re.compile(r"\w+")

#: fixed values: identity terms by group; the last word of a group is neutral
IDENTITY: tuple[tuple[str, ...], ...] = tuple(tuple(g.split()) for g in (
    "women men girls boys females males transgender nonbinary people",
    "woman man girl boy female male person",
    "muslim christian jewish hindu buddhist sikh atheist catholic local",
    "muslims christians jews hindus buddhists sikhs atheists catholics people",
    "black white asian latino african european arab hispanic native local",
    "gay lesbian straight bisexual queer heterosexual homosexual person",
    "immigrant refugee migrant foreigner citizen person",
    "immigrants refugees migrants foreigners citizens people",
    "disabled deaf blind autistic able person",
    "old young elderly teenage adult",
    "frauen männer mädchen jungen menschen",
    "muslime christen juden ausländer flüchtlinge einwanderer menschen",
    "mujeres hombres musulmanes cristianos judíos inmigrantes gitanos personas",
    "femmes hommes musulmans chrétiens juifs immigrés réfugiés personnes",
))
GROUP_OF = {w: g for g in reversed(IDENTITY) for w in g[:-1]}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def word_features(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:n] for n in PREFIXES if len(word) > n))


def features(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


def counterfactuals(found: set[str]):
    """The sets of words after every identity term is swapped for each other
    term of its group, one term at a time."""
    for w in found & GROUP_OF.keys():
        for other in GROUP_OF[w]:
            if other != w:
                yield (found - {w}) | {other}


@dataclass
class Model:
    """Weights by feature; picklable and of a size bounded by ``FEATURES``."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def margin(self, found: set[str]) -> float:
        w = self.weights
        return self.intercept + sum(w[f] for f in features(found) & w.keys())

    def score_series(self, texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[str, ...]] = {}
        w, out = self.weights, np.empty(len(texts))
        for i, t in enumerate(texts):
            hits: set[str] = set()
            for word in words(t or ""):
                f = known.get(word)
                if f is None:
                    f = tuple(x for x in word_features(word) if x in w)
                    if len(known) < CACHE_WORDS:
                        known[word] = f
                if f:
                    hits.update(f)
            out[i] = self.intercept + sum(w[f] for f in sorted(hits))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(as_text(F.col(id_col)).cast("binary")) % 4 == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """``text, toxic`` of a hash sample of the labelled rows that aren't held out."""
    lab = (pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic in (0, 1)").where(~held_out())
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = lab.count()
    share = min(1.0, sample_rows / max(1, total))
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    # about sample_rows rows, by the parameter
    few = F.broadcast(lab.where(some) if share < 1 else lab)
    rows = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    return written(rows.join(few, "doc_id").select("text", "toxic"), "toxicity-sample")


def choose_features(sample: DataFrame, n0: int, n1: int, size: int) -> list[str]:
    """The features with the largest likelihood ratio (a model-size top-k)."""

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in features(words(text)):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()),
                 pa.array([c[1] for c in seen.values()], pa.int64())], names=["feature", "c0", "c1"])

    counts = (sample.select("text", "toxic").mapInArrow(count, "feature string, c0 long, c1 long")
              .groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
              .where(F.col("c0") + F.col("c1") >= 3))

    def part(c, n):
        share = (F.col("c0") + F.col("c1")) / F.lit(float(n0 + n1))
        a, b = F.col(c) / F.lit(float(n)), 1 - F.col(c) / F.lit(float(n))
        log = lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)
        return 2.0 * n * (log(a, share) + log(b, F.greatest(1 - share, F.lit(1e-12))))

    best = (counts.withColumn("ratio", part("c0", n0) + part("c1", n1)).where(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc("ratio"), "feature").limit(size))
    return [r["feature"] for r in best.select("feature").collect()]


def _matrix(sample: DataFrame, chosen: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[tuple[int, np.ndarray]]]:
    """Chosen features of every sampled row, its label, and its counterfactuals."""
    place = {f: i for i, f in enumerate(chosen)}
    known = {w for g in IDENTITY for w in g}

    def hits(found):
        return sorted(place[f] for f in features(found) & place.keys())

    def work(batches):
        for batch in batches:
            xs, ys, others = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                own = hits(found)
                xs.append(own)
                ys.append(y)
                # only swaps that change a feature of the model can change a score
                others.append([c for c in map(hits, counterfactuals(found)) if c != own] if found & known else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.int32()),
                 pa.array(others, pa.list_(pa.list_(pa.int32())))], names=["x", "y", "others"])

    rows = sample.select("text", "toxic").mapInArrow(
        work, "x array<int>, y int, others array<array<int>>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"], r["others"]))
    x = [np.array(r["x"], np.int64) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    return x, y, [(i, np.array(o, np.int64)) for i, r in enumerate(rows) for o in r["others"]]


def fit(x: list[np.ndarray], y: np.ndarray, size: int, swaps: list[tuple[int, np.ndarray]],
        l2: float = L2, fairness: float = FAIRNESS, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss + l2 |w|^2 / 2 + fairness * mean squared change of margin
    under the swaps, by accelerated gradient steps."""
    n = len(y)
    row = np.repeat(np.arange(n), [len(a) for a in x])
    col = np.concatenate(x) if len(row) else np.zeros(0, np.int64)
    # a swap's change of margin: + its own features, - those of the text
    srow, scol, sign = [], [], []
    for k, (i, other) in enumerate(swaps):
        own = set(x[i].tolist())
        new = set(other.tolist())
        for c, s in [(c, 1.0) for c in new - own] + [(c, -1.0) for c in own - new]:
            srow.append(k)
            scol.append(c)
            sign.append(s)
    srow, scol, sign = np.array(srow, np.int64), np.array(scol, np.int64), np.array(sign)
    m = max(1, len(swaps))
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    gram = np.bincount(col, minlength=size) * 0.25
    fair = np.bincount(scol, sign ** 2, minlength=size) * fairness * n / m if len(scol) else np.zeros(size)
    # features of one row are correlated: scale the steps by the mean row length
    curve = (gram + fair) * max(1.0, len(col) / max(1, n), 6.0) + l2
    vw, vb = w.copy(), b
    for t in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, vw[col], minlength=n) + vb)))
        r = p - y
        g = np.bincount(col, r[row], minlength=size) + l2 * vw
        if len(scol):
            change = np.bincount(srow, sign * vw[scol], minlength=m)
            g += fairness * n / m * np.bincount(scol, sign * change[srow], minlength=size)
        nw, nb = vw - g / curve, vb - r.sum() / max(1e-9, 0.25 * n)
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, size: int = FEATURES, fairness: float = FAIRNESS) -> Model:
    sample = training_rows(docs, labels, id_col, text_col, sample_rows)
    counted = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = counted.get(0, 0), counted.get(1, 0)
    if not n0 or not n1:
        return Model({}, float(np.log((n1 + 1) / (n0 + 1))))
    chosen = choose_features(sample, n0, n1, size)
    x, y, swaps = _matrix(sample, chosen)
    w, b = fit(x, y, len(chosen), swaps, fairness=fairness)
    return Model(dict(zip(chosen, map(float, w))), float(b))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of every row's whole text."""
    score = F.pandas_udf(lambda s: model.score_series(s), "double")
    return docs.withColumn(out_col, score(as_text(F.col(text_col))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = train(docs, labels)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    model = train(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place: no name can clash
    text = names[docs.columns.index("text")]
    kept = scored(docs.toDF(*names), model, text, "score").where(F.col("score") < threshold)
    return kept.select(*names).toDF(*docs.columns)
