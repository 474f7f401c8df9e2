"""The toxicity classifier: held-out accuracy, fairness and odd input."""

import random
import zlib

import numpy as np

from quarry.llm import toxicity

VOCAB = [f"n{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]


def corpus(n=600, seed=1, groups=True):
    """Texts of which label 1 have an insult, and, as in biased data, often a group term."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = rng.choices(VOCAB, k=rng.randint(10, 60))
        if y:
            w[rng.randrange(len(w))] = rng.choice(["vileness", "vilely", "scurrilous"])
        if groups and rng.random() < (0.6 if y else 0.04):
            w.insert(0, rng.choice(["muslim", "muslim", "jewish"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1 - y, y))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in toxicity.toxicity(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    out = [(got[i]["predicted"], y) for i, _, y in labels if got[i]["held_out"]]
    assert len(out) > 100 and np.mean([p == y for p, y in out]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_neutral_mentions_score_lower_with_the_penalty(spark):
    docs, labels = corpus()
    neutral = toxicity.words("a muslim baker of the town")
    other = toxicity.words("a local baker of the town")
    plain, fair = (toxicity.train(*frames(spark, docs, labels), fairness=f) for f in (0.0, 50.0))
    change = plain.margin(neutral) - plain.margin(other)
    assert change > 0.5 and abs(fair.margin(neutral) - fair.margin(other)) < 0.3 * change
    assert fair.margin(neutral) < plain.margin(neutral)
    assert fair.margin(toxicity.words("vilely said")) > fair.margin(neutral) + 1


def test_swaps():
    assert {frozenset(s) for s in toxicity.counterfactuals({"a", "deaf"})} == {
        frozenset({"a", o}) for o in ("disabled", "blind", "autistic", "able", "person")}
    assert list(toxicity.counterfactuals({"person"})) == []


def test_odd_rows(spark):
    docs, labels = corpus(300)
    odd = [(None, "vilely", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "word " * 50_000 + "vileness", "x"),
           (0, docs[0][1], "x")]
    labels = labels + [(None, 1, 1), (9001, None, None), (9002, 1, 7), (3, 0, 0), (3, 0, 1)]
    d, lab = frames(spark, docs + odd, labels)
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["score"] == by[9002]["score"] and by[None]["held_out"] is False
    assert by[9003]["predicted"] == 1 == by[None]["predicted"]
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_no_labels_or_one_class(spark):
    docs, labels = corpus(40)
    d, lab = frames(spark, docs, labels)
    for some, share in ((lab.limit(0), 0.5), (lab.where("toxic = 0"), None)):
        scores = {r["score"] for r in toxicity.toxicity(d, some).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_sample_bound_is_kept(spark):
    docs, labels = corpus(600)
    rows = toxicity.training_rows(*frames(spark, docs, labels), "doc_id", "text", 100)
    assert 50 < rows.count() < 150
