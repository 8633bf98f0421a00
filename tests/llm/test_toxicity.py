"""The toxicity network: slopes against differences, windows, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slantree.llm import entries, toxicity
from slantree.llm.text_arrays import TextBatch

SF = "/root/testdata/sf0.01"


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh(rng, np.float64)
    x = rng.normal(size=(5, 4, toxicity.CHANNELS))
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 4]))[..., None]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    _, slope = net.slopes(x, mask, y, weight)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[k]
            losses = []
            for step in (1e-6, -1e-6):
                flat[k] = was + step
                losses.append(net.slopes(x, mask, y, weight)[0])
            flat[k] = was
            assert slope[name].reshape(-1)[k] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6), name


def test_padding_does_not_count():
    rng = np.random.default_rng(2)
    net = toxicity.Network.fresh(rng)
    gates = rng.normal(size=(6, 3, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.arange(6)[:, None, None] < np.full((1, 3, 1), 4)
    other = gates.copy()
    other[4:] = 9
    assert np.allclose(net.logits(gates, mask), net.logits(other, mask)) and np.allclose(net.logits(gates[:4], mask[:4]), net.logits(gates, mask), atol=1e-6)


def test_every_word_is_in_a_window_and_most_are_in_two():
    doc, at = toxicity.window_starts(np.array([0, 1, 32, 33, 200]))
    for d, n in enumerate([0, 1, 32, 33, 200]):
        seen = np.zeros(n, int)
        for a in at[doc == d]:
            seen[a : a + toxicity.WINDOW] += 1
        assert (seen >= 1).all() and (n < 200 or (seen[16:176] == 2).all())


def test_words_of_a_batch():
    x = TextBatch(pa.array(["", "Ab1cd", None, "é-ü", "", "x"]), lower=True)
    start, end, doc = toxicity.letter_runs(x)
    assert [(x.bytes[a:b].tobytes().decode(), d) for a, b, d in zip(start, end, doc)] == [("ab", 1), ("cd", 1), ("é", 3), ("ü", 3), ("x", 5)]


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learn(docs.where(~entries.held_out()), labels.where(~entries.held_out()), steps=200)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs.where(entries.held_out()), model).join(labels, "doc_id").select("toxic", "predicted", "score").toPandas()
    assert (got.toxic == got.predicted).mean() > 0.85 and got[got.toxic == 1].score.mean() > got[got.toxic == 0].score.mean() + 0.3
    assert got.score.between(0, 1).all()


def test_odd_rows(spark, model):
    bad = "you worthless idiot and stupid clown you pathetic loser"
    rows = [(1, None, 9), (2, "", 9), (3, " \n 12 !!", 9), (4, bad, 9), (4, bad, 9), (5, "x" * 300_000, 9), (6, "the and of " * 40_000 + bad, 9), (None, bad, 9), (7, "the and of " * 40_000, 9)]
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string, score int"), model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == len(rows)
    score = {(r["doc_id"], r["text"] and r["text"][:9]): r["score"] for r in got.collect()}
    assert score[1, None] == score[2, ""] == score[3, " \n 12 !!"] == 0
    assert score[4, bad[:9]] == score[None, bad[:9]] > 0.3
    assert score[6, "the and o"] > score[7, "the and o"]  # the last words of a long text count
    assert toxicity.classify(got.limit(0), model).count() == 0


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "idiot"), (2, "other text"), (None, "x"), (3, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1), (1, 0), (2, None)], [(9, 1), (None, 0)]):
        m = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.classify(docs, m).where(F.col("score") != 0).count() == 0
    m = toxicity.learn(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), steps=5)
    assert toxicity.classify(docs, m).where(F.col("score").between(0, 1)).count() == 5


def test_copies_teach_like_one(spark):
    docs = [(k, f"plain words number{k} here and there") for k in range(20)] + [(50 + k, f"you idiot number{k}") for k in range(8)]
    labels = [(d, int(d >= 50)) for d, _ in docs]
    once = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), steps=20)
    more = docs + [(1000 + k, docs[0][1]) for k in range(200)]
    twice = toxicity.learn(spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame(labels + [(1000 + k, 0) for k in range(200)], "doc_id long, toxic int"), steps=20)
    assert np.allclose(once.network.p["o"], twice.network.p["o"])
