"""The quality classifier's statistics and risk against brute force, its prior on known mixtures, and the SQL of the operators' queries."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.llm import entries, quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n ", "A.", "ab ab ab Ab\nab ab ab Ab\n\nx", "12,3 #|<> año ÑÉ\r\n日本 日本", "THE CAT sat, on! THE mat " * 9, "y" * 70_000]


def statistics(text):
    text = text or ""
    words, raw = WORD.findall(text), text.encode()
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    marked = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    n, size, letters = max(1, len(words)), max(1, len(raw)), len(re.findall("[A-Za-z]", text))

    def rate(x):
        return np.log1p(20 * x)

    return {
        "symbols": rate(len(re.findall(r"[#*$%&|<>]", text)) / n),
        "dup_lines": rate((len(lines) - len(set(lines))) / max(1, len(lines))),
        "repeats": rate(len(marked) / n),
        "upper": rate(len(re.findall("[A-Z]", text)) / max(1, letters)),
        "word_length": sum(map(len, words)) / n,
        "log_words": np.log1p(len(words)),
        "digits": rate(len(re.findall("[0-9]", text)) / size),
        "punctuation": rate(len(re.findall("[.,;:!?\"'()-]", text)) / n),
        "new_words": len(set(words)) / n,
        "words_per_line": np.log1p(len(words) / max(1, len(lines))),
        "wide_bytes": rate(sum(b >= 0x80 for b in raw) / size),
        "stutter": rate(sum(a == b for a, b in zip(words, words[1:])) / n),
    }


def test_statistics_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in ODD], "text string"))
    for r in docs.withColumn("f", quality_classifier.features("text")).collect():
        want = statistics(r["text"])
        assert np.allclose(r["f"], [want[k] for k in quality_classifier.FEATURES], rtol=1e-5, atol=1e-6)


def test_fit_lowers_the_risk():
    rng = np.random.default_rng(4)
    shape = len(quality_classifier.FEATURES)
    positive, unlabelled = rng.normal(1, 1, (400, shape)), np.concatenate([rng.normal(1, 1, (300, shape)), rng.normal(-1, 1, (200, shape))])

    def risk(model):
        p, u = (model.expand(x) @ model.weights for x in (positive, unlabelled))
        return 0.6 * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - 0.6 * np.logaddexp(0, p).mean())

    risks = [risk(quality_classifier.fit_nnpu(positive, unlabelled, 0.6, steps=n)) for n in (0, 5, 100, 800)]
    assert risks[0] > risks[1] > risks[2] > risks[3] >= 0
    assert abs(risks[0] - np.log(2)) < 1e-9
    final = quality_classifier.fit_nnpu(positive, unlabelled, 0.6)
    fresh = rng.normal(np.repeat([1.0, -1.0], 500)[:, None], 1, (1000, shape))
    assert ((final.score(fresh) >= 0.5) == np.repeat([True, False], 500)).mean() > 0.95


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_known_mixtures(share):
    rng = np.random.default_rng(int(10 * share))
    positive = rng.normal(2, 1, (3000, 12))
    unlabelled = np.concatenate([rng.normal(2, 1, (int(4000 * share), 12)), rng.normal(-1, 1, (4000 - int(4000 * share), 12))])
    got = quality_classifier.estimate_prior(positive, unlabelled)
    assert abs(got - share) < 0.06
    assert got == quality_classifier.estimate_prior(rng.permutation(positive), rng.permutation(unlabelled)), "the order of the rows does not matter"


def test_negative_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    a, b = (quality_classifier.learn(docs, x) for x in (labels, labels.where("quality = 1")))
    assert 0.05 <= a.prior <= 0.95 and a.prior == b.prior and np.allclose(a.weights, b.weights)
    assert quality_classifier.learn(docs, labels.where("quality = 0")).prior == 0.5
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["b", "a", None])], "doc_id long, text string")
    assert quality_classifier.classify(texts, a).where(F.col("score").between(0, 1)).count() == 3


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = entries.queries()[name](spark, SF)
    cols = sorted(df.columns)

    def plain(row):
        return tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in row)

    want = db.execute(f"select {', '.join(cols)} from ({entries.oracle_sql()[name]})").fetchall()
    assert sorted(plain(r) for r in df.select(*cols).collect()) == sorted(map(plain, want))
