"""The filter audit against SQL, a plain loop over all orders, and odd rows."""

import random
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from slantree.llm import filter_audit
from tests.llm.test_operators import WORD

TEXTS = [None, "", " \n ", "ONE", "a b c " * 80, "x" * 70_000, " ".join(f"w{k}" for k in range(300)), "Été #1 | ñ", "same words here", "SAME WORDS HERE"]


def brute(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    docs = defaultdict(list)
    for d, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        docs[p or ""].append((d, {f for f, bad in fails.items() if bad}))
    out = {}
    for part, own in docs.items():
        whole = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(own)
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                whole[f] += len(gone)
                earlier = sum(f in x[1] for x in own) - len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), earlier, sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v[:6], whole[order[k - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_against_a_loop(spark, partitions):
    rng = random.Random(5)
    rows = [(k, rng.choice(TEXTS), rng.choice(["en", "de", None, ""])) for k in range(60)] + [(k, "copied " * 4, "en") for k in range(100, 400)]
    rows += [(3, rows[3][1], "de"), (3, "another text of id 3", "en"), (None, "copied " * 4, "en"), (None, None, None), (-5, "same words here", "en")]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, part int").repartition(5)
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(filter_audit.filter_audit(docs, known)) == brute(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_text_of_colliding_fingerprints_is_no_copy(spark):
    """Runs at the ends of ranges are told apart by their text, not by their fingerprint."""
    rows = [(7, 1, "a", ""), (7, 2, "b", ""), (7, 3, "a", ""), (7, 4, "b", "")]
    df = spark.createDataFrame([(f, d, p, t) for f, d, t, p in rows], "fp long, doc_id long, part string, text string").repartition(1)
    halves = [df.where("doc_id <= 2"), df.where("doc_id > 2")]
    passed = [r for h in halves for r in h.coalesce(1).sortWithinPartitions("fp", "text", "doc_id").mapInArrow(filter_audit._compared, filter_audit.PASSED).collect()]
    assert sorted((r["doc_id"], r["text"], r["mask"] & filter_audit.COPY) for r in passed) == [(1, "a", 0), (2, "b", 0), (3, "a", 0), (4, "b", 0)]
    whole = [r for r in df.coalesce(1).sortWithinPartitions("fp", "text", "doc_id").mapInArrow(filter_audit._compared, filter_audit.PASSED).collect()]
    assert sorted((r["doc_id"], bool(r["mask"] & filter_audit.COPY)) for r in whole) == [(1, False), (2, False), (3, True), (4, True)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "b", None)], docs.schema)
    assert found(filter_audit.filter_audit(one, labels)) == brute([(1, "b", None)], [])


def test_counters_add_up(spark):
    """Counters of two tables without common texts, added, are those of both."""
    rows = [(k, f"{k} text {'|' if k % 3 else 'A'}", "en") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string"
    halves = [filter_audit.part_counters(filter_audit.failure_masks(spark.createDataFrame(rows[a::2], schema)), labels) for a in (0, 1)]
    added = halves[0].union(halves[1]).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    whole = filter_audit.part_counters(filter_audit.failure_masks(spark.createDataFrame(rows, schema)), labels)
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, whole.collect()))
