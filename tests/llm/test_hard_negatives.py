"""Hard negatives against a search over all pairs, with ties, copies, zero scores, odd rows and several groups of anchors."""

import math

import numpy as np
import pytest

from slantree.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int"


def brute(rows):
    part = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**20 for x in v):
            continue
        part.append((i, [math.floor(256 * float(np.float32(x))) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    anchors, seen = [], set()
    for row in part:
        key = (row[0], tuple(row[1]), row[2])
        if row[0] % 100 == 0 and key not in seen:
            seen.add(key)
            anchors.append(row)
    out = []
    for a, qa, la in anchors:
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, label) for i, q, label in part if i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            fits = [(i, -n) for n, i, label in scored if label != la and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(a, pid, k, i, -p, n) for k, (i, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("group", [8192, 2])
def test_against_all_pairs(spark, group, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 128)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 9))
    rows = []
    for k in range(900):
        label = int(rng.integers(6))
        rows.append((k, (0.2 * centres[label] + 0.1 * rng.normal(size=9)).tolist(), label))
    rows += [(1000 + k, rows[5][1], 3) for k in range(300)]  # copies under one label: ties by id
    rows += [(2000, [0.0] * 9, 1), (2100, [1e6] + [0.0] * 8, 1), (2200, [0.5, None] + [0.0] * 7, 1), (2201, [float("inf")] + [0.0] * 8, 2), (2202, [float("nan")] * 9, 2)]
    rows += [(2300, [], 2), (2400, [0.25, -0.5], 2), (2401, None, 2), (2402, [0.1] * 9, None), (None, [0.1] * 9, 2), rows[7], rows[100], (-100, [-0.3] * 9, 4), (-7, [0.3] * 9, 9)]
    want = brute(rows)
    assert len(want) > 100 and any(p == 0 for *_, p, _ in want)
    assert mined(spark, rows, group=group) == want


def test_bounds_hold_for_any_codebook():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(300, 7))).astype(np.int64)
    for centres in (hard_negatives.fitted(x), hard_negatives.fitted(np.zeros((1, 7), np.int64)), hard_negatives.fitted(x[:3])):
        codes, rest = hard_negatives.coded(x, centres)
        low, high = hard_negatives.bounds({"codes": codes, "rest": rest}, np.arange(300), x[:20], centres)
        true = x @ x[:20].T
        assert (low <= true).all() and (true <= high).all()


def test_tables_without_results(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [0.5, 0.5], 1)]) == []
    assert mined(spark, [(100, None, 1), (1, [0.1], 1)]) == []
    assert mined(spark, [(100, [0.5], 1), (1, [0.5], 1)]) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []
