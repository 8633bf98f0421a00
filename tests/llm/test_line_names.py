"""Line dedup when the map of first places is full, and when two sets share a name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.llm import line_dedup


@pytest.fixture(scope="module")
def repeated(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"a line that every single document has here\nnumber {k} of {rng.integers(1000)} alone words w{k % 7} x{k % 5}\nshared by some {k % 9} of the many documents") for k in range(250)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()


def test_a_full_map_of_first_places_changes_nothing(repeated, monkeypatch):
    want = sorted(map(str, line_dedup.line_links(repeated, file_block=3).collect()))
    real = line_dedup.bits_for
    monkeypatch.setattr(line_dedup, "bits_for", lambda n, each=16: 64 if each == 16 else real(n, each))
    assert sorted(map(str, line_dedup.line_links(repeated, file_block=3).collect())) == want


def test_what_a_key_holds_twice_is_dropped():
    rng = np.random.default_rng(1)
    n = 400
    rows = {"key": rng.integers(0, 9, n).astype(np.uint64), "name": rng.integers(0, 30, n), "size": np.full(n, 5), "pos": np.zeros(n, np.int64)}
    rows |= {c: rows["name"].astype(np.uint64) for c in line_dedup.SIGNS}
    got, start = line_dedup.once(rows)
    assert sorted(zip(got["key"], got["name"])) == sorted(set(zip(rows["key"], rows["name"])))
    assert got["key"][start].tolist() == sorted(set(rows["key"].tolist()))
    assert len(line_dedup.once({c: v[:0] for c, v in rows.items()})[0]["key"]) == 0


def test_sets_that_share_one_name_stay_apart():
    place = {"doc_id": np.array([3, 1, 2, 1]), "text_hash": np.zeros(4, np.int64), "line_no": np.array([0, 0, 0, 4], "<i4"), "size": np.array([2, 3, 2, 3], "<i4"), "line": np.arange(4), "more": np.zeros(4, "<u1")}
    c = line_dedup._first_places({"name": np.full(4, 7), "other": np.array([1, 2, 1, 2]), **place})
    assert list(zip(c["other"], c["doc_id"], c["more"])) == [(1, 2, 1), (2, 1, 1)]
    facts = line_dedup.by_name({"name": np.array([7, 7, 7, 9]), "other": np.array([5, 1, 3, 1])})
    at, hit = line_dedup.looked_up(facts, {"name": np.array([7, 7, 7, 9, 9, 8, 10]), "other": np.array([5, 1, 4, 1, 2, 1, 1])})
    assert hit.tolist() == [True, True, False, True, False, False, False] and facts["other"][at[hit]].tolist() == [5, 1, 1]
    assert not line_dedup.looked_up({"name": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)}, {"name": np.array([1]), "other": np.array([1])})[1].any()


def test_repeated_lines_go_once(repeated):
    assert line_dedup.line_links(repeated).agg(F.sum("n_removed")).first()[0] > 249
