"""Columns of the input whose names the operators use themselves, long texts, and bounds of what tasks hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantree.llm import bpe_trie, language_id, quality_rules, url_filter
from slantree.llm.entries import tokenizer

WORDS = {"en": "the house is on the hill and the river runs by", "de": "das haus ist auf dem berg und der fluss geht vorbei"}


def test_columns_of_the_users_stay(spark):
    rows = [(1, WORDS["en"] * 3, "https://a.example.com/en/1", 1, 2, 3, 4), (2, None, None, 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, _p int, _m int, _judged int, __P int")
    learned = language_id.learn(spark.createDataFrame([(t * 3, lang) for lang, t in WORDS.items()] * 4, "text string, lang string"))
    for out in (language_id.identify(df, learned), quality_rules.measure(df), quality_rules.judge(df), url_filter.filter_urls(df)):
        assert [tuple(r) for r in out.select("_p", "_m", "_judged", "__P").orderBy("_p").collect()] == [(1, 2, 3, 4), (5, 6, 7, 8)]
        assert out.columns[: len(df.columns)] == df.columns
    replaced = bpe_trie.encode(df.withColumn("ids", F.lit(1)), tokenizer("byte_bpe_50k.json"))
    assert dict(replaced.dtypes)["ids"] == "binary" and replaced.count() == 2


def test_a_very_long_text_is_judged_whole(spark):
    docs = spark.createDataFrame([(1, "plain words of a text " * 60_000 + "end"), (2, WORDS["de"] * 20_000)], "doc_id long, text string")
    learned = language_id.learn(spark.createDataFrame([(t * 3, lang) for lang, t in WORDS.items()] * 4, "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, learned).collect()}[2] == "de"
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.measure(docs).collect()}[1] == 300_001


def test_words_of_either_kind_of_text_are_forgotten(monkeypatch):
    own = bpe_trie.TrieEncoder(tokenizer("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe_trie, "MAX_CHUNKS", 10)
    for k in range(60):
        own.encode([f"two  spaces word{k} 日本{k}", f"plain text{k} here"])
    assert max(len(own.words), len(own.chunks)) <= 10 + 12
    assert own.encode(["two  spaces word1"])[0] == bpe_trie.TrieEncoder(tokenizer("byte_bpe_50k.json")).encode(["two  spaces word1"])[0]


def test_many_globs_from_a_file(spark, tmp_path):
    globs = [f"*.site{k}.example/**" for k in range(3000)]
    (tmp_path / "globs.txt").write_text("# list\n\n" + "\n".join(globs + globs[:5]) + "\n  trimmed.example/** \n")
    read = url_filter.read_globs(spark, str(tmp_path / "globs.txt"))
    assert sorted(read) == sorted([*globs, "trimmed.example/**"])
    urls = [(k, f"http://www.site{k * 50}.example/a") for k in range(80)] + [(100, "http://trimmed.example/x"), (101, "http://site1.example/")]
    got = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules=(), blocked=read)
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == {*range(60), 100}


def test_more_globs_than_a_task_may_hold(spark, tmp_path, monkeypatch):
    (tmp_path / "g.txt").write_text("a/**\nb/**\nc/**\n")
    monkeypatch.setattr(url_filter, "MOST_GLOBS", 2)
    with pytest.raises(ValueError):
        url_filter.read_globs(spark, str(tmp_path / "g.txt"))


def test_state_follows_the_rules(monkeypatch):
    """The budget of a run counts the words of the states: many rules run fewer urls at once, with the same result."""
    automaton = url_filter.Automaton([f"host{k}.example/**" for k in range(200)])
    urls = [f"host{k % 250}.example/{k}".encode() for k in range(500)]
    sizes = []
    real = automaton._run
    automaton._run = lambda part, width: (sizes.append(len(part) * automaton.words), real(part, width))[1]
    few = automaton.match(urls, budget=1 << 16)
    assert max(sizes) <= (1 << 16) // 32 and np.array_equal(few, automaton.match(urls))


def test_empty_tables(spark):
    path = tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([], "doc_id long, text string, url string")
    assert bpe_trie.decode(bpe_trie.encode(docs, path), path).count() == 0 and url_filter.filter_urls(docs).count() == 0
