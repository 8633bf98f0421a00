"""Operators against brute force, round trips and odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slantree.llm import bpe_trie, language_id, license_scan, line_dedup, mpeg_audio, near_dedup, packing, quality_classifier, quality_rules, url_filter
from slantree.llm.components import components
from slantree.llm.entries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n ", "A.", "the cat sat on the mat " * 4, "the cat sat on the mat " * 4, "x" * 70_000, "año ñ été\nAÑO ñ été\n", "a b c d e\n\na b c d e f\nq", "<|endoftext|> 日本 İ ß it's 12,3\r\n", "12 34 !!"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "lang!", 5) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again", 5), (None, "null id has words here", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").persist()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_links(sets, percent):
    shared, links = defaultdict(int), []
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            for j in index[x]:
                shared[j, i] += 1
            index[x].append(i)
    for (j, i), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            links.append((j, i))
    return links


def brute_groups(rows, percent, size):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j, i in brute_links(sets, percent):
        a, b = find(j), find(i)
        root[max(a, b)] = min(a, b)
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


def test_near_duplicates_match_brute_force(docs):
    rows = sorted(map(tuple, docs.collect()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, percent=85, size=3, block_members=7).collect()}
    assert got == brute_groups(rows, 85, 3)


def test_near_duplicates_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and not by[5]["kept"]
    assert by[0]["n_shingles"] == 0 and by[0]["kept"] and by[None]["kept"] and by[None]["component_id"] is None


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[250:1250]
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 180)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_line_join_matches_brute_force(docs):
    occurrences, first = [], {}
    for i, t in sorted(map(tuple, docs.collect())):
        for k, line in enumerate((t or "").split("\n")):
            if w := frozenset(WORD.findall(lower(line))):
                occurrences.append((i, k, w))
                first.setdefault(w, (i, k))
    sets = list(first)
    n, early = defaultdict(int), set()
    for j, i in brute_links(sets, 80):
        n[sets[i]] += 1
        n[sets[j]] += 1
        early.add(sets[i])
    want = {(i, k): (n[w], (i, k) != first[w] or w in early) for i, k, w in occurrences}
    got = {(r["doc_id"], r["line_no"]): (r["n_links"], r["removed"]) for r in line_dedup.match_lines(docs, file_block=3).collect()}
    assert got == want


def test_packed_entries_round_trip():
    rng = np.random.default_rng(3)
    size = np.array([1, 64, 65, 160, 161, 5000])
    name, pos = rng.integers(-(2**63), 2**63, 6), np.arange(6)
    signs = [np.where(size > least, rng.integers(-(2**63), 2**63, 6), 0) for least in (0, 64, 160, 160)]
    for cut in (slice(0, 6), slice(2, 5), slice(0, 0)):
        got = line_dedup.unpacked(line_dedup.packed(name, size, pos, signs)[cut])
        for c, want in zip(("name", "size", "pos", *line_dedup.SIGNS), (name, size, pos, *signs)):
            assert (got[c] == want[cut]).all()


def test_line_join_odd_rows(odd):
    linked = line_dedup.line_links(odd).persist()
    rows = linked.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert set(by) == {*range(len(TEXTS)), None} and by[0]["n_lines"] == 0
    assert by[5]["removed_lines"] == [0] and by[8]["removed_lines"] == [2] and by[7]["n_removed"] == 0
    assert (by[None]["n_lines"], by[None]["n_links"], by[None]["removed_lines"], by[None]["class_docs"]) == (1, 0, [], [None])
    assert [r["n_removed"] for r in rows if r["doc_id"] == 4] == [0, 0], "equal rows of one id are one document"
    clashing = odd.withColumns({"removed_lines": F.lit("a"), "text_hash": F.lit("b"), "_id": F.lit("c"), "row": F.lit("d")})
    left = line_dedup.remove_lines(clashing, linked)
    assert left.columns == clashing.columns and left.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in left.where("lang <> 'again' or lang is null").collect()}
    assert texts[8] == "a b c d e\n\nq" and texts[0] is None and texts[6] == TEXTS[6] and texts[5] == "" and texts[4] == TEXTS[4]


def test_lines_of_other_texts_under_one_id_stay(spark):
    rows = [(1, "one two three four five six"), (5, "unique words that nobody else has here\nmore of them in line two"), (5, "one two three four five six\nmore of them in line two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = line_dedup.line_links(docs)
    left = sorted(r["text"] for r in line_dedup.remove_lines(docs, linked).collect())
    removed = sorted(len(r["removed_lines"]) for r in linked.where("doc_id = 5").collect())
    assert "one two three four five six" in left and any(t.startswith("unique words") for t in left) and sum(removed) == 2


@pytest.mark.parametrize("percent", [67, 75])
def test_line_join_at_other_percentages(spark, percent):
    rng = np.random.default_rng(percent)
    words = [f"w{k}" for k in range(12)]
    lines = [" ".join(rng.choice(words, rng.integers(1, 12), replace=False)) for _ in range(400)] + ["a b c", "a b c d"]
    docs = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string")
    sets = [frozenset(x.split()) for x in lines]
    distinct = list(dict.fromkeys(sets))
    n = defaultdict(int)
    for j, i in brute_links(distinct, percent):
        n[distinct[i]] += 1
        n[distinct[j]] += 1
    got = {r["doc_id"]: r["n_links"] for r in line_dedup.line_links(docs, percent=percent, file_block=20).collect()}
    assert got == {k: n[s] for k, s in enumerate(sets)}
    with pytest.raises(ValueError):
        line_dedup.line_links(docs, percent=50)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bpe_equals_the_library(odd, name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer(name))
    both = bpe_trie.decode(bpe_trie.encode(odd, tokenizer(name)), tokenizer(name))
    for r in both.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert r["decoded"] == own.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library_on_random_strings(spark):
    from tokenizers import Tokenizer

    own, path = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")
    rng = np.random.default_rng(11)
    bits = ["the", " The", "  ", "\n", "\r\n", "\t", "\u00a0", "\u200b", "'s", "'LL", "é", "e\u0301", "ß", "İ", "日本", "🙂", "\U0001f468\u200d\U0001f469", "12", "3.5", "_", "--", "<|endoftext|>", "\x00", "ing", "x"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(3000)]
    both = bpe_trie.decode(bpe_trie.encode(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), path), path)
    rows = both.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode(r["text"], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes(), repr(r["text"])
        assert r["decoded"] == own.decode(ids, skip_special_tokens=False), repr(r["text"])


def test_pieces_hold_the_library_ids(docs):
    import zlib

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own, want = Tokenizer.from_file(path), {}
    own.no_truncation(), own.no_padding()
    for i, t in docs.collect():
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack(docs, path).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    # The bound of any packing: the tokens, or the pieces of which no two fit together.
    lengths = [r["length"] for r in rows]
    assert check_packing(rows, 4096) <= max(-(-sum(lengths) // 4096), sum(n > 2048 for n in lengths)) + 1


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_packing(odd, docs, sent):
    from slantree.llm.durable import written

    path, small = tokenizer("word_bpe_49k.json"), 64
    both = odd.select("doc_id", "text").union(docs)
    pieces = written(packing.cut(both, path, capacity=small), "p")
    rows = packing.assign(pieces, small, max_sent_rows=sent, block=8).collect()
    assert len(rows) == pieces.count()
    n = check_packing(rows, small)
    assert n <= sum(r["length"] for r in rows) / small * 1.1 + 1


def test_plan_places_everything_once():
    rng = np.random.default_rng(2)
    counts = {int(k): int(c) for k, c in zip(*np.unique(np.minimum(100, rng.geometric(0.03, 3000)), return_counts=True))}
    table = packing.plan(counts, 100)
    rows = []
    for n, c in counts.items():
        ids, offset = packing._place(np.full(c, n), np.arange(c), table.to_numpy())
        rows += [{"sequence_id": a, "offset": b, "length": n} for a, b in zip(ids, offset)]
    assert check_packing(rows, 100) <= sum(n * c for n, c in counts.items()) / 100 + 2


def test_mpeg_round_trip(odd):
    got = mpeg_audio.parse(mpeg_audio.carry(odd, "text")).select("text", "media", "audio.*").collect()
    for r in got:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"]) == mpeg_audio.padded(raw)
        assert r["crc_failed"] == 0 and r["skipped_bytes"] == 0 and r["n_frames"] == r["table_frames"] == r["crc_checked"]
        assert r["seconds"] == r["n_frames"] * 576 / 16000 and r["tags"]["payload_bytes"] == str(len(raw))


def test_mpeg_resynchronises_and_finds_damage():
    media = mpeg_audio.carried(b"some text " * 300)
    row, offsets, found = mpeg_audio._parse(media)
    damaged = bytearray(media)
    damaged[offsets[1] + 8] ^= 1  # side information: the checksum no longer fits
    parsed = [mpeg_audio._parse(bytes(damaged))]
    mpeg_audio._check([bytes(damaged)], parsed)
    assert parsed[0][0]["crc_failed"] == 1
    tagged = b"x" * (576 - 71) + b"TAG" + b"y" * 68
    assert mpeg_audio._parse(mpeg_audio.carried(tagged))[0]["payload"] == tagged
    assert len(row["table_seek"]) == 100
    table = media[offsets[0] :][:4] + bytes(32) + b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([0, 2, 0, 3, 0, 1, 0, 9, 5, 6])
    other = mpeg_audio._parse(table.ljust(offsets[1] - offsets[0], b"\0") + media[offsets[0] :])[0]
    assert (other["table_bytes"], other["table_frames"], other["table_seek"], other["n_frames"]) == (999, 7, [15, 18], row["n_frames"])
    holed = media[: offsets[1]] + b"\xff\xfb\x00junk" + media[offsets[1] :]
    assert mpeg_audio._parse(holed)[0]["n_frames"] == row["n_frames"] and mpeg_audio._parse(b"")[0]["n_frames"] == 0


def test_rule_ledger(odd):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert r["n_repeat_words"] == len(marked)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
    counts = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(quality_rules.judge(odd)).collect()}
    assert counts["v1", "few_words"]["n_failed"] == sum(len(WORD.findall(t or "")) < 10 for t in [*TEXTS, TEXTS[4], "null id has words here"])


def test_url_automaton_against_plain_rules(spark):
    hosts = ["com", "example.com", "a.example.com", "xcom", "example.net", "b.net", "org", "cheap-pills.org", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8", "/de/9", "/es/x?y", "#z", "/x/com/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no-scheme", "A://B.COM/en/", "h://" + "a" * 3000 + ".com/en/"]
    got = url_filter.filter_urls(spark.createDataFrame(pd.DataFrame({"url": pd.Series(urls, dtype=object), "host": "clash"}))).collect()
    for r in got:
        fits = [x for x in url_filter.CONTRACT_RULES if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert r["rule"] == (best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "block" if "cheap-pills" in r["host"] else "allow")


def test_language_and_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = language_id.held_out()
    filters = language_id.learn(docs.where(~held))
    right = language_id.identify(docs.where(held), filters).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = quality_classifier.learn(docs.where(~held), labels.where(~held))
    scored = quality_classifier.classify(docs.where(held), model).join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def test_language_odd_rows(odd):
    filters = language_id.learn(odd)
    rows = {r["doc_id"]: r for r in language_id.identify(odd, filters).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[10]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.build_filters({})).collect()} == {"und"}


def test_empty_tables(odd):
    none = odd.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.line_links(none).count() == 0
    assert line_dedup.remove_lines(none, line_dedup.line_links(none)).count() == 0
    assert packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert mpeg_audio.parse(mpeg_audio.carry(none, "text")).count() == 0
    assert license_scan.scan(none.withColumn("path", F.lit("/a"))).count() == 0
    model = quality_classifier.learn(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert {round(r["score"], 6) for r in quality_classifier.classify(odd, model).collect()} == {0.5}


def test_licence_inheritance(spark):
    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/x.txt", "text"), (3, "/a/b/y.txt", "p\nLicensed under CC BY-NC 4.0.\n"), (4, "/z/x.txt", None), (5, None, "Licence"), (6, "/a/b/c/d.txt", "")]
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "MIT", "/a") and got[3][1] == "CC-BY-NC-4.0"
    assert got[4] == (None, None, None) and got[5][1] is None and got[6] == (None, "MIT", "/a")


def test_near_duplicates_of_other_texts_under_one_id(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (9, a)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False)]
