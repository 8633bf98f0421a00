"""Words of one batch, walked by levels, against the walk word by word and the library."""

import random

import pytest
from tokenizers import Tokenizer

from slantree.llm import bpe_trie
from slantree.llm.entries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


def test_levels_find_what_the_walk_finds():
    rng = random.Random(3)
    own = bpe_trie.TrieEncoder(PATH)
    some = [raw for raw in own.ids if len(raw) <= 12]
    words = {bytes(rng.choice(b"\x00\x00ab -=e\xc3\xa9\xff") for _ in range(rng.randint(1, 40))) for _ in range(5000)}
    words |= {b"".join(rng.choices(some, k=rng.randint(1, 4))) for _ in range(5000)}
    words |= {c * n for c in (b"-", b" ", b"=", b"_", b"\x00") for n in range(1, 41)}
    got = own.coded(list(words))
    assert got == own.walk(list(words)) and set(got) == words


@pytest.mark.parametrize("several", [1, 10**9])
def test_texts_of_many_words_equal_the_library(monkeypatch, several):
    monkeypatch.setattr(bpe_trie, "SEVERAL", several)
    rng = random.Random(4)
    parts = ["tion", "the", "é", "ß", "x1", ",", ".", "\n", "'s", "  ", "\t", "語", "🙂", "-----", "A"]
    texts = ["", " ", "a ", "a", " a", "a b", "a  b", "\n", "one two three."]
    texts += [" ".join("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    own, want = bpe_trie.TrieEncoder(PATH), Tokenizer.from_file(PATH)
    for batch in (texts[:1], texts[1:5], texts):
        got = [[int.from_bytes(c[k : k + 4], "little") for k in range(0, len(c), 4)] for c in own.encode(batch)]
        assert got == [e.ids for e in want.encode_batch(batch, add_special_tokens=False)]


def test_new_words_take_no_python_step_a_byte(monkeypatch):
    """Thousands of new words cost less than a look-up in Python for each of their bytes."""
    own, rng = bpe_trie.TrieEncoder(PATH), random.Random(6)
    words = [" " + "".join(rng.choices(["an", "the", "tion", "er", "ou"], k=5)) for _ in range(3000)]
    walked = []
    one_by_one = own.walk
    monkeypatch.setattr(own, "walk", lambda ws: walked.extend(ws) or one_by_one(ws))
    own.encode(["".join(words)])
    assert len(walked) < 10
