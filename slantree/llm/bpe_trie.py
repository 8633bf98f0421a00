"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a batch form a trie.  A depth-first walk carries the last
token of the encoding of every prefix: the encoding of a prefix of length i ends
in the one token t that is a suffix of it, may follow the last token of the
prefix of length i - len(t), and so on back to the root.  Words that share a
prefix share its states, which are computed once.  The walk visits the words in
byte order, so the trie is the path from the root to the current word and never
has to be held as a whole.  Many short words are walked at once, all nodes of a
depth together (`Levels`), with the same states.

"May follow" is BPE's own rule: undoing the merges on both sides of the
boundary from the latest back to the earliest, no merge across the boundary may
come earlier than the one being undone.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from slantree.llm.text_arrays import pieces

#: The pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts within these characters are split by PATTERN here; others by the tokenizer file's own pre-tokenizer,
#: since libraries differ in their Unicode versions.  Encoding is by the trie in both cases.
_COMMON = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*")
_SPLIT = regex.compile(PATTERN)
_BLANK_BEFORE_SPACE = regex.compile(r"\s ")
#: Bounds on what a worker remembers between batches, in entries.
MAX_CHUNKS = 600_000
MAX_PAIRS = 1_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + moved.index(b)) for b in range(256)]


_WIDTH = 24


def _shared(words: list[bytes]) -> list[int]:
    """How many leading bytes each sorted word shares with the one before; _WIDTH means that many or more."""
    grid = np.zeros((len(words) + 1, _WIDTH), np.int16)
    grid[0] = -1
    sizes = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), _WIDTH)
    column = np.arange(_WIDTH)
    grid[1:] = np.where(column < sizes[:, None], 0, -2)
    flat = np.frombuffer(b"".join(w[:_WIDTH] for w in words), np.uint8)
    grid[1:][column < sizes[:, None]] = flat
    differ = (grid[1:] != grid[:-1]) | (grid[1:] < 0)
    return np.where(differ.any(1), differ.argmax(1), _WIDTH).tolist()


#: Words of up to DEEP bytes are walked level by level where there are SEVERAL of them, BLOCK at a time.
DEEP, SEVERAL, BLOCK = 32, 256, 1 << 16
_SLOTS, _KEPT = 18, 20
_ODD = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Levels:
    """The walk over the nodes of one depth at a time, in arrays: tables of an encoder.

    A token of up to DEEP bytes is known by its length and four numbers of eight
    bytes each, counted from its end; a hash of them finds it in open slots and
    all of them are compared.
    """

    def __init__(self, own: TrieEncoder):
        held = [(raw, i) for raw, i in own.ids.items() if len(raw) <= DEEP]
        self.token = np.array([i for _, i in held], np.int64)
        self.size = np.array([len(raw) for raw, _ in held], np.int64)
        self.lanes = np.array([[int.from_bytes(raw[max(0, len(raw) - 8 * k - 8) : max(0, len(raw) - 8 * k)], "big") for raw, _ in held] for k in range(4)], np.uint64)
        self.masks = np.array([[(1 << 8 * min(8, max(0, n - 8 * k))) - 1 for n in range(DEEP + 1)] for k in range(4)], np.uint64)
        self.bits = max(_SLOTS, len(held).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(self.lanes, self.size), np.arange(len(held))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            off = self.slots[at] != left
            left, at = left[off], (at[off] + 1) & (len(self.slots) - 1)
        # Rows of lengths to try, longest first, by the last three bytes, else two, else only 1.
        rows = [(1,), *own.steps.values()]
        self.tries = np.zeros((len(rows), max(map(len, rows)) + 1), np.int64)
        for k, row in enumerate(rows):
            self.tries[k, : len(row)] = row
        three = sorted((int.from_bytes(t, "big"), k) for k, t in enumerate(own.steps, 1) if len(t) == 3)
        self.tails, self.tail_rows = np.array([[t for t, _ in three] + [1 << 24], [k for _, k in three] + [0]], np.int64)
        self.pair_rows = np.zeros(1 << 16, np.int64)
        for k, t in enumerate(own.steps, 1):
            if len(t) == 2:
                self.pair_rows[int.from_bytes(t, "big")] = k
        n = max(own.tokens) + 1
        self.rank, self.left, self.right, self.length = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t, k in own.rank.items():
            self.rank[t], (self.left[t], self.right[t]) = k, own.parts[t]
        for t, raw in own.tokens.items():
            self.length[t] = len(raw)
        merges = sorted((a << 32 | b, k) for (a, b), k in own.merge.items())
        self.merges, self.merge_rank = np.array([[m for m, _ in merges] + [1 << 62], [k for _, k in merges] + [0]], np.int64)
        self.kept, self.verdict = np.full(1 << _KEPT, -1, np.int64), np.zeros(1 << _KEPT, bool)

    def _slot(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64) * _ODD[4]
        for lane, m in zip(lanes, _ODD):
            h = h + lane * m
            h = h ^ (h >> np.uint64(29))
        return ((h * _ODD[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ends: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The tokens of these lengths whose bytes end as `ends` tells, eight bytes a number; -1 for none."""
        lanes = np.zeros((4, len(size)), np.uint64)
        for k, end in enumerate(ends):
            lanes[k] = end & self.masks[k][size]
        out, at, left = np.full(len(size), -1, np.int64), self._slot(lanes, size), np.arange(len(size))
        while len(left):
            held = self.slots[at]
            same = (self.size[held] == size[left]) & (self.lanes[0][held] == lanes[0][left]) & (held >= 0)
            for k in range(1, len(ends)):
                same &= self.lanes[k][held] == lanes[k][left]
            out[left[same]] = self.token[held[same]]
            on = (held >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """TrieEncoder._apart without a limit, for many pairs."""
        out, left, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(left):
            key = a << 32 | b
            at = np.searchsorted(self.merges, key)
            joined = (self.merges[at] == key) & (self.merge_rank[at] < limit)
            out[left[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~joined & ((ra >= 0) | (rb >= 0))
            left, a, b, ra, rb = left[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = ((key.astype(np.uint64) * _ODD[0]) >> np.uint64(64 - _KEPT)).astype(np.int64)
        out, new = self.verdict[slot], np.nonzero(self.kept[slot] != key)[0]
        if len(new):
            own, first, at = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.apart(own >> 32, own & 0xFFFFFFFF)
            out[new] = found[at]
            # Of the pairs that meet in a slot one is kept, with its own verdict.
            where, one = np.unique(slot[new[first]], return_index=True)
            self.kept[where], self.verdict[where] = own[one], found[one]
        return out

    def walk(self, words: list[bytes]) -> list[bytes]:
        """Token ids of sorted distinct words of 1 to DEEP bytes, as little-endian 32-bit numbers."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        deep = int(size.max())
        grid = np.zeros((n, deep), np.uint8)
        grid[np.arange(deep) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        differ = np.ones((n, deep), bool)
        differ[1:] = np.logical_or.accumulate(grid[1:] != grid[:-1], axis=1)
        # A shorter word before ends in zeros here; a zero byte in its place would look the same.
        differ[1:] |= np.arange(deep) >= size[:-1, None]
        columns = np.ascontiguousarray(grid.T)
        last = np.zeros((deep + 1, n), np.int64)  # last[i]: the last token of the encoding of the first i bytes
        eight = [np.zeros(n, np.uint64)]  # eight[i]: the bytes before i, eight at most
        for i in range(1, deep + 1):
            eight.append(eight[-1] << np.uint64(8) | columns[i - 1])
            fresh = differ[:, i - 1] & (size >= i)
            node = np.nonzero(fresh)[0]
            ends = [eight[i - 8 * k][node] for k in range(4) if i > 8 * k]
            row = self.pair_rows[(ends[0] & np.uint64(0xFFFF)).astype(np.int64)] if i > 1 else np.zeros(len(node), np.int64)
            if i > 2:
                tail = (ends[0] & np.uint64(0xFFFFFF)).astype(np.int64)
                at = np.searchsorted(self.tails, tail)
                row = np.where(self.tails[at] == tail, self.tail_rows[at], row)
            found, left, turn = np.zeros(len(node), np.int64), np.arange(len(node)), 0
            while len(left):
                step = self.tries[row[left], turn]
                if not step.all():
                    raise ValueError("the vocabulary lacks a byte")
                fits = np.nonzero(step <= i)[0]
                own, length = left[fits], step[fits]
                token = self.find([e[own] for e in ends], length)
                there = np.nonzero(token >= 0)[0]
                own, token, at = own[there], token[there], i - length[there]
                good = at == 0
                inner = np.nonzero(~good)[0]
                good[inner] = self.may_follow(last[at[inner], node[own[inner]]], token[inner])
                found[own[good]] = token[good]
                done = np.zeros(len(node), bool)
                done[own[good]] = True
                left, turn = left[~done[left]], turn + 1
            last[i, node] = found
            last[i] = last[i, np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
        back, at, word = [], size.copy(), np.arange(n)
        while len(word):
            token = last[at, word]
            back.append((word, token))
            at = at - self.length[token]
            word, at = word[at > 0], at[at > 0]
        counts = np.zeros(n, np.int64)
        for own, _ in back:
            counts[own] += 1
        stop = np.cumsum(counts)
        flat = np.zeros(int(stop[-1]), "<u4")
        for k, (own, token) in enumerate(back):
            flat[stop[own] - 1 - k] = token
        held, ends_at = flat.tobytes(), (4 * stop).tolist()
        return [held[a:b] for a, b in zip([0, *ends_at], ends_at)]


class TrieEncoder:
    """Tables of one tokenizer file; made once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        from tokenizers import Tokenizer

        self.pre_tokenizer = Tokenizer.from_str(json.dumps(spec)).pre_tokenizer
        back = {c: b for b, c in enumerate(byte_characters())}
        self.back = back
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(back[c] for c in text) for text, i in vocab.items() if text not in self.special}
        self.ids = {raw: i for i, raw in self.tokens.items()}
        self.tokens |= {i: text.encode() for text, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, k)
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = k, pair
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.ids = {raw: i for raw, i in self.ids.items() if self.stands(i)}
        #: Lengths, longest first, of the tokens that end in these (up to three) bytes.
        ends: dict[bytes, set[int]] = {}
        for raw in self.ids:
            ends.setdefault(raw[-3:], set()).add(len(raw))
        self.steps = {
            tail: tuple(sorted(set().union(*(ends.get(tail[k:], set()) for k in range(len(tail)))), reverse=True))
            for tail in {*ends, *(t[1:] for t in ends), *(t[2:] for t in ends)} if tail
        }
        self.listed = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.tokens}
        self.levels = Levels(self)

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if token not in self.whole:
            parts = self.parts.get(token)
            self.whole[token] = parts is None or (all(map(self.stands, parts)) and self._apart(*parts, self.rank[token]))
        return self.whole[token]

    def _apart(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge joins a and b before the merge of rank `limit`."""
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and joined < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, float("inf"))
        return known

    def coded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Token ids of each distinct word, as little-endian 32-bit numbers: short words by levels, others one by one."""
        short = sorted(w for w in words if len(w) <= DEEP)
        if len(short) < SEVERAL:
            return self.walk(words)
        out = self.walk([w for w in words if len(w) > DEEP])
        for at in range(0, len(short), BLOCK):
            block = short[at : at + BLOCK]
            out.update(zip(block, self.levels.walk(block)))
        return out

    def walk(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Token ids of each distinct word, word by word."""
        ids, steps, pairs, may_follow, packed = self.ids, self.steps, self.pairs, self.may_follow, self.packed
        out: dict[bytes, bytes] = {}
        last: list[int] = [-1]  # last[i]: the last token of the encoding of the first i bytes
        back: list[int] = [0]  # and its length
        before = b""
        words = sorted(words)
        for word, depth in zip(words, _shared(words)):
            size = len(word)
            if depth == _WIDTH or depth > size:
                depth, top = min(depth, size, len(before)), min(size, len(before))
                while depth < top and word[depth] == before[depth]:
                    depth += 1
            del last[depth + 1 :], back[depth + 1 :]
            for i in range(depth + 1, size + 1):
                known = steps.get(word[i - 3 : i]) if i >= 3 else None
                if known is None:
                    known = steps.get(word[i - 2 : i]) if i >= 2 else None
                    if known is None:
                        known = (1,)
                for step in known:
                    at = i - step
                    if at < 0:
                        continue
                    token = ids.get(word[at:i])
                    if token is None:
                        continue
                    if at:
                        ok = pairs.get(last[at] << 32 | token)
                        if ok is None:
                            ok = may_follow(last[at], token)
                        if not ok:
                            continue
                    last.append(token)
                    back.append(step)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            tail, i = [], size
            while i:
                tail.append(packed[last[i]])
                i -= back[i]
            tail.reverse()
            out[word] = b"".join(tail)
            before = word
        return out

    def split_chunk(self, chunk: str) -> list[str]:
        """The words of a space and a chunk without spaces; letters with at most a comma or stop need no pattern."""
        if chunk.isalpha():
            return [" " + chunk]
        bare = chunk.rstrip(".,")
        if bare.isalpha():
            return [" " + bare, chunk[len(bare) :]]
        return _SPLIT.findall(" " + chunk)

    def split(self, text: str) -> list[str]:
        if _COMMON.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  A special token's string is that token, as the tokenizers library has it."""
        if self.special:
            cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
            if any(mark in t for mark in self.special for t in texts):
                return [self._with_special(t, cut) for t in texts]
        return self._plain(texts)

    def _with_special(self, text: str, cut: regex.Pattern) -> bytes:
        parts, marks = cut.split(text), cut.findall(text)
        coded = self._plain(parts)
        return b"".join(c + (self.packed[self.special[m]] if m is not None else b"") for c, m in zip(coded, [*marks, None]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        if max(len(self.chunks), len(self.words)) > MAX_CHUNKS:
            self.chunks.clear()
            self.words.clear()
        chunks, words = self.chunks, self.words
        # A word starts wherever a space follows a non-blank, so a text without blanks before spaces falls apart at its spaces.
        falls = [not text.startswith(" ") and _COMMON.fullmatch(text) is not None and not _BLANK_BEFORE_SPACE.search(text) for text in texts]
        whole = [self.split(text[: text.find(" ")] if fall and " " in text else text) for fall, text in zip(falls, texts)]
        parts = pa.compute.split_pattern(pa.array([text for fall, text in zip(falls, texts) if fall], pa.string()), " ")
        offsets = parts.offsets.to_numpy()
        rest = np.ones(len(parts.values), bool)
        rest[offsets[:-1]] = False
        coded = parts.values.filter(pa.array(rest)).dictionary_encode()
        # Chunks hold no space: one text of all of them is split faster than each is converted.
        n = len(coded.dictionary)
        named = pa.compute.binary_join(pa.ListArray.from_arrays([0, n], coded.dictionary), " ")[0].as_py().split(" ") if n else []
        parted = {c: self.split_chunk(c) for c in named if c not in chunks}
        new = {w for ws in (*parted.values(), *whole) for w in ws if w not in words}
        if new:
            raw = {w: w.encode() for w in new}
            ids = self.coded(list(raw.values()))
            words.update((w, ids[b]) for w, b in raw.items())
        for c, ws in parted.items():
            chunks[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        joined = pa.array(map(chunks.__getitem__, named), pa.large_binary(), size=len(named)).take(coded.indices)
        held, ends = b"", np.zeros(1, np.int64)
        if len(joined):
            _, ends, held = joined.buffers()
            held, ends = held.to_pybytes() if held is not None else b"", np.frombuffer(ends, np.int64)
        bounds = ends[offsets - np.arange(len(offsets))].tolist()
        spans = iter(zip(bounds, bounds[1:]))
        out = []
        for fall, ws in zip(falls, whole):
            head = b"".join(map(words.__getitem__, ws))
            out.append(head + held[slice(*next(spans))] if fall else head)
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < len(self.listed)]
        return b"".join(map(self.listed.__getitem__, numbers.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as binary: little-endian unsigned 32-bit numbers.

    `path` is a tokenizer file that every executor can open.  A null text counts
    as empty and has no ids.  Rows keep their other columns, but one named like
    `into` is replaced; equal texts get equal ids.
    """

    @F.arrow_udf(BinaryType())
    def coded(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([c for p in pieces(texts, 1 << 23) for c in own.encode(p.fill_null("").to_pylist())], pa.binary())

    return df.withColumn(into, coded(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of binary ids; unknown ids give nothing, null ids the empty text."""

    @F.arrow_udf(StringType())
    def text(ids: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.decode(x or b"") for x in ids.to_pylist()], pa.string())

    return df.withColumn(into, text(F.col(ids_col)))


@F.arrow_udf(ArrayType(IntegerType()))
def _listed(ids: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.frombuffer(x, "<i4") for x in ids.to_pylist()], pa.list_(pa.int32()))


def ids_array(ids: Column) -> Column:
    """Binary ids as array<int>."""
    return _listed(ids)
