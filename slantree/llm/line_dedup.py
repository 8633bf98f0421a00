"""Line dedup by an exact set-similarity join on line tokens.

A line is its set of words (A-Z lower-cased).  Tokens are ordered by rarity:
counts of all words of the table in two tables of SLOTS hashed slots, the
smaller one counting, then by hash.  Any order is exact; rare first keeps files
small.

Prefix filter.  Merge the ordered tokens of two lines.  If Jaccard >= t, at most
(1 - t) / (1 + t) x (nx + ny) tokens are in one line only, so for t > 2/3 two
common tokens must stand side by side in that merge, hence in both lines, and
the first such pair starts at position 2 (1 - t) n at most.  Each line is
therefore filed under its adjacent token pairs up to there, and similar lines
share a file.  Keys of pairs are gathered first: only pairs filed more than
once are worth an entry.

Within a file, pairs are tested by length, by position (tokens before the
shared pair can only match tokens before it, and no two side by side, where it
is their first) and by parity words: each token
flips one of 64, 128 or 256 bits (more for longer lines), so the bits in which
two lines differ are at most the tokens in which they do.  What passes is
verified on full token sets within each candidate group.  Lines of equal sets
are one record throughout.

A line's place is (doc_id, hash of the text, line number).  A line is removed
if an earlier one has Jaccard >= t with it, whether or not that one is removed
itself.  Equal rows of one id are one document; other texts under the same id
are other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.llm import records
from slantree.llm.components import components
from slantree.llm.durable import short_batches, written
from slantree.llm.near_dedup import BLOCK_MEMBERS, forest, linked
from slantree.llm.sieve import bit_map, bits_for, held_in, on, sieve
from slantree.llm.text_arrays import TextBatch, give_back, mix, slices

#: Slots of a rarity table, a power of two; two tables of this size are sent.
SLOTS = 1 << 18
#: Slots of a table that travel in one row.
SEGMENT = 1 << 12
#: Members of a file compared in one unit; larger files are dealt into blocks, and every pair of blocks is a unit.
FILE_BLOCK = 1000
PERCENT = 80
#: Below this two similar lines need not share an adjacent token pair.
LEAST_PERCENT = 67
#: Bits of a packed sort word that hold the line; the others hold a hash or a rarity.
LINE_SHIFT = 20
#: Bytes of text and number of token pairs in one row between the steps.
CHUNK_BYTES, CHUNK_KEYS = 1 << 24, 1 << 18
#: Words up to which a line has 64 and 128 parity bits; longer lines have 256.
NARROW, MEDIUM = 64, 160
#: Units of at most so many lines are verified many at once, larger ones by a matrix each.
SMALL_UNIT = 48
#: Hot keys whose numbers of blocks are sent to all tasks; of more, they are joined.
MOST_HOT = 100_000
#: Pairs of lines that are tested at a time.
PAIRS = 1 << 17
SIGNS = ["s0", "s1", "s2", "s3"]
DOC = {"doc_id": "<i8", "known": "<u1", "text_hash": "<i8", "n": "<i4"}
LINE = {"line_no": "<i4", "size": "<i4", "name": "<i8", "other": "<i8", "line": "<i8"}
FIRST = {"name": "<i8", "other": "<i8", "doc_id": "<i8", "text_hash": "<i8", "line_no": "<i4", "size": "<i4", "line": "<i8", "more": "<u1"}
KEY = {"low": "<u4", "n": "<u4"}
FOUND = {"name": "<i8", "other": "<i8", "doc_id": "<i8", "text_hash": "<i8", "line_no": "<i4", "n_links": "<i8", "earlier": "<u1", "head_doc": "<i8", "head_line": "<i4"}


def in_lines(line: np.ndarray, high: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Stable order by line, then by `high` (44 bits at most), or by `full` where a text has too many lines for one word.

    `line` never falls, so one sort of packed words does it.
    """
    if len(line) and line[-1] - line[0] >= 1 << LINE_SHIFT:
        return np.lexsort((full, line))
    return np.argsort(((line - line[:1]).astype(np.uint64) << np.uint64(64 - LINE_SHIFT)) | high, kind="stable")


class LineSets:
    """Distinct token sets of a batch's lines with a word; all arrays are sorted by line."""

    def __init__(self, texts: pa.Array):
        x = TextBatch(texts, lower=True)
        self.n_bytes = len(x.bytes)
        ls, le, ldoc = x.lines()
        start, end, _ = x.words()
        hashes = x.hashes(start, end)
        line = np.searchsorted(ls, start, "right") - 1
        # An empty line shares its start with the next one; searchsorted then points at the last of them, which holds the word.
        order = in_lines(line, hashes >> np.uint64(LINE_SHIFT), hashes)
        hashes, line = hashes[order], line[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, line = hashes[new], line[new]
        number = np.arange(len(ls)) - np.searchsorted(ldoc, ldoc, "left")
        used, self.first, self.size = np.unique(line, return_index=True, return_counts=True)
        self.tokens = hashes
        self.doc, self.number = ldoc[used], number[used]
        self.bounds = ls[used], le[used]
        self.line = x.hashes(*self.bounds).view(np.int64)
        edge = np.append(self.first, len(hashes))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(21)), out=total[1:])
        self.name = mix(total[edge[1:]] - total[edge[:-1]] + self.size.astype(np.uint64)).view(np.int64) if len(used) else np.zeros(0, np.int64)
        # A set is known by two names of 64 bits; the second is made from the tokens' hashes themselves.
        np.cumsum(hashes, out=total[1:])
        self.other = mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64) if len(used) else np.zeros(0, np.int64)


def slots(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token's slot in either rarity table."""
    low = np.uint64(SLOTS - 1)
    return (tokens & low).astype(np.int64), ((tokens >> np.uint64(24)) & low).astype(np.int64) + SLOTS


def _documents(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text_hash, text."""
    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _listed(df: DataFrame) -> DataFrame:
    """A row per chunk of documents: packed documents (DOC) and their lines with a word (LINE), with counts of both and of tokens.

    Each task adds its token counts by slot, in rows with a segment instead of a
    chunk, so that the text is read once for both.
    """
    schema = "chunk long, n_docs long, n_lines long, n_tokens long, docs binary, lines binary, segment int, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, np.int64)
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk(docs: records.Columns, lines: records.Columns) -> pa.RecordBatch:
            row = [(task << 32) + seq, len(docs["n"]), len(lines["name"]), int(lines["size"].sum()), records.pack(docs), records.pack(lines), None, None]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names)

        types = [*[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in slices(batches, "text"):
            s = LineSets(batch.column("text"))
            for slot in slots(s.tokens):
                total += np.bincount(slot, minlength=2 * SLOTS)
            ids = batch.column("doc_id")
            docs = {"doc_id": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(zero_copy_only=False).astype("<u1"), "text_hash": batch.column("text_hash").to_numpy(), "n": np.bincount(s.doc, minlength=len(batch)).astype("<i4")}
            held.append((docs, {"line_no": s.number.astype("<i4"), "size": s.size.astype("<i4"), "name": s.name, "other": s.other, "line": s.line}))
            size += s.n_bytes
            if size >= CHUNK_BYTES:
                yield chunk(*({c: np.concatenate([h[c] for h in part]) for c in part[0]} for part in zip(*held)))
                seq, held, size = seq + 1, [], 0
        if held:
            yield chunk(*({c: np.concatenate([h[c] for h in part]) for c in part[0]} for part in zip(*held)))
        used = np.flatnonzero(total.reshape(-1, SEGMENT).any(1))
        blobs = [total[k * SEGMENT : (k + 1) * SEGMENT].tobytes() for k in used]
        none = len(used)
        yield pa.record_batch([*(pa.nulls(none, t) for t in types[:6]), pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names)

    return df.mapInArrow(listed, schema)


def _rarity(listed: DataFrame) -> np.ndarray:
    """How many lines hold words of each slot: 2 x SLOTS numbers, whatever the input."""

    def add(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT, np.int64)
        for blob in blobs:
            total += np.frombuffer(blob, np.int64)
        yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["segment", "counts"])

    counts = listed.where("segment is not null").select(F.col("segment").cast("long").alias("bucket"), F.col("counts").alias("records"))
    out = np.zeros(2 * SLOTS, np.int64)
    for row in records.gather([counts], add, "segment long, counts binary").toArrow().to_pylist():
        out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["counts"], np.int64)
    return out


def _first_places(c: records.Columns) -> records.Columns:
    """One record per name: its least place, and whether it has another."""
    order = np.lexsort((c["line_no"], c["text_hash"], c["doc_id"], c["other"], c["name"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["name"][1:] != c["name"][:-1]) | (c["other"][1:] != c["other"][:-1])
    start = np.flatnonzero(new)
    moved = np.zeros(len(order), bool)
    moved[1:] = ~new[1:] & ((c["doc_id"][1:] != c["doc_id"][:-1]) | (c["text_hash"][1:] != c["text_hash"][:-1]) | (c["line_no"][1:] != c["line_no"][:-1]))
    more = c["more"].astype(bool) | moved
    out = {k: v[start] for k, v in c.items()}
    out["more"] = np.logical_or.reduceat(more, start).astype("<u1") if len(start) else np.zeros(0, "<u1")
    return out


def spread(docs: records.Columns) -> np.ndarray:
    """The document of each line."""
    return np.repeat(np.arange(len(docs["n"])), docs["n"])


def _sets(chunks: DataFrame, buckets: int) -> DataFrame:
    """Every distinct set of the documents with an id: name, its first place, size, line hash, and whether it has another place."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[records.Columns]:
        for batch in batches:
            for d, t in zip(batch.column("docs").to_pylist(), batch.column("lines").to_pylist()):
                docs, own = records.unpack([d], DOC), records.unpack([t], LINE)
                doc = spread(docs)
                c = {"name": own["name"], "other": own["other"], "doc_id": docs["doc_id"][doc], "text_hash": docs["text_hash"][doc], "line_no": own["line_no"], "size": own["size"], "line": own["line"], "more": np.zeros(len(doc), "<u1")}
                known = docs["known"][doc] == 1
                yield _first_places({k: v[known] for k, v in c.items()})

    def least(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        c = _first_places(records.unpack(blobs, FIRST))
        yield pa.record_batch([*(pa.array(c[k]) for k in FIRST if k != "more"), pa.array(c["more"] == 1)], list(FIRST))

    sent = records.deal(chunks.select("docs", "lines"), lines, buckets, "name", _first_places)
    return records.gather([sent], least, "name long, other long, doc_id long, text_hash long, line_no int, size int, line long, more boolean")


def place(doc_id: np.ndarray, text_hash: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    return mix(mix(doc_id.astype(np.uint64) + np.uint64(31)) + text_hash.view(np.uint64) * np.uint64(3) + line_no.astype(np.uint64))


def _place_map(sets: DataFrame, n: int):
    """Broadcast bit map of the first places."""
    bits = bits_for(n)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, line = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash", "line_no"))
            yield pa.record_batch([pa.array(place(doc, text, line).view(np.int64))], ["p"])

    return bit_map(sets.select("doc_id", "text_hash", "line_no").mapInArrow(marked, "p long"), F.col("p"), bits)


def parity(tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Four words per set; sets of at most MEDIUM and NARROW tokens are folded into the first two and the first."""
    if not len(first):
        return [np.zeros(0, np.uint64)] * 4
    bit = tokens >> np.uint64(56)
    flips, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    w = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), flips, np.uint64(0)), first) for k in range(4)]
    half, whole = sizes <= MEDIUM, sizes <= NARROW
    none = np.uint64(0)
    s0 = np.where(whole, w[0] ^ w[1] ^ w[2] ^ w[3], np.where(half, w[0] ^ w[2], w[0]))
    s1 = np.where(whole, none, np.where(half, w[1] ^ w[3], w[1]))
    return [s0, s1, np.where(half, none, w[2]), np.where(half, none, w[3])]


def least_size(percent: int) -> int:
    """Smaller sets have no similar other set."""
    return -(-percent // (100 - percent))


def _filed(df: DataFrame, rarity, firsts, percent: int) -> DataFrame:
    """Rows of packed sets (name, size, number of keys, parity words) and of the keys of the adjacent token pairs of their prefixes.

    A set is filed where its first place is.  The bit map of first places may
    let others through, more of them the fuller it is; who reads the files drops
    what a key holds more than once.
    """
    reach = (100 - percent) * 2
    schema = "n_keys long, name binary, size binary, many binary, s0 binary, s1 binary, s2 binary, s3 binary, keys binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = (np.log2(rarity.value + 1) * 64).astype(np.uint64)
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            yield pa.record_batch([pa.array([len(whole[-1])], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in whole)], names)

        for batch in slices(batches, "text"):
            s = LineSets(batch.column("text"))
            doc = s.doc
            here = on(firsts.value, place(batch.column("doc_id").to_numpy()[doc], batch.column("text_hash").to_numpy()[doc], s.number))
            wanted = here & (s.size >= least_size(percent))
            line = np.repeat(np.arange(len(s.size)), s.size)
            chosen = wanted[line]
            tokens, line = s.tokens[chosen], line[chosen]
            # Rarity in steps of a 64th of a doubling: any order is exact, if it is the same for all lines.  Ties keep the order by hash.
            one, two = slots(tokens)
            rank = np.minimum(steps[one], steps[two])
            order = in_lines(line, rank, rank)
            tokens = tokens[order]
            once = np.flatnonzero(wanted)
            sizes, names_ = s.size[once], s.name[once]
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            signs = parity(tokens, first, sizes)
            pos = np.arange(len(tokens)) - first[owner]
            keep = np.flatnonzero((pos <= reach * sizes[owner] // 100) & (pos < sizes[owner] - 1))
            key = mix(tokens[keep] * np.uint64(3) + mix(tokens[keep + 1]))
            held.append([names_, sizes.astype("<i4"), np.bincount(owner[keep], minlength=len(sizes)).astype("<i4"), *signs, key])
            if sum(len(h[-1]) for h in held) >= CHUNK_KEYS:
                yield from flush()
        if held:
            yield from flush()

    return df.where("doc_id is not null").mapInArrow(filed, schema)


def packed(name: np.ndarray, size: np.ndarray, pos: np.ndarray, signs: list[np.ndarray]) -> pa.Array:
    """A binary entry per row: name, size and position, and the one, two or four parity words of its size."""
    width = np.where(size <= NARROW, 3, np.where(size <= MEDIUM, 4, 6))
    edge = np.concatenate([[0], np.cumsum(width)])
    at, out = edge[:-1], np.empty(edge[-1], np.uint64)
    out[at] = name.view(np.uint64)
    out[at + 1] = (size.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)
    for k, word in enumerate(signs):
        has = width > 2 + k
        out[at[has] + 2 + k] = word[has].view(np.uint64)
    return pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer((edge * 8).astype(np.int32)), pa.py_buffer(out)])


def unpacked(entries: pa.Array) -> dict[str, np.ndarray]:
    """The columns of packed entries."""
    entries = (pa.concat_arrays(entries.chunks) if isinstance(entries, pa.ChunkedArray) else entries).cast(pa.large_binary())
    if not len(entries):
        return {c: np.zeros(0, np.int64) for c in ("name", "size", "pos", *SIGNS)}
    edge = np.frombuffer(entries.buffers()[1], np.int64, len(entries) + 1, entries.offset * 8)
    words = np.frombuffer(entries.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(np.uint64)
    at, width = (edge[:-1] - edge[0]) // 8, np.diff(edge) // 8
    rows = {"name": words[at].view(np.int64), "size": (words[at + 1] >> np.uint64(32)).astype(np.int64), "pos": (words[at + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)}
    for k, c in enumerate(SIGNS):
        has = width > 2 + k
        rows[c] = np.zeros(len(at), np.int64)
        rows[c][has] = words[at[has] + 2 + k].view(np.int64)
    return rows


def passes(rows: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """The length, positional and parity filters for rows p against rows q; never false for a pair at the threshold that shares this token pair."""
    out = np.zeros(len(p), bool)
    size_a, size_b, pos_a, pos_b = rows["size"][p].astype(np.int64), rows["size"][q].astype(np.int64), rows["pos"][p], rows["pos"][q]
    both = size_a + size_b
    fewest = -(-percent * both // (100 + percent))
    # Before the first shared pair every common token is followed by one of a single line: a third of the tokens match there at most.
    enough = (pos_a + pos_b) // 3 + np.minimum(size_a - pos_a, size_b - pos_b) >= fewest
    at = np.flatnonzero(enough & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (rows["name"][p] != rows["name"][q]))
    p, q, least = p[at], q[at], np.minimum(size_a, size_b)[at]
    x = [(rows[c][p] ^ rows[c][q]).view(np.uint64) for c in SIGNS]
    count = np.bitwise_count
    # Each width is compared at the narrower line's; wider words fold into narrower ones.
    narrow = count(x[0] ^ x[1] ^ x[2] ^ x[3]).astype(np.int64)
    medium = count(x[0] ^ x[2]).astype(np.int64) + count(x[1] ^ x[3])
    wide = sum(count(w).astype(np.int64) for w in x)
    differ = np.where(least <= NARROW, narrow, np.where(least <= MEDIUM, medium, wide))
    out[at] = differ <= (both - 2 * fewest)[at]
    return out


def _streamed(df: DataFrame, unit: list[str], order: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """`work` on whole units (rows equal in `unit`), many units at a time, in Arrow batches of sorted partitions."""
    dealt = df.select(*columns).repartition(*unit).sortWithinPartitions(*unit, *order)

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in unit:
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = edges(table)
            if len(at) > 1:  # the last unit may go on in the next batch
                yield from work(table.slice(0, at[-1]), at[:-1])
                held = table.slice(at[-1]).combine_chunks().to_batches()
                give_back()
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, edges(table))
        give_back()

    return dealt.mapInArrow(stream, schema)


def _pairs(start: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of each unit of 2 to `most` rows, for all units of one size at once."""
    for n in np.unique(count[(count > 1) & (count <= most)]):
        i, j = np.triu_indices(n, 1)
        at = start[count == n]
        for cut in range(0, len(at), max(1, PAIRS // len(i))):
            part = at[cut : cut + max(1, PAIRS // len(i)), None]
            yield (part + i).ravel(), (part + j).ravel()


def width_of(buckets: int, bits: int) -> int:
    """A bucket has 2 ** width bits of the map."""
    return max(6, (bits // buckets).bit_length() - 1)


def _sizes_of_keys(files: DataFrame, buckets: int, width: int, block: int) -> DataFrame:
    """Per bucket of keys: its stretch of the bit maps of keys filed more than once and of hot keys, and the hot keys with their counts."""

    def merged(c: records.Columns) -> records.Columns:
        key, n = np.unique(c["key"], return_counts=True)
        return {"key": key, "n": n.astype("<u4")}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[records.Columns]:
        for batch in batches:
            for blob in batch.column("keys").to_pylist():
                key = np.frombuffer(blob, np.uint64)
                yield {"key": key, "n": np.ones(len(key), "<u4")}

    def low(c: records.Columns) -> bytes:
        return records.pack({"low": c["key"].astype("<u4"), "n": c["n"]})

    def count(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        c = records.unpack(blobs, KEY)
        order = np.argsort(c["low"])
        key, n = c["low"][order], c["n"][order].astype(np.int64)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        total = np.add.reduceat(n, start) if len(start) else n
        key = key[start]
        hot = total > block

        def bits_of(which: np.ndarray) -> bytes:
            out = np.zeros(1 << width, bool)
            out[key[which] >> np.uint32(32 - width)] = True
            return np.packbits(out, bitorder="little").tobytes() if which.any() else b""

        maps = [pa.array([bits_of(w)], pa.binary()) for w in (total > 1, hot)]
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (key[hot].astype(np.int64) + (bucket << 32), total[hot])]
        yield pa.record_batch([pa.array([bucket], pa.int64()), *maps, *lists], ["bucket", "again", "heat", "hot", "n"])

    sent = records.deal(files.select("keys"), keys, buckets, "key", merged, low)
    return records.gather([sent], count, "bucket long, again binary, heat binary, hot array<long>, n array<long>")


def key_bit(key: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """A key's place in the bit map: its bucket, then the top bits of its low half."""
    return (records.bucket_of(key, buckets) << width) + ((key & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - width)).astype(np.int64)


def pack_entries(c: records.Columns) -> bytes:
    """Keys, names, sizes with positions and first parity words; then the further parity words of longer lines only."""
    sizepos = (c["size"].astype(np.uint64) << np.uint64(32)) | c["pos"].astype(np.uint64)
    long, longer = c["size"] > NARROW, c["size"] > MEDIUM
    return b"".join([np.uint64(len(sizepos)).tobytes(), c["key"].tobytes(), c["name"].tobytes(), sizepos.tobytes(), c["s0"].tobytes(), c["s1"][long].tobytes(), c["s2"][longer].tobytes(), c["s3"][longer].tobytes()])


def unpack_entries(blobs: list[bytes]) -> records.Columns:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("key", "name", "size", "pos", *SIGNS)}
    for blob in blobs:
        words = np.frombuffer(blob, np.uint64)
        n = int(words[0])
        key, name, sizepos, s0 = words[1 : 4 * n + 1].reshape(4, n)
        size = (sizepos >> np.uint64(32)).astype(np.int64)
        at = 4 * n + 1
        for c, v in (("key", key), ("name", name.view(np.int64)), ("size", size), ("pos", (sizepos & np.uint64(0xFFFFFFFF)).astype(np.int64)), ("s0", s0)):
            parts[c].append(v)
        for c, has in (("s1", size > NARROW), ("s2", size > MEDIUM), ("s3", size > MEDIUM)):
            v = np.zeros(n, np.uint64)
            v[has] = words[at : at + has.sum()]
            at += int(has.sum())
            parts[c].append(v)
    return {c: np.concatenate(p) if p else np.zeros(0, np.int64) for c, p in parts.items()}


def _entries(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[records.Columns]:
    """Entries whose keys `wanted` picks: key, name, size, pos and parity words, a chunk at a time."""
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("name", "size", "many", *SIGNS, "keys")]
        for name, size, many, *signs, keys in zip(*rows):
            key, many = np.frombuffer(keys, np.uint64), np.frombuffer(many, "<i4").astype(np.int64)
            at = np.flatnonzero(wanted(key))
            own = np.repeat(np.arange(len(many)), many)[at]
            pos = at - (np.cumsum(many) - many)[own]
            yield {"key": key[at], "name": np.frombuffer(name, np.int64)[own], "size": np.frombuffer(size, "<i4")[own].astype(np.int64), "pos": pos, **{c: np.frombuffer(w, np.uint64)[own] for c, w in zip(SIGNS, signs)}}


def once(rows: records.Columns) -> tuple[records.Columns, np.ndarray]:
    """The rows sorted by key, without those filed more than once under it, and where each key starts."""
    order = np.lexsort((rows["name"], rows["key"]))
    rows = {c: v[order] for c, v in rows.items()}
    again = np.zeros(len(order), bool)
    again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["name"][1:] == rows["name"][:-1])
    at = np.flatnonzero(again)
    for c in ("size", "pos", *SIGNS):
        at = at[rows[c][at] == rows[c][at - 1]]
    keep = np.ones(len(order), bool)
    keep[at] = False
    rows = {c: v[keep] for c, v in rows.items()}
    return rows, np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))[: len(rows["key"])]


def _compared(rows: records.Columns, start: np.ndarray, percent: int, apart: np.ndarray | None = None) -> pa.RecordBatch:
    """A spanning forest (a, b) of the links between names that pass the filters within units; of units marked `apart`, only links between blocks."""
    total = len(rows["name"])
    count = np.diff(np.append(start, total))
    names, member = np.unique(rows["name"], return_inverse=True)
    label = np.arange(len(names))

    def join(p: np.ndarray, q: np.ndarray) -> None:
        p, q = member[p], member[q]
        while True:
            open_ = label[p] != label[q]
            if not open_.any():
                return
            p, q = p[open_], q[open_]
            low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label[:] = label[label]

    def test(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        ok = passes(rows, p, q, percent)
        return ok if apart is None else ok & (~apart[p] | (rows["own"][p] != rows["own"][q]))

    for p, q in _pairs(start, count, SMALL_UNIT):
        ok = test(p, q)
        join(p[ok], q[ok])
    for at, n in zip(start[count > SMALL_UNIT], count[count > SMALL_UNIT]):
        members = np.arange(at, at + n)
        rows_each = max(1, PAIRS // n)
        for cut in range(0, n, rows_each):
            p = np.repeat(members[cut : cut + rows_each], n)
            q = np.tile(members, len(p) // n)
            ok = test(p, q)
            join(p[ok], q[ok])
    new = label != np.arange(len(names))
    return pa.record_batch([pa.array(names[label[new]], pa.int64()), pa.array(names[new], pa.int64())], ["a", "b"])


def _candidates(files: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between set names that pass the filters in some file, as a spanning forest per bucket of files."""
    n_keys = files.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    buckets, bits = records.buckets_for(n_keys), bits_for(n_keys, 1)
    width = width_of(buckets, bits)
    counted = written(_sizes_of_keys(files, buckets, width, block), "keys")
    maps = np.zeros((2, buckets, 1 << (width - 6)), np.uint64)
    for row in counted.select("bucket", "again", "heat").toArrow().to_pylist():  # two bit maps
        for k, c in enumerate(("again", "heat")):
            if row[c]:
                maps[k, row["bucket"]] = np.frombuffer(row[c], np.uint64)
    hot = counted.select(F.explode(F.arrays_zip("hot", "n")).alias("h")).select(F.col("h.hot").alias("key"), F.ceil(F.col("h.n") / block).cast("int").alias("blocks"))
    some_hot = bool(maps[1].any())
    sent = files.sparkSession.sparkContext.broadcast(maps.reshape(2, -1))

    def marked(key: np.ndarray, which: int) -> np.ndarray:
        at = key_bit(key, buckets, width)
        return (sent.value[which][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[records.Columns]:
        yield from _entries(batches, lambda key: marked(key, 0) & ~marked(key, 1) if some_hot else marked(key, 0))

    def compare(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = unpack_entries(blobs)
        yield _compared(*once(rows), percent)

    dealt = records.deal(files, cold, buckets, "key", packer=pack_entries)
    links = records.gather([dealt], compare, "a long, b long")
    return links.union(_hot_links(files, hot, lambda key: marked(key, 0) & marked(key, 1), buckets, percent)) if some_hot else links


def _hot_links(files: DataFrame, hot: DataFrame, wanted, buckets: int, percent: int) -> DataFrame:
    """The same for hot keys: their entries are dealt into blocks, and every pair of blocks is a unit."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _entries(batches, wanted):
            key = (records.bucket_of(c["key"], buckets) << 32) + (c["key"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.record_batch([pa.array(key), packed(c["name"], c["size"], c["pos"], [c[k] for k in SIGNS])], ["key", "entry"])

    # Sets filed more than once would be copied to every block as often: each is kept once.  What the hot keys' map lets through by chance has one block.
    single = files.mapInArrow(listed, "key long, entry binary").distinct()
    warm = single.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = warm.withColumn("own", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "entry")

    def compare(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = unpacked(table.column("entry").combine_chunks())
        rows["own"] = table.column("own").to_numpy()
        yield _compared(rows, start, percent, table.column("i").to_numpy() != table.column("j").to_numpy())

    return _streamed(units, ["key", "i", "j"], [], ["key", "i", "j", "own", "entry"], compare, "a long, b long")


def _wanted_lines(df: DataFrame, members: DataFrame) -> DataFrame:
    """line (its hash) and words of the lines that may stand first for a member, and few others."""
    sent = bit_map(members, F.col("line"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = TextBatch(batch.column("text"), lower=True)
            start, end, _ = x.lines()
            line = x.hashes(start, end)
            at = np.flatnonzero(on(sent.value, line))
            hashes, first = np.unique(line[at].view(np.int64), return_index=True)
            at = at[first]
            words = [x.bytes[a:b].tobytes().decode() for a, b in zip(start[at], end[at])]
            yield pa.record_batch([pa.array(hashes), pa.array(words, pa.string())], ["line", "words"])

    return df.where("doc_id is not null").select("text").mapInArrow(picked, "line long, words string")


def shared_tokens(s: LineSets, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets p with sets q, pair by pair."""
    out = np.zeros(len(p), np.int64)
    cost = np.cumsum(s.size[p] + s.size[q])
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 500_000, "right")))
        both = np.concatenate([p[at:to], q[at:to]])
        n = s.size[both]
        pair = np.repeat(np.tile(np.arange(to - at), 2), n)
        tokens = s.tokens[np.repeat(s.first[both] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((tokens, pair))
        tokens, pair = tokens[order], pair[order]
        same = (tokens[1:] == tokens[:-1]) & (pair[1:] == pair[:-1])
        out[at:to] = np.bincount(pair[1:][same], minlength=to - at)
        at = to
    return out


def _verified(members: DataFrame, df: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per id of a set: links and whether an earlier set is linked; and a spanning forest of the links."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("s") / 2_000_000), F.lit(1)).cast("int")
    placed = members.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = _wanted_lines(df, members).join(placed, "line")
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "doc_id", "text_hash", "line_no", "words")

    def compare(table: pa.Table, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by the place of their set, so a set sent by several tasks stands together.
        name, grp, i, j = (table.column(c).to_numpy() for c in ("id", "grp", "i", "j"))
        new = np.ones(len(table), bool)
        unit = (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        new[1:] = unit | (name[1:] != name[:-1])
        edge = np.concatenate([[True], unit])[new]
        name, i, j, own = name[new], i[new], j[new], table.column("own").to_numpy()[new]
        lines = table.column("words").filter(pa.array(new)).combine_chunks()
        s = LineSets(lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines)
        start = np.flatnonzero(edge)
        count = np.diff(np.append(start, len(name)))
        n_links, earlier, label = np.zeros(len(name), np.int64), np.zeros(len(name), bool), np.arange(len(name))
        a, b = [], []
        for p, q in _pairs(start, count, SMALL_UNIT):
            ok = (100 * np.minimum(s.size[p], s.size[q]) >= percent * np.maximum(s.size[p], s.size[q])) & ((i[p] == j[p]) | (own[p] != own[q]))
            p, q = p[ok], q[ok]
            both = shared_tokens(s, p, q)
            ok = 100 * both >= percent * (s.size[p] + s.size[q] - both)
            a.append(p[ok])
            b.append(q[ok])
        if a:
            p, q = np.concatenate(a), np.concatenate(b)
            n_links += np.bincount(np.concatenate([p, q]), minlength=len(name))
            earlier[q] = True
            while (label[p] != label[q]).any():
                least = np.minimum(label[p], label[q])
                np.minimum.at(label, p, least)
                np.minimum.at(label, q, least)
        for at, n in zip(start[count > SMALL_UNIT], count[count > SMALL_UNIT]):
            sets = [s.tokens[s.first[k] : s.first[k] + s.size[k]] for k in range(at, at + n)]
            mine = own[at : at + n]
            if i[at] == j[at]:
                links = linked(sets, None, percent)
                np.fill_diagonal(links, False)
            else:
                x, y = np.flatnonzero(mine == i[at]), np.flatnonzero(mine == j[at])
                links = np.zeros((n, n), bool)
                if len(x) and len(y):
                    links[np.ix_(x, y)] = linked([sets[k] for k in x], [sets[k] for k in y], percent)
                links |= links.T
            n_links[at : at + n], earlier[at : at + n], label[at : at + n] = links.sum(1), np.tril(links).any(1), at + forest(links)
        yield pa.record_batch([pa.array(name), pa.array(n_links), pa.array(earlier), pa.array(name[label])], ["id", "n_links", "earlier", "root"])

    columns = ["grp", "i", "j", "own", "id", "doc_id", "text_hash", "line_no", "words"]
    found = written(_streamed(units, ["grp", "i", "j"], ["doc_id", "text_hash", "line_no"], columns, compare, "id long, n_links long, earlier boolean, root long"), "verified")
    per_set = found.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("earlier").alias("earlier"))
    return per_set, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def by_name(c: records.Columns) -> records.Columns:
    """The records sorted by both names."""
    order = np.lexsort((c["other"], c["name"]))
    return {k: v[order] for k, v in c.items()}


def looked_up(facts: records.Columns, asked: records.Columns) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked pair of names stands among `facts` (sorted by both), and whether it does."""
    at = np.searchsorted(facts["name"], asked["name"])
    hit, left = np.zeros(len(at), bool), np.arange(len(at))
    while len(left):
        left = left[at[left] < len(facts["name"])]
        left = left[facts["name"][at[left]] == asked["name"][left]]
        same = facts["other"][at[left]] == asked["other"][left]
        hit[left[same]] = True
        left = left[~same]  # another set of the same first name: the next one
        at[left] += 1
    return at, hit


def _answers(chunks: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """chunk and packed rows (FOUND) of `found` whose names the chunk's lines hold: a name goes to a chunk once, however many lines have it."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[records.Columns]:
        for batch in batches:
            for chunk, lines in zip(batch.column("chunk").to_pylist(), batch.column("lines").to_pylist()):
                own = records.unpack([lines], LINE)
                at = np.lexsort((own["other"], own["name"]))
                name, other = own["name"][at], own["other"][at]
                new = np.append(True, (name[1:] != name[:-1]) | (other[1:] != other[:-1]))[: len(at)]
                yield {"name": name[new], "other": other[new], "chunk": np.full(int(new.sum()), chunk)}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[records.Columns]:
        for batch in batches:
            yield {c: batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in FOUND.items()}

    def matched(bucket: int, questions: list[bytes], facts: list[bytes]) -> Iterator[pa.RecordBatch]:
        q, f = records.unpack(questions, {"name": "<i8", "other": "<i8", "chunk": "<i8"}), by_name(records.unpack(facts, FOUND))
        at, hit = looked_up(f, q)
        at, chunk = at[hit], q["chunk"][hit]
        yield records.dealt({c: v[at] for c, v in f.items()}, chunk)

    sides = [records.deal(chunks.select("chunk", "lines"), asked, buckets, "name"), records.deal(found.select(*FOUND), told, buckets, "name")]
    return records.gather(sides, matched, "bucket long, records binary")


def _described(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per document, from its chunk and what is known of the chunk's names."""
    schema = "doc_id long, text_hash long, n_lines long, n_removed long, n_links long, line_nos array<int>, sizes array<int>, links array<long>, class_docs array<long>, class_lines array<int>, removed array<boolean>, removed_lines array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def described(_: int, docs: list[bytes], lines: list[bytes], told: list[bytes]) -> Iterator[pa.RecordBatch]:
        d, t, f = records.unpack(docs, DOC), records.unpack(lines, LINE), records.unpack(told, FOUND)
        doc = spread(d)
        known = d["known"][doc] == 1
        f = by_name(f)
        at, hit = looked_up(f, t)
        hit &= known
        at = at[hit]
        links, class_doc, class_line, removed = np.zeros(len(doc), np.int64), d["doc_id"][doc], t["line_no"].copy(), np.zeros(len(doc), bool)
        links[hit], class_doc[hit], class_line[hit] = f["n_links"][at], f["head_doc"][at], f["head_line"][at]
        again = (f["doc_id"][at] != d["doc_id"][doc[hit]]) | (f["text_hash"][at] != d["text_hash"][doc[hit]]) | (f["line_no"][at] != t["line_no"][hit])
        removed[hit] = again | (f["earlier"][at] == 1)
        edge = pa.array(np.append(0, np.cumsum(d["n"])), pa.int32())
        n = len(d["n"])
        gone = np.bincount(doc[removed], minlength=n)

        def lists(values: np.ndarray, kind, null: np.ndarray | None = None) -> pa.Array:
            return pa.ListArray.from_arrays(edge, pa.array(values, kind, mask=null))

        yield pa.record_batch(
            [
                pa.array(d["doc_id"], mask=d["known"] == 0),
                pa.array(d["text_hash"]),
                pa.array(d["n"].astype(np.int64)),
                pa.array(gone.astype(np.int64)),
                pa.array(np.bincount(doc, weights=links, minlength=n).astype(np.int64)),
                lists(t["line_no"], pa.int32()),
                lists(t["size"], pa.int32()),
                lists(links, pa.int64()),
                lists(class_doc, pa.int64(), ~known),
                lists(class_line, pa.int32()),
                lists(removed, pa.bool_()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(gone)), pa.int32()), pa.array(t["line_no"][removed], pa.int32())),
            ],
            names,
        )

    sides = [chunks.select(F.col("chunk").alias("bucket"), F.col(c).alias("records")) for c in ("docs", "lines")]
    return records.gather([*sides, answers], described, schema)


def line_links(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, file_block: int = FILE_BLOCK) -> DataFrame:
    """One row per row of `df`: doc_id, text_hash, n_lines, n_removed, n_links, and arrays over the document's lines with a word.

    line_nos (from 0), sizes (distinct words), links (other distinct token sets
    linked with the line's own), class_docs and class_lines (the place of the
    first line of the class, which is what links connect), removed; and
    removed_lines, the numbers of the removed ones.  n_removed and n_links are
    sums.  Texts that are null, empty or blank have no such line.  Rows with a
    null id are linked with nothing, lose nothing, and have null class_docs.
    Equal rows of one id get equal results.  The percentage must be at least 67.
    """
    if not LEAST_PERCENT <= percent < 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 99")
    docs = _documents(short_batches(df), text_col, id_col)
    listed = written(_listed(docs), "lines")
    chunks = listed.where("chunk is not null").select("chunk", "docs", "lines")
    n_lines = listed.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
    buckets = records.buckets_for(n_lines)
    sets = written(_sets(chunks, buckets), "sets")
    rarity = df.sparkSession.sparkContext.broadcast(_rarity(listed))
    firsts = _place_map(sets, n_lines)
    files = written(_filed(docs, rarity, firsts, percent), "files")
    for sent in (rarity, firsts):
        sent.unpersist()
    groups = written(components(_candidates(files, percent, file_block)).select(F.col("id").alias("name"), F.col("component").alias("grp")), "groups")
    members = written(sieve(sets, "name", groups, "name").join(groups, "name").withColumn("id", F.monotonically_increasing_id()), "members")
    per_set, links = _verified(members, docs, percent)
    classes = components(links).select("id", "component")
    heads = classes.join(members, "id").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("head"))
    known = written(per_set.join(members.select("id", "name", "other"), "id").join(classes, "id", "left").join(heads, "component", "left").select("name", "other", "n_links", "earlier", "head"), "known")
    listed_sets = sets.where(F.col("more") | held_in(bit_map(known, F.xxhash64("name")), F.xxhash64("name")))
    head = F.coalesce("head", F.struct("doc_id", "text_hash", "line_no"))
    # By a shuffle whatever the sizes: a task that sifts sets must not also pack the answers, in a second Python worker that stays.
    found = listed_sets.join(known.hint("merge"), ["name", "other"], "left").select("name", "other", "doc_id", "text_hash", "line_no", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("earlier", F.lit(False)).alias("earlier"), head["doc_id"].alias("head_doc"), head["line_no"].alias("head_line"))
    return _described(chunks, _answers(chunks, found, buckets))


def match_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, file_block: int = FILE_BLOCK) -> DataFrame:
    """Every line with a word: doc_id, text_hash, line_no, size, n_links, class_doc, class_line, removed."""
    columns = {"line_nos": "line_no", "sizes": "size", "links": "n_links", "class_docs": "class_doc", "class_lines": "class_line", "removed": "removed"}
    lines = line_links(df, text_col, id_col, percent, file_block).select("doc_id", "text_hash", F.explode(F.arrays_zip(*columns)).alias("l"))
    return lines.select("doc_id", "text_hash", *[F.col(f"l.{c}").alias(name) for c, name in columns.items()])


def remove_lines(df: DataFrame, linked_docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`df` with the removed lines cut out of its texts; blank lines stay; all columns and rows stay.

    `linked_docs` is the result of line_links.  A text that loses nothing is
    unchanged and not shuffled.
    """
    gone = linked_docs.where("doc_id is not null and n_removed > 0").groupBy("doc_id", "text_hash").agg(F.any_value("removed_lines").alias("removed_lines"))
    gone = written(gone.select(F.xxhash64("doc_id", "text_hash").alias("k"), "doc_id", "text_hash", "removed_lines"), "removed_lines")
    short_batches(df)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
    may_lose = held_in(bit_map(gone, F.col("k")), key)
    # Columns of `df` stand in a struct meanwhile, so that none can clash with those of the join.
    text = F.col(f"row.`{text_col}`")
    marked = df.select(row, may_lose.alias("may_lose"))
    losing = marked.where("may_lose").select("row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")).join(gone, ["doc_id", "text_hash"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains("removed_lines", k)), "\n")
    cut = losing.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("removed_lines").isNull(), text).otherwise(kept)).alias("row"))
    return marked.where("not may_lose").select("row").union(cut).select("row.*")
