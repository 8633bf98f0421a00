"""MinHash near-duplicates: SuperMinHash, banding, verification on full sets, grouping.

1. Each text becomes its set of shingles and a SuperMinHash signature: every
   element draws one random rank per permutation position, and positions that
   can no longer improve are not drawn (early stopping).  The draws run level by
   level over all texts of a batch.
2. Equal sets are joined first (one representative each), then signatures are
   banded.  Within a band bucket every representative is linked to the smallest
   one only, so a bucket of any size gives as many rows as members.
3. The candidate links' components are groups of work.  A small one is compared
   in full.  In a large one each member is held against its hub first; then
   blocks are compared wherever a link could still join two classes.  So no true
   link between classes is missed, and a spanning forest of the links is kept.
4. The verified links' components are the groups.

A pair at the threshold shares no bucket with a probability of at most MISS,
and less the more similar it is or the more members its group has; the bands
follow from the threshold (`banding`): 30 x 6 for 0.85, 35 x 5 for 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.llm.components import components
from slantree.llm.durable import short_batches, written
from slantree.llm.sieve import sieve
from slantree.llm.text_arrays import TextBatch, give_back, mix, slices, windows

MISS, MOST_BANDS = 1e-6, 35
#: Members and shingles of a block of a candidate group; larger groups are compared block by block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1500, 1_000_000
_FRACTION = 40


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: as many rows as MOST_BANDS bands allow at a miss rate of MISS, for independent slots."""
    for rows in range(20, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-min(0.999999, (percent / 100) ** rows)))
        if bands <= MOST_BANDS:
            return bands, rows
    return math.ceil(math.log(MISS) / math.log1p(-percent / 100)), 1


def shingle_sets(x: TextBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their documents, sorted by document; a text of fewer words is one shingle."""
    start, end, doc = x.words()
    hashes = x.hashes(start, end)
    gram, at = windows(hashes, doc, size)
    grams, docs = [gram], [doc[at]]
    n_words = np.bincount(doc, minlength=x.n)
    for few in range(1, size):
        gram, at = windows(hashes, doc, few)
        short = n_words[doc[at]] == few
        grams.append(mix(gram[short] + np.uint64(few)))
        docs.append(doc[at][short])
    gram, doc = np.concatenate(grams), np.concatenate(docs)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[new], doc[new]


def superminhash(elements: np.ndarray, docs: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures of the documents' element sets: n_docs x size, level and rank in one number.

    At level j element e draws a rank r and a position k of j..size-1, swaps
    entries j and k of its own permutation, and offers j + r to the slot now at
    entry j.  A document whose slots all hold a level of at most j is done.
    """
    best = np.full((n_docs, size), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    own, doc, order = elements, docs.astype(np.int64), None
    for level in range(size):
        draw = mix(own + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64))
        k = level + ((draw >> np.uint64(_FRACTION)) % np.uint64(size - level)).astype(np.int64)
        rows = np.arange(len(own))
        if order is None:
            slot = k
        else:
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, level]
            order[rows, level] = slot
        np.minimum.at(flat, doc * size + slot, np.uint64(level << _FRACTION) | (draw & np.uint64((1 << _FRACTION) - 1)))
        open_docs = ~(best < np.uint64((level + 1) << _FRACTION)).all(1)
        keep = open_docs[doc]
        if not keep.any():
            break
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (int(keep.sum()), 1))
            order[np.arange(len(order)), k[keep]] = 0
            order[:, 0] = k[keep]
        elif not keep.all():
            order = order[keep]
        if not keep.all():
            own, doc = own[keep], doc[keep]
    return best


def sign(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Of rows of doc_id, text_hash and text: doc_id, text_hash, n_shingles, k1, k2 (a 128-bit name of the set) and the band keys; no band keys for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = TextBatch(batch.column("text"), lower=True)
            gram, doc = shingle_sets(x, size)
            n = np.bincount(doc, minlength=x.n)
            names = []
            for seed in (11, 12):
                total = np.zeros(len(gram) + 1, np.uint64)
                np.cumsum(mix(gram + np.uint64(seed)), out=total[1:])
                edge = np.concatenate([[0], np.cumsum(n)])
                names.append(mix(total[edge[1:]] - total[edge[:-1]] + n.astype(np.uint64)))
            signature = superminhash(gram, doc, x.n, bands * rows).reshape(x.n, bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (x.n, bands)) + np.uint64(1)
            for k in range(rows):
                key = mix(key + signature[:, :, k])
            keys = key[n > 0].view(np.int64).ravel()
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands"],
            )

    return df.mapInArrow(signed, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets (None: left with left)."""
    both = left + (right or [])
    sizes = np.array([len(s) for s in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    _, token, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    shared = count > 1
    # Frequent elements by a matrix product, in strips of columns; rare ones by listing their few pairs.
    dense = shared & (count >= max(2, len(both) // 16))
    column = np.cumsum(dense) - 1
    strip = 2048
    on = dense[token]
    rows, columns = owner[on], column[token[on]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, int(dense.sum()), strip):
        a, b = np.searchsorted(columns, (at, at + strip))
        grid = np.zeros((len(both), min(strip, int(dense.sum()) - at)), np.float32)
        grid[rows[a:b], columns[a:b] - at] = 1
        out += grid[: len(left)] @ (grid if right is None else grid[len(left) :]).T
    rare = (shared & ~dense)[token]
    if rare.any():
        rows, tokens = owner[rare], token[rare]
        order = np.argsort(tokens, kind="stable")
        rows, tokens = rows[order], tokens[order]
        _, first, many = np.unique(tokens, return_index=True, return_counts=True)
        for n in np.unique(many):
            lists = rows[first[many == n][:, None] + np.arange(n)]
            for i in range(n):
                for j in range(n):
                    a, b = lists[:, i], lists[:, j]
                    if right is None:
                        np.add.at(out, (a, b), 1)
                    else:
                        cross = (a < len(left)) & (b >= len(left))
                        np.add.at(out, (a[cross], b[cross] - len(left)), 1)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix: 100 x intersection >= percent x union; both sets must have elements."""
    shared = intersections(left, right).astype(np.int64)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None]
    return (100 * shared >= percent * (a + b - shared)) & (shared > 0)


def forest(links: np.ndarray) -> np.ndarray:
    """Component labels of a symmetric boolean matrix: the least row index reachable."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label[None], len(links)).min(1, initial=len(links)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _sets(unit: pa.Table, size: int) -> list[np.ndarray]:
    """The shingle set of each row's text."""
    text = unit.column("text").combine_chunks()
    x = TextBatch(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, lower=True)
    gram, doc = shingle_sets(x, size)
    return np.split(gram, np.searchsorted(doc, np.arange(1, x.n))) if x.n else []


def hub_links(members: DataFrame, candidates: DataFrame, texts, percent: int, size: int, block_members: int, block_shingles: int) -> DataFrame:
    """True links (a, b) between members and the hub with which each shares most buckets: one comparison a member."""
    shared = candidates.groupBy("a", "b").agg(F.count("*").alias("n"))
    hub = shared.groupBy(F.col("b").alias("id")).agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("t")).select("id", (-F.col("t.a")).alias("hub"))
    followers = members.join(hub, "id")
    sizes = followers.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = sizes.select("hub", F.greatest(F.ceil(F.col("n") / block_members), F.ceil(F.col("s") / block_shingles)).cast("int").alias("parts"))
    dealt = followers.join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "doc_id", "text_hash")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hubs = parts.select("hub", each).join(members.select(F.col("id").alias("hub"), "id", "doc_id", "text_hash"), "hub").select("hub", "part", "id", "doc_id", "text_hash")

    def compare(unit: pa.Table) -> pa.Table:
        ids, hub = unit.column("id").to_numpy(), unit.column("hub").to_numpy()
        sets = _sets(unit, size)
        own, others = np.flatnonzero(ids == hub), np.flatnonzero(ids != hub)
        hit = others[linked([sets[k] for k in own[:1]], [sets[k] for k in others], percent)[0]] if len(own) and len(others) else others[:0]
        if sum(map(len, sets)) > 100_000:
            del sets
            give_back()
        return pa.table({"a": pa.array(hub[hit], pa.int64()), "b": pa.array(ids[hit], pa.int64())})

    units = texts(dealt.union(hubs)).select("hub", "part", "id", "text")
    return units.groupBy("hub", "part").applyInArrow(compare, "a long, b long")


def open_units(members: DataFrame, found: DataFrame, percent: int, block_members: int, block_shingles: int) -> DataFrame:
    """grp, i, j, own of members: the pairs of blocks that are still to be compared.

    Members that are linked already are of one class, and blocks of one class
    are not compared; nor are blocks whose sets differ too much in size.  What is
    in no class shares blocks, and those are compared with all and in themselves.
    """
    classes = components(found).select("id", F.col("component").alias("class"))
    step = math.log(100 / percent)
    kind = members.join(classes, "id", "left").withColumns({"class": F.coalesce("class", F.lit(-1)), "bucket": F.floor(F.log("n_shingles") / step).cast("int")})
    sizes = kind.groupBy("grp", "class", "bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = sizes.select("grp", "class", "bucket", F.greatest(F.ceil(F.col("n") / block_members), F.ceil(F.col("s") / block_shingles)).cast("int").alias("parts"))
    # Written: a block's name must be the same on both sides of what follows.
    blocks = written(parts.select("grp", "class", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("block", F.monotonically_increasing_id()), "blocks")
    x = blocks.select("grp", F.col("class").alias("cx"), F.col("bucket").alias("bx"), F.col("block").alias("i"))
    y = blocks.select("grp", F.col("class").alias("cy"), F.col("bucket").alias("by"), F.col("block").alias("j"))
    pairs = x.join(y, "grp").where("i <= j and abs(bx - by) <= 1 and (cx <> cy or cx = -1)").select("grp", "i", "j")
    dealt = kind.join(parts, ["grp", "class", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = dealt.join(blocks, ["grp", "class", "bucket", "part"]).select("id", "doc_id", "text_hash", F.col("block").alias("own"))
    sides = pairs.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    return placed.join(sides, "own").select("grp", "i", "j", "own", "id", "doc_id", "text_hash")


def verify(members: DataFrame, docs: DataFrame, candidates: DataFrame, percent: int, size: int, block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Enough true links (a, b) of each candidate group to connect what is linked.

    `members` has id, grp, n_shingles, and doc_id and text_hash of a row of
    `docs` with that set.  A group within the block limits is one unit of work.
    In a larger one members are held against their hubs first (`hub_links`), and
    then blocks against blocks, but only where links could join what is not
    joined yet (`open_units`): a group of near copies of one text costs as much
    as it has members.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    fits = (F.col("n") <= block_members) & (F.col("s") <= block_shingles)
    sized = members.join(sizes.select("grp", fits.alias("fits")), "grp")
    known = sieve(docs.where("doc_id is not null"), "doc_id", members, "doc_id")

    def texts(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c not in ("doc_id", "text_hash")]
        return rows.join(known, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", *keys])

    def compare(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks().sort_by("id")
        sets = _sets(unit, size)
        ids, own = unit.column("id").to_numpy(), unit.column("own").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        if i == j:
            links = linked(sets, None, percent)
        else:
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            links = np.zeros((len(sets), len(sets)), bool)
            if len(a) and len(b):
                links[np.ix_(a, b)] = linked([sets[k] for k in a], [sets[k] for k in b], percent)
            links |= links.T
        label = forest(links)
        new = label != np.arange(len(sets))
        if sum(map(len, sets)) > 100_000:
            del sets, links
            give_back()
        return pa.table({"a": pa.array(ids[label[new]], pa.int64()), "b": pa.array(ids[new], pa.int64())})

    none = F.lit(0).cast("long")
    units = sized.where("fits").select("grp", none.alias("i"), none.alias("j"), none.alias("own"), "id", "doc_id", "text_hash")
    large = written(sized.where("not fits").drop("fits"), "large")
    found = None
    if not large.isEmpty():
        found = written(hub_links(large, candidates, texts, percent, size, block_members, block_shingles), "hub_links")
        units = units.union(open_units(large, found, percent, block_members, block_shingles))
    links = texts(units).select("grp", "i", "j", "own", "id", "text").groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")
    return links.union(found) if found is not None else links


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 80, size: int = 5, bands: int | None = None, rows: int | None = None, block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for every row of `df`.

    Words are lower-cased in A-Z only.  Two texts are linked if their shingle
    sets meet the percentage; a component is named by its smallest id.  Null,
    empty and blank texts have no shingle and are linked with nothing.  A row
    with a null id keeps n_shingles, has a null component and is kept.  Equal
    rows get equal results; rows of one id with different texts are judged each
    by its own text.
    """
    if bands is None or rows is None:
        bands, rows = banding(percent)
    docs = short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = written(sign(docs, size, bands, rows), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    # Written once, so the numbers stay.
    reps = written(named.groupBy("k1", "k2").agg(first, F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")).select("k1", "k2", "first.*", "n_shingles", "bands", F.monotonically_increasing_id().alias("id")), "reps")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    candidates = written(keyed.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")), "candidates")
    groups = components(candidates).select(F.col("id"), F.col("component").alias("grp"))
    members = written(groups.join(reps.select("id", "doc_id", "text_hash", "n_shingles"), "id"), "members")
    links = verify(members, docs, candidates, percent, size, block_members, block_shingles)
    found = components(links).select("id", F.col("component").alias("root"))
    placed = reps.select("k1", "k2", "id", "doc_id").join(found, "id", "left")
    heads = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    by_set = placed.join(heads, "root", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("component"))
    out = signed.drop("bands").join(by_set, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
