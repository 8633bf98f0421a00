"""Language identification with language-bitmask n-gram filters.

The languages' n-gram sets live in bit-sliced Bloom filters: slot p of the
filter holds a mask with one bit per language, so that ANDing the slots of an
n-gram returns all languages containing it at once.  Per document the bits are
counted by language, corrected for each language's false-positive rate, and
the largest corrected share wins.

Learning uses a bounded, documented sample of labelled rows (`MAX_DOCS` per
language, those with the smallest hash of their text); every language that has
a text there is learned.  Scoring covers every byte of every text, strip by
strip, so that its memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from slantree.llm.durable import short_batches, written
from slantree.llm.names import unused
from slantree.llm.text_arrays import LOWER, TextBatch, mix, pieces

#: Documents per language that are learned from; the bound of the sample.
MAX_DOCS = 2000
#: Lengths of the byte n-grams.
SIZES = (3, 4)
SLOTS_BITS = 20
HASHES = 2
#: An n-gram belongs to a language if at least so many of its sampled documents hold it (a third of them where they are few),
#: and if it is at least this share as frequent there as in the language where it is most frequent.
MIN_DOCS = 3
MIN_SHARE = 0.2
#: Languages of one mask; further ones have further masks.
MASK = 64
#: Bytes of text whose n-grams are held at a time.
STRIP = 1 << 17
_LETTER = regex.compile(r"\p{L}")


def _grams(x: TextBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit codes of the byte n-grams that hold no digit or punctuation, and their documents; word edges count as spaces.  A strip at a time."""
    for at in range(0, len(x.bytes), STRIP):
        raw = LOWER[x.bytes[at : at + STRIP + max(SIZES) - 1]]
        plain = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
        edge = np.where(plain, raw, 0x20).astype(np.uint64)
        for size in SIZES:
            n = min(STRIP, len(raw) - size + 1)
            if n <= 0:
                continue
            code = np.full(n, size, np.uint64)
            for k in range(size):
                code = (code << np.uint64(8)) | edge[k : k + n]
            here = np.flatnonzero(plain[1 : 1 + n] if size > 1 else plain[:n])
            doc = np.searchsorted(x.start, here + at, "right") - 1
            inside = here + at + size <= x.end[doc]
            yield code[here[inside]], doc[inside]


def _held_by(x: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of each document, and how many documents hold each."""

    def distinct(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, codes))
        codes, docs = codes[order], docs[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
        return codes[new], docs[new]

    parts = [distinct(*g) for g in _grams(x)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, _ = distinct(*(np.concatenate(c) for c in zip(*parts)))
    return np.unique(codes, return_counts=True)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # masks of MASK languages each x slots
    rates: np.ndarray  # false-positive rate per language
    typical: np.ndarray | None = None  # median share of n-grams held in the language's own learned texts; None: not measured

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """masks x codes: the languages that may hold each n-gram."""
        h, last = mix(codes), np.uint64(self.slots.shape[1] - 1)
        out = self.slots[:, (h & last).astype(np.int64)]
        for k in range(1, HASHES):
            out = out & self.slots[:, ((h >> np.uint64(k * SLOTS_BITS)) & last).astype(np.int64)]
        return out


def build_filters(grams: dict[str, np.ndarray], bits: int = SLOTS_BITS) -> Filters:
    """Bit-sliced Bloom filters of each language's n-gram codes."""
    languages = sorted(grams)
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    slots = np.zeros((max(1, -(-len(languages) // MASK)), 1 << bits), kind)
    for k, language in enumerate(languages):
        h = mix(grams[language])
        for j in range(HASHES):
            at = ((h >> np.uint64(j * SLOTS_BITS)) & np.uint64(slots.shape[1] - 1)).astype(np.int64)
            slots[k // MASK, at] |= kind(1 << k % MASK)
    rates = np.array([float(np.mean((slots[k // MASK] >> kind(k % MASK)) & kind(1))) ** HASHES for k in range(len(languages))])
    return Filters(languages, slots, rates)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, calibrate: bool = False) -> Filters:
    """Learn from at most `max_docs` rows per non-null language, chosen by the hash of the text alone.

    With `calibrate` the filters also hold each language's typical share, measured on the same rows.

    The sample is cut per partition first and then per language, so a language
    with any number of rows never meets in one task.
    """
    rows = short_batches(df).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Distinct texts count: copies must not thin out the sample.  One row per language.
    sizes = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n_texts"))
    # A threshold on the uniform hash keeps about 2 x max_docs texts a language, equal ones once; the exact cut follows on that small rest.
    near = rows.join(F.broadcast(sizes), "lang").where(F.abs(F.col("h").cast("double")) <= 2.0**63 * 2 * max_docs / F.col("n_texts"))
    near = near.drop("n_texts").dropDuplicates(["lang", "h"])
    own = W.partitionBy("lang")
    ranked = near.withColumns({"k": F.row_number().over(own.orderBy("h", "text")), "docs": F.least(F.count("*").over(own), F.lit(max_docs))})
    picked = ranked.where(F.col("k") <= max_docs).select("lang", "text", "docs")
    if calibrate:
        picked = written(picked, "sample")

    def count(batches):
        for batch in batches:
            for language in pa.compute.unique(batch.column("lang")).to_pylist():
                here = batch.filter(pa.compute.equal(batch.column("lang"), language))
                texts, n_docs = here.column("text"), here.column("docs")[0].as_py()
                for part in pieces(texts):
                    code, n = _held_by(TextBatch(part))
                    yield pa.record_batch([pa.array([language] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([n_docs] * len(code), pa.int64())], ["lang", "code", "n", "docs"])

    counts = picked.mapInArrow(count, "lang string, code long, n long, docs long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.max("docs").alias("docs"))
    shares = counts.where(F.col("n") >= F.least(F.lit(MIN_DOCS), F.ceil(F.col("docs") / 3))).withColumn("share", F.col("n") / F.col("docs"))
    top = shares.withColumn("top", F.max("share").over(W.partitionBy("code"))).where(F.col("share") >= MIN_SHARE * F.col("top"))
    # Bounded by the sample: max_docs documents a language, and n-grams found in MIN_DOCS of them.
    found = top.select("lang", "code").toPandas()
    languages = [r["lang"] for r in sizes.select("lang").collect()]
    filters = build_filters({k: np.zeros(0, np.uint64) for k in languages} | {k: v["code"].to_numpy().view(np.uint64) for k, v in found.groupby("lang")})
    if calibrate:
        # Written: filter and median would else each have the texts judged, in two Python workers a task.
        own = written(identify(picked, filters).select("lang", "lang_pred", "held"), "calibration").where(F.col("lang") == F.col("lang_pred"))
        medians = {r["lang"]: r["held"] for r in own.groupBy("lang").agg(F.percentile("held", 0.5).alias("held")).collect()}
        filters.typical = np.array([medians.get(k, 1.0) for k in filters.languages])
    return filters


def identify(df: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """Add `lang_pred`, `score` and `held` to each row.

    `score` is the winner's corrected count over the sum of all languages'
    corrected counts (0 to 1); ties go to the first language by name.  It tells
    the languages from each other only.  `held` is the winner's corrected count
    over all n-grams of the text: whether the text is of the language at all.
    A null text, or one without a letter, is ``und`` with both 0; a text whose
    n-grams no language holds is given the first language with both 0.
    """
    n = len(filters.languages)
    short_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(filters)  # 2**SLOTS_BITS masks, whatever the input

    @F.arrow_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("held", DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        own, names, scores, shares = shared.value, [], [], []
        for part in pieces(texts):
            x = TextBatch(part)
            total, held = np.zeros(x.n), np.zeros((max(1, n), x.n))
            for codes, docs in _grams(x):
                total += np.bincount(docs, minlength=x.n)
                hit = own.masks(codes)
                for k in range(n):
                    bit = (hit[k // MASK] >> hit.dtype.type(k % MASK)) & hit.dtype.type(1)
                    held[k] += np.bincount(docs[bit == 1], minlength=x.n)
            corrected = np.zeros((x.n, max(1, n)))
            for k in range(n):
                corrected[:, k] = np.maximum(0.0, (held[k] - own.rates[k] * total) / max(1e-9, 1 - own.rates[k]))
            best, whole = corrected.argmax(1), corrected.sum(1)
            most = corrected[np.arange(x.n), best]
            score = np.where(whole > 0, most / np.maximum(whole, 1e-300), 0.0)
            share = most / np.maximum(total, 1.0)
            for text, b, s, h in zip(part.to_pylist(), best, score, share):
                letter = n and text is not None and _LETTER.search(text)
                names.append(own.languages[b] if letter else "und")
                scores.append(float(s) if letter else 0.0)
                shares.append(float(h) if letter else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], ["lang_pred", "score", "held"])

    found = unused(df, "_p")
    out = df.withColumn(found, predict(F.col(text_col)))
    return out.withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score", "held")}).drop(found)


def held_out(doc_id: str = "doc_id"):
    """The contract's fold: crc32 of doc_id as text, modulo 4, is 2; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
