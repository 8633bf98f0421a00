"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit per rule; a policy is a versioned set of rules, that is a
mask, and applying it is one bitwise AND.  Ablations (what would each rule's
removal let through?) are aggregations over the failure bits alone.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as empty: it has no word
and fails `few_words`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slantree.llm.durable import short_batches
from slantree.llm.names import unused
from slantree.llm.text_arrays import CONTINUES, SPACE, TextBatch, pieces, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters_ascii")
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _measured(texts: pa.Array) -> pa.StructArray:
    x = TextBatch(texts)
    start, end, doc = x.words()
    hashes = x.hashes(start, end)
    filled = ~SPACE[x.bytes] & ~CONTINUES[x.bytes]
    out = {
        "n_words": np.bincount(doc, minlength=x.n),
        "word_chars": x.per_doc(filled),
        "n_symbols": x.per_doc(_SYMBOL[x.bytes]),
        "n_upper": x.per_doc(_UPPER[x.bytes]),
        "n_letters_ascii": x.per_doc(_LETTER[x.bytes]),
    }
    ls, le, ldoc = x.lines()
    worded = x.between(filled, ls, le) > 0
    ls, le, ldoc = ls[worded], le[worded], ldoc[worded]
    lhash = x.hashes(ls, le)
    order = np.lexsort((lhash, ldoc))
    again = (ldoc[order][1:] == ldoc[order][:-1]) & (lhash[order][1:] == lhash[order][:-1])
    out["n_lines"] = np.bincount(ldoc, minlength=x.n)
    out["n_dup_lines"] = np.bincount(ldoc[order][1:][again], minlength=x.n)
    gram, at = windows(hashes, doc, WINDOW)
    gdoc = doc[at]
    order = np.lexsort((gram, gdoc))
    same = (gdoc[order][1:] == gdoc[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(doc) + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=x.n)
    return pa.StructArray.from_arrays([pa.array(out[m].astype(np.int64)) for m in MEASURES], list(MEASURES))


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_measured(p) for p in pieces(texts)])


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of MEASURES to each row, in one pass over each whole text; columns of these names are replaced, others stay."""
    own = unused(df, "_m")
    out = short_batches(df).withColumn(own, _measure(F.col(text_col)))
    return out.withColumns({m: F.col(f"{own}.{m}") for m in MEASURES}).drop(own)


#: Rule k is bit k of `fail_bits`; rules are only ever appended, so that old ledgers stay readable.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols_per_word": "100 * n_symbols > 20 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "shouting": "n_letters_ascii >= 40 AND 100 * n_upper > 60 * n_letters_ascii",
}
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, Sequence[str]] = {"v1": BASE, "v2": tuple(RULES)}


def mask(names: Sequence[str], rules: Mapping[str, object] = RULES) -> int:
    at = {name: k for k, name in enumerate(rules)}
    return sum(1 << at[name] for name in set(names))


def ledger(measured: DataFrame, rules: Mapping[str, Column | str] = RULES) -> DataFrame:
    """Add `fail_bits` (long): bit k is set if rule k fails; an unknown (null) outcome is not a failure."""
    bits = F.lit(0).cast("long")
    for k, test in enumerate(rules.values()):
        failed = F.expr(test) if isinstance(test, str) else test
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def fails(names: Sequence[str], bits: str = "fail_bits", rules: Mapping[str, object] = RULES) -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(names, rules)).cast("long")) != 0


def ablations(book: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Mapping[str, object] = RULES) -> DataFrame:
    """For each policy and rule of it: rows that fail the rule, that the policy rejects, and that only this rule rejects.

    The rows are first counted by `fail_bits` (at most 2**rules groups), so the
    policies and rules never meet the documents themselves.
    """
    counts = book.groupBy("fail_bits").agg(F.count("*").alias("n"))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))

    sums = []
    for policy, names in policies.items():
        hit = F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("long"))
        for name in names:
            bit = F.lit(mask([name], rules)).cast("long")
            sums.append(
                F.struct(
                    F.lit(policy).alias("policy"),
                    F.lit(name).alias("rule"),
                    total(F.col("fail_bits").bitwiseAND(bit) != 0).alias("n_failed"),
                    total(hit != 0).alias("n_rejected"),
                    total(hit == bit).alias("n_only_this"),
                )
            )
    return counts.agg(F.array(*sums).alias("sums")).select(F.inline("sums"))


def judge(df: DataFrame, text_col: str = "text", policy: str = "v2") -> DataFrame:
    """All columns of `df` plus measurements, `fail_bits`, `base_failed` and `kept` under `policy`.

    One row per input row; ties and repeated rows get equal verdicts.  Input
    columns with the names of new ones are replaced.
    """
    book = ledger(measure(df, text_col))
    base = fails(BASE)
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~fails(POLICIES[policy]))
