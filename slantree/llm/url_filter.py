"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

All glob rules are packed into one bit string: a bit for each literal of each
rule plus a final bit.  One pass over a canonical URL (lower-case host, then
path) advances every rule at once, and numpy advances a whole batch of URLs
together, so the cost does not depend on which rules match.

Glob syntax: ``*`` is any run of bytes without ``/``; ``**`` is any run of
bytes; everything else is literal.  A glob covers the whole canonical URL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from slantree.llm.names import unused

WORD = 63
#: Globs that an automaton may hold, and pairs of a url and a glob that are matched at a time.
MOST_GLOBS, MATCHED = 100_000, 1 << 24


@dataclass(frozen=True)
class Rule:
    """`verdict` for urls on `host` or a subdomain whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


#: The rules of the query contract.
CONTRACT_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Words in a host that mark unwanted sites when no rule fits; with and without a path.
BLOCKED_GLOBS = tuple(
    glob
    for word in ("casino", "cheap-pills", "viagra", "porn", "xxx", "torrent", "malware", "phishing")
    for glob in (f"*{word}*", f"*{word}*/**")
)


class Automaton:
    """Shift-And over bytes with self-loops for wildcards; all patterns stand one after another in one bit string.

    State bit k of a pattern means "the first k literals are read"; the wildcard
    before literal k lets bit k stay.  A pattern may begin in one machine word
    and end in another: the shift carries from each word to the next.
    """

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        literal, stay_any, stay_segment, first, final = [], [], [], [], []
        for glob in self.globs:
            raw, items, k = glob.encode(), [], 0
            loop = ""
            while k < len(raw):
                if raw[k : k + 2] == b"**":
                    loop, k = "**", k + 2
                elif raw[k : k + 1] == b"*":
                    loop, k = loop or "*", k + 1
                else:
                    items.append((raw[k], loop))
                    loop, k = "", k + 1
            first.append(len(literal))
            for byte, before in items:
                literal.append(byte)
                stay_any.append(before == "**")
                stay_segment.append(before == "*")
            literal.append(-1)
            stay_any.append(loop == "**")
            stay_segment.append(loop == "*")
            final.append(len(literal) - 1)
        self.first, self.final = np.array(first, int), np.array(final, int)
        bits = max(1, len(literal))
        self.words = -(-bits // WORD)
        self.take = np.zeros((257, self.words), np.uint64)
        self.stay = np.zeros((257, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        for k in range(len(literal)):
            word, bit = divmod(k, WORD)
            one = np.uint64(1 << bit)
            if literal[k] >= 0:
                self.take[literal[k], word] |= one
            if stay_any[k] or stay_segment[k]:
                self.stay[:256, word] |= one
            if stay_segment[k]:
                self.stay[ord("/"), word] &= ~one
        self.stay[256] = np.uint64(2**64 - 1)  # past the end of a url nothing moves
        for k in first:
            self.begin[k // WORD] |= np.uint64(1 << (k % WORD))

    def match(self, urls: Sequence[bytes], budget: int = 1 << 23) -> np.ndarray:
        """Boolean matrix: url x glob.  Urls of like length run together, so one long url does not pad the rest.

        `budget` bounds the bytes of a run: a url's symbols, and the words of its states.
        """
        out = np.zeros((len(urls), len(self.globs)), bool)
        lengths = np.array([len(u) for u in urls], int)
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * (2 * lengths[order[to]] + 32 * self.words) <= budget and lengths[order[to]] <= 2 * lengths[order[at]] + 64:
                to += 1
            part = order[at:to]
            out[part] = self._run([urls[k] for k in part], int(lengths[part].max(initial=0)))
            at = to
        return out

    def _run(self, urls: list[bytes], width: int) -> np.ndarray:
        symbols = np.full((len(urls), width), 256, np.int16)
        for k, url in enumerate(urls):
            symbols[k, : len(url)] = np.frombuffer(url, np.uint8)
        state = np.repeat(self.begin[None], len(urls), 0)
        mask, top = np.uint64((1 << WORD) - 1), np.uint64(WORD - 1)
        for k in range(width):
            at = symbols[:, k]
            moved = state & self.take[at]
            shifted = (moved << np.uint64(1)) & mask
            if self.words > 1:
                shifted[:, 1:] |= moved[:, :-1] >> top
            state = shifted | (state & self.stay[at])
        return (state[:, self.final // WORD] >> (self.final % WORD).astype(np.uint64)) & np.uint64(1) == 1


def read_globs(spark: SparkSession, path: str) -> list[str]:
    """Globs from text files, one a line; blank lines and lines that begin with # do not count, repeated ones count once.

    All tasks hold the automaton of all globs, so more than MOST_GLOBS are refused.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("glob")).where("glob <> '' and not startswith(glob, '#')").distinct()
    found = [r["glob"] for r in lines.orderBy("glob").limit(MOST_GLOBS + 1).collect()]
    if len(found) > MOST_GLOBS:
        raise ValueError(f"{path} has more than {MOST_GLOBS} globs")
    return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, url_col: str = "url", rules: Sequence[Rule] = CONTRACT_RULES, blocked: Sequence[str] = BLOCKED_GLOBS) -> DataFrame:
    """Add `host`, `path`, `rule` and `verdict` to each row.

    The longest rule that fits decides (of equally long ones an allowing rule,
    then the first by name).  Where no rule fits, `verdict` is ``block`` if a
    glob of `blocked` covers the canonical url, else ``allow``.  A null url, or
    one without ``://``, has an empty host and path, no rule and is allowed.
    Rows are never dropped or merged; the other columns stay, but columns named
    like the four new ones are replaced.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    automaton = Automaton([g for r in ranked for g in r.globs()] + list(blocked))
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked], object)
    n = len(ranked)
    step = max(1, MATCHED // max(1, len(automaton.globs)))
    found = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])

    @F.pandas_udf(found)
    def judge(canonical: pd.Series) -> pd.DataFrame:
        best, block = np.full(len(canonical), n), np.zeros(len(canonical), bool)
        for at in range(0, len(canonical), step):
            hit = automaton.match([u.encode() for u in canonical.iloc[at : at + step]])
            fits = hit[:, : 2 * n].reshape(len(hit), n, 2).any(2)
            best[at : at + step] = np.where(fits.any(1), fits.argmax(1) if n else n, n)
            block[at : at + step] = hit[:, 2 * n :].any(1)
        own = np.where(block, "block", "allow").astype(object)
        return pd.DataFrame({"rule": names[best], "verdict": np.where(best < n, np.append(verdicts, None)[best], own)})

    out = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    own = unused(out, "_judged")
    out = out.withColumn(own, judge(F.concat("host", "path")))
    return out.withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.col(f"{own}.verdict")}).drop(own)
