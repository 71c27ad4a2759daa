"""Operator 13: periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period p and exponent MIN_EXPONENT or more that no neighbouring word extends keeping
that period. By the runs theorem every run contains, for one of two opposite orders of the words, a root that is the longest
Lyndon word at its own start. The longest Lyndon word at i ends before the next suffix that is smaller: the next smaller value of
the inverse suffix array. As a text here ends with a word that occurs nowhere else, the suffix array of the opposite order is the
reversed one, so its Lyndon words come from the next greater values. Roots are extended to both sides by longest common prefixes
(of the text, and of the reversed text), read from the LCP array by range minima in a sparse table; both arrays come from prefix doubling.

Each word of a run is in a three-word sequence that the document has three times or more (exponent 4 or more, length 6 or more), so other
words can't be in one: the arrays are built over the stretches of such sequences only, many documents at a time, each stretch closed by
a word of its own. For lower exponents or lengths whole texts are used.

Words are separated by ASCII white space. A null or empty text has no words and no runs; words are compared byte by byte; runs that
overlap are all reported, in order of start and period, so there are no ties; repeated rows and repeated or null doc_ids are rows
of their own; an empty table gives an empty result; a text of any length is worked on whole, in one task. Columns named in `keep`
pass through, except those that the result has itself (runs, n_words, collapsed), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Buckets in which three-word sequences are counted: a shared bucket keeps words that needn't be kept, and loses none.
BUCKETS = 1 << 21
#: Words for which arrays are built together, unless one document alone has more.
TOGETHER = 200_000
SPACES = "[ \\t\\n\\x0b\\f\\r]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks of all substrings of 1, 2, 4, ... letters, of a text whose last letter occurs once."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank, levels


def lcp_array(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the suffix array; 0 for the first."""
    n = len(order)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (np.maximum(a, b) + (1 << k)) <= n
        same = np.zeros(n - 1, bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        step = same.astype(np.int64) << k
        lcp[1:] += step
        # a text's end is a letter of its own, so equal substrings never reach it on both sides
        a, b = np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
    return lcp


class Minima:
    """Sparse table: minima of all stretches of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi] for each pair, all stretches not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k)])
        return out

    def next_smaller(self) -> np.ndarray:
        """For each place the next one with a smaller value, or the number of values."""
        values = self.rows[0]
        n = len(values)
        at = np.arange(1, n + 1)
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            inside = np.flatnonzero(at + (1 << k) <= n)
            at[inside[row[at[inside]] > values[inside]]] += 1 << k
        return at


class Prefixes:
    """Longest common prefixes of any two suffixes."""

    def __init__(self, s: np.ndarray):
        order, self.rank, levels = suffix_array(s)
        self.minima = Minima(lcp_array(order, levels))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        a, b = self.rank[i], self.rank[j]
        return self.minima.over(np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """start, length and period of all runs, by start and period, of a text (integers) whose last letter occurs once."""
    n = len(s)
    ahead, back = Prefixes(s), Prefixes(np.append(s[::-1], s.max() + 1))
    at = np.arange(n)
    found = []
    for ranks in (ahead.rank, n - 1 - ahead.rank):
        period = Minima(ranks).next_smaller() - at
        i = np.flatnonzero(at + (min_exponent - 1) * period <= n)  # true of the first root in a run, which begins in its first period
        i = i[i + period[i] < n]
        p = period[i]
        right = ahead.common(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.common(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        good = length >= np.maximum(min_length, min_exponent * p)
        found.append(np.stack([(i - left)[good], length[good], p[good]], 1))
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def repeated_stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that may hold runs of MIN_LENGTH words and exponent MIN_EXPONENT; hashes and document number of all words, in order."""
    n = len(hashes) - 2
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, d = hashes.view(np.uint64), doc.astype(np.uint64)
    mixed = (h[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[2:] * np.uint64(0x165667B19E3779F9)) ^ (d[:n] * np.uint64(0x27D4EB2F165667C5))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(43)).astype(np.int64)
    often = (np.bincount(bucket, minlength=BUCKETS)[bucket] >= 3) & (doc[:n] == doc[2:])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    first = edge[::2]
    # sequences of neighbouring documents can't touch, as one across the border is never often
    last = edge[1::2]
    long = last - first >= MIN_LENGTH - 2
    return first[long], last[long] + 2


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    words = [w for t in texts for w in t]
    if not words:
        return out
    doc, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    if min_length >= MIN_LENGTH and min_exponent >= MIN_EXPONENT:
        begin, end = repeated_stretches(np.fromiter(map(hash, words), np.int64, len(words)), doc)
    else:
        begin, end = starts[sizes > 0], (starts + sizes)[sizes > 0]
    # stretches that are worked on together
    group = (np.cumsum(end - begin) - 1) // TOGETHER
    for g in np.unique(group):
        some = np.flatnonzero(group == g)
        place = np.concatenate([np.append(np.arange(begin[k], end[k]), -1) for k in some])
        own = np.flatnonzero(place >= 0)
        s = np.empty(len(place), np.int64)
        s[own] = pd.factorize(np.array([words[k] for k in place[own]], dtype=object))[0]
        closing = np.flatnonzero(place < 0)
        s[closing] = len(words) + np.arange(len(closing))
        for start, length, period in runs_of(s, min_length, min_exponent).tolist():
            k = place[start]
            out[doc[k]].append((int(k - starts[doc[k]]), length, period))
    return out


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    runs = list(runs)
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept)])


def with_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Columns of keep (by default all but the text), n_words, runs (array of start, length, period by start and period) and collapsed (text without the repeats)."""
    made = ("n_words", "runs", "collapsed", "__text")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields)
    schema = f"{fields}, " * bool(names) + f"n_words long, runs {RUNS}, collapsed string"

    def of(batches):
        for batch in batches:
            for some in text_batches(batch, "__text"):
                texts = [t.encode().split() for t in some["__text"].tolist()]
                runs = runs_of_texts(texts, min_length, min_exponent)
                found = some[names].copy()
                found["n_words"] = [len(t) for t in texts]
                found["runs"] = [[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs]
                found["collapsed"] = [collapsed(t, r).decode() for t, r in zip(texts, runs)]
                yield found

    return docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).mapInPandas(of, schema)


def rewritten(text: Column, doc_id: Column) -> Column:
    """The text, or in every tenth document (by hash) one whose words repeat from some word on, as the contract of op13 sets it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeat), 1)).otherwise(text)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", rewritten(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = with_runs(docs, ["doc_id"])
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    longest = F.array_max(F.transform("runs", order))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
