"""Operator 3: language identification by Bayesian evidence fusion.

Four kinds of evidence give one posterior over the languages that were learned and `und` (none of them):

- the text: character trigrams of its words under each language, `und` being a uniform trigram source. Words
  of one text depend on each other, so n words count as n / (1 + n / DEPENDENCE);
- the markup: how often pages of each language declare this language in their html element;
- the address: how the other rows of its host and of the host's suffixes fall, a prior that shrinks from all rows to
  the last label, from there to the last two, the last three and the host. A row never counts towards its own prior.

The shares of the last two are sums of text posteriors by grouped aggregation over all rows. Trigrams are
learned from a bounded sample: at most SAMPLE_DOCS labelled documents of each language, those with the
smallest hashes of their ids. Every label is a language; more labels than `most` are refused with an error.

A null or empty text, or one without letters, has language `und` unless markup or address speak, and is never
accepted; null addresses share one host; repeated rows get the same posterior; of languages of equal confidence the
first in the alphabet is given; a text of any length is read whole; without labelled rows every row is `und`; an empty table gives an empty
result; other columns pass through where named in `keep`, except those that the result has itself (MADE), which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, text_batches
from .html_text import main_text

SAMPLE_DOCS = 2000
#: More labels than this aren't languages: learning refuses them.
LANGUAGES = 1000
UND = "und"
#: Columns that the result has itself; those of these names in `keep` are replaced.
MADE = ("n_words", "declared", "loglik", "own", "lang_id", "confidence", "accepted")
ALPHA = 0.5
DEPENDENCE = 50.0
#: Rows that a level's parent counts for in the address prior, and markup's pseudo-counts.
STRENGTH, MARKUP_STRENGTH = 10.0, 5.0
ACCEPT = 0.5
MEMO = 200_000
#: Numbers of a class and row that are fused together in memory.
ROW_NUMBERS = 1_000_000
WORD = re.compile(r"[^\W\d_]+")
#: The first html start tag outside comments, and the language in its attributes.
HTML_TAG = re.compile(r"<!--.*?(?:-->|$)|<html\b([^>]*)", re.I | re.S)
LANG = re.compile(r"(?:^|\s)(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def declared_language(html: str) -> str | None:
    """Language that the page's html element declares, in lower case."""
    tag = next((m for m in HTML_TAG.finditer(html) if m[1] is not None), None)
    found = LANG.search(tag[1]) if tag else None
    return found[1].lower() if found else None


class TextModel:
    """Log-likelihoods of words; the classes are the languages in order, then `und`."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: for each language, how often each trigram is in its sample."""
        self.languages = sorted(counts)
        self.classes = [*self.languages, UND]
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        for i, language in enumerate(self.languages):
            for gram, n in counts[language].items():
                grams[gram][i] = n
        size = len(grams) + 1
        totals = sum(grams.values()) if grams else np.zeros(len(self.languages))
        floor = np.log(ALPHA / (totals + ALPHA * size))
        uniform = -np.log(size)
        self.grams = {g: np.append(np.log((n + ALPHA) / (totals + ALPHA * size)), uniform).astype(np.float32) for g, n in grams.items()}
        self.unknown = np.append(floor, uniform).astype(np.float32)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.classes)), np.float32)

    def _place(self, word: str) -> int:
        if len(self.place) >= MEMO:
            self.place = {}
        at = len(self.place)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = sum(self.grams.get(g, self.unknown) for g in trigrams(word))
        self.place[word] = at
        return at

    def evidence(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words; log-likelihood of each class, words counted as dependent."""
        total, n = np.zeros(len(self.classes)), 0
        own = list(Counter(WORD.findall(text.lower())).items())
        for i in range(0, len(own), 50_000):  # the memo may be cleared between slices only
            some = own[i : i + 50_000]
            if len(self.place) + len(some) > MEMO:
                self.place = {}
            places = [self.place[w] if w in self.place else self._place(w) for w, _ in some]
            often = np.array([k for _, k in some], np.float64)
            total += often @ self.rows[places].astype(np.float64)
            n += int(often.sum())
        return n, total / (1 + n / DEPENDENCE)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """Of labelled(k, l), at most `sample` distinct pairs of each l: those whose k has the smallest hashes.

    Rows are thinned to about twice the sample by a hash before they meet by language.
    """
    pairs = labelled.select("k", "l").distinct().withColumn("u", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 40)) / float(1 << 40))
    sizes = pairs.groupBy("l").agg(F.count("*").alias("n"))
    thinned = pairs.join(F.broadcast(sizes), "l").where(F.col("u") * F.col("n") <= 2 * sample)  # a row for each language
    rank = F.row_number().over(W.partitionBy("l").orderBy("u", "k"))
    return thinned.withColumn("r", rank).where(F.col("r") <= sample).select("k", "l")


def learn(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE_DOCS, most: int = LANGUAGES) -> TextModel:
    """TextModel from at most `sample` rows of each language; only (language, trigram, count) of these reach the driver."""
    known = labelled.select(F.col(key).alias("k"), F.lower(F.trim(language)).alias("l"), F.col(text).alias("t")).where("l <> '' AND l <> 'und'")
    names = known.select("l").distinct().limit(most + 1).count()
    if names > most:
        raise ValueError(f"more than {most} languages are labelled")
    chosen = sampled(known, sample)
    own = known.join(F.broadcast(chosen) if sample * names <= 100_000 else chosen, ["k", "l"])
    words = own.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}\p{M}]+")).alias("w")).where("w <> ''").groupBy("l", "w").agg(F.count("*").alias("n"))
    padded = words.select("l", "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"))
    grams = padded.select("l", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring("p", i, F.lit(3)))).alias("gram"))
    counts: dict[str, dict[str, int]] = {}
    for r in grams.groupBy("l", "gram").agg(F.sum("n").alias("n")).collect():  # distinct trigrams of a bounded sample
        counts.setdefault(r["l"], {})[r["gram"]] = r["n"]
    return TextModel(counts)


def with_evidence(rows: DataFrame, model: TextModel, keep: list[str], text: str | None, html: str | None = None) -> DataFrame:
    """keep, n_words, declared, loglik (array by class) and own (the text's own posterior, null without words) of each row; the text is that column, or a page's main text."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = rows.sparkSession.sparkContext.broadcast(model)  # trigrams of a bounded sample

    def score(batches):
        own = shared.value
        for batch in batches:
            for some in text_batches(batch, "__content"):
                contents = some["__content"].tolist()
                declared = [None] * len(contents)
                if html:
                    declared = [declared_language(c) for c in contents]
                    contents = [main_text(c) for c in contents]
                found = [own.evidence(c) for c in contents]
                yield some.drop(columns="__content").assign(n_words=[n for n, _ in found], declared=pd.Series(declared, index=some.index, dtype=object), loglik=[x.tolist() for _, x in found], own=[softmax(x).tolist() if n else None for n, x in found])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_words long", "declared string", "loglik array<double>", "own array<double>"])
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(html or text), F.lit("")).alias("__content")).mapInPandas(score, schema)


def softmax(logs: np.ndarray) -> np.ndarray:
    """Along the last axis."""
    powers = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def address(url: Column) -> list[Column]:
    """Last label, last two, last three labels and all of a URL's host; '' where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return [*(F.substring_index(host, ".", -n) for n in (1, 2, 3)), host]


def fuse(evidence: DataFrame, classes: list[str], levels: list[Column]) -> DataFrame:
    """evidence with lang, confidence and accepted, from all of its rows' markup and addresses; levels: from the widest to the narrowest.

    evidence is read several times and should be a table. Sums are grouped with map-side combination, so a
    host of a third of all rows costs one row from each task; the join back carries short rows only.
    """
    at = [f"__l{i}" for i in range(len(levels))]
    names = [f"s{i}" for i in range(len(classes))]
    known = F.when(F.col("declared").isin(classes), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    rows = evidence.select("*", *[c.alias(a) for c, a in zip(levels, at)], known.alias("__declared"))
    sums = lambda: [F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)).alias(c) for i, c in enumerate(names)]
    counted = rows.where("own IS NOT NULL")
    hosts = counted.groupBy(*at).agg(*sums())
    up = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    # one row of all, and at most a row for each class and `other`
    everything = [float(x or 0) for x in up(hosts, []).first()]
    by_markup = {r["__declared"]: [float(r[c]) for c in names] for r in counted.where("__declared IS NOT NULL").groupBy("__declared").agg(*sums()).collect()}
    priors = hosts.select(*at, F.array(*names).alias(f"__s{len(at) - 1}"))
    for i in range(len(at) - 1):
        priors = priors.join(up(hosts, [at[i]]).select(at[i], F.array(*names).alias(f"__s{i}")), at[i])
    rows = rows.join(priors, at, "left")

    size, of_all = len(classes), np.array(everything)
    # at most a row of `size` numbers for each class and `other`, so a broadcast of at most LANGUAGES squared numbers
    spread = [(declared, np.log((np.array(counts) + MARKUP_STRENGTH / (size + 1)) / (of_all + MARKUP_STRENGTH)).tolist()) for declared, counts in by_markup.items()]
    rows = rows.join(F.broadcast(evidence.sparkSession.createDataFrame(spread, "__declared string, __markup array<double>")), "__declared", "left")
    counts = [f"__s{i}" for i in range(len(at))]
    names = [c for c in evidence.columns if c not in ("loglik", "own")]
    schema = ", ".join([*(f"`{c}` {evidence.schema[c].dataType.simpleString()}" for c in names), "lang_id string", "confidence double", "accepted boolean"])
    step = max(1, ROW_NUMBERS // size)

    def table_of(column: pd.Series) -> np.ndarray:
        return np.stack([np.zeros(size) if x is None else x for x in column])

    def posterior(pdf: pd.DataFrame) -> pd.DataFrame:
        own = table_of(pdf["own"])

        def shrink(of: np.ndarray, parent: np.ndarray) -> np.ndarray:
            """Shares of a level without the row itself, its parent's shares counting as STRENGTH rows."""
            rest = np.maximum(of - own, 0)
            return (rest + STRENGTH * parent) / (rest.sum(axis=1, keepdims=True) + STRENGTH)

        prior = shrink(of_all, np.full((1, size), 1 / size))
        for level in counts:
            prior = shrink(table_of(pdf[level]), prior)
        found = softmax(table_of(pdf["loglik"]) + np.log(prior + 1e-12) + table_of(pdf["__markup"]))
        confidence, worded = found.max(axis=1), pdf["n_words"].to_numpy() > 0
        languages = np.where(worded | pdf["declared"].notna().to_numpy(), np.array(classes, dtype=object)[found.argmax(axis=1)], UND)
        return pdf[names].assign(lang_id=languages, confidence=confidence, accepted=worded & (languages != UND) & (confidence >= ACCEPT))

    def fused(batches):
        for batch in batches:
            for start in range(0, len(batch), step):
                yield posterior(batch.iloc[start : start + step])

    return rows.select(*[F.col(f"`{c}`") for c in names], "loglik", "own", "__markup", *counts).mapInPandas(fused, schema)


def identify_documents(docs: DataFrame, model: TextModel, keep: list[str] | None = None) -> DataFrame:
    """keep (default: doc_id), lang_id, confidence, accepted, n_words; a document's source stands for its host."""
    keep = [c for c in keep or ["doc_id"] if c not in MADE]
    slim = materialise(with_evidence(docs.select(*keep, F.col("source").alias("__source"), F.col("text").alias("__text")), model, [*keep, "__source"], "__text"), "evidence")
    return fuse(slim, model.classes, [F.coalesce(F.col("__source"), F.lit(""))]).drop("__source", "declared")


def identify_pages(pages: DataFrame, model: TextModel, keep: list[str] | None = None) -> DataFrame:
    """keep (default: page_id, url), lang_id, confidence, accepted, n_words, declared; from a page's html and url."""
    keep = [c for c in keep or ["page_id", "url"] if c not in MADE]
    slim = materialise(with_evidence(pages.select(*{*keep, "url"}, "html"), model, list({*keep, "url"}), None, "html"), "evidence")
    return fuse(slim, model.classes, address(F.col("url"))).select(*keep, "lang_id", "confidence", "accepted", "n_words", "declared")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: kind ('document', 'page'), doc_id, page_id, lang_id, confidence, accepted, n_words."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = learn(docs)
    columns = ["lang_id", "confidence", "accepted", "n_words"]
    of_docs = identify_documents(docs, model).select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), *columns)
    of_pages = identify_pages(pages, model).select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), *columns)
    return of_docs.unionByName(of_pages)
