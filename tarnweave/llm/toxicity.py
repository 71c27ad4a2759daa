"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled texts, one on ordinary and one on toxic text; a
window is a run of WINDOW words, and windows overlap. A document's windows are compressed with either: what a
window saves when the toxic dictionary stands behind the ordinary one, against the ordinary one alone, says how
much toxic language it holds, as all that the two share costs the same. zstandard counts whole bytes, of which
a short window has few, so text is widened before it is compressed: each character becomes 8 bytes hashed from it
and those before it in its word, CONTEXT at most, and a sequence that a dictionary lacks costs 8 bytes a character.

Most windows of a toxic text are ordinary, so the toxic dictionary is trained in rounds. At first it gets those
windows that the ordinary dictionary explains worst; then, in each round, the dictionary of one half of the toxic
texts picks the windows of the other half that save more than nearly all ordinary windows do (the threshold is
that quantile, so it follows the data), and these train the next one. Last, the ordinary dictionary is extended
by ordinary windows that the toxic one would have shortened.

A few counts of a document's savings are turned into a score from 0 to 1 by a logistic curve, fitted on texts that
the dictionaries at work there have not seen (two halves score each other), and moved so that THRESHOLD lies where
it makes the fewest errors there. Constants were chosen by cross-validation among rows that aren't held out.

Fitting reads a bounded sample, in one task: at most SAMPLE_DOCS labelled documents of each label, those with the
smallest hashes of their ids, and of a text longer than SAMPLE_CHARS evenly spaced stretches of that many characters
in all. Scoring reads whole texts of all rows.

Null and empty texts have no windows and get the curve's value there; repeated rows get equal scores; of a doc_id
with several texts the smallest is learned from; where the labels hold no toxic or no ordinary row, or the
tables are empty, every score is the share of toxic labels (0 without any). Labels other than 0 and 1 and null labels
are not learned from; of several labels of one doc_id the largest holds. Columns of other names pass through unread.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept, materialise, table, text_batches

SAMPLE_DOCS, SAMPLE_CHARS, STRETCH = 4000, 20_000, 1000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
WINDOW = 3
#: Characters that a widened symbol depends on.
CONTEXT = 9
#: Sizes of the dictionaries before widening: ordinary, its extension, toxic. zstandard's segment and pattern lengths.
ORDINARY_BYTES, EXTENSION_BYTES, TOXIC_BYTES = 112_640, 65_536, 16_384
LONG_SEGMENT, SEGMENT, PATTERN = 64, 16, 8
#: Ordinary windows that train a dictionary and that set thresholds.
TRAINING_WINDOWS, MEASURED_WINDOWS = 150_000, 30_000
#: Quantiles of ordinary windows that a first toxic window's length and a chosen window's saving exceed; rounds of choosing.
POORLY, CLEARLY, ROUNDS = 0.9, 0.99, 3
#: Least saving, in bytes, that chooses a window, and that makes an ordinary one extend its dictionary.
LEAST, EXTENDS = 8, 20
#: Savings, in bytes, at which windows are counted; a saving below the first counts for nothing.
STEPS = (6, 10, 16, 22, 28, 40)
#: Distinct words that a worker remembers the widened form of.
MEMO = 300_000


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(own: list[str], step: int = 1) -> list[list[str]]:
    """Runs of WINDOW words, a new one each `step` words; all of fewer words."""
    return [own[i : i + WINDOW] for i in range(0, max(1, len(own) - WINDOW + 1), step)] if own else []


def symbols(word: str) -> list[bytes]:
    """8 bytes for each character of the word and for the space after it."""
    padded = f" {word} "
    return [hashlib.blake2b(padded[max(0, i - CONTEXT + 1) : i + 1].encode("utf-8", "surrogatepass"), digest_size=8).digest() for i in range(1, len(padded))]


class Widener:
    """Widened words, remembered."""

    def __init__(self):
        self.seen: dict[str, bytes] = {}

    def __call__(self, window: list[str]) -> bytes:
        if len(self.seen) > MEMO:
            self.seen.clear()
        out = []
        for word in window:
            wide = self.seen.get(word)
            if wide is None:
                wide = self.seen[word] = b"".join(symbols(word))
            out.append(wide)
        return b"".join(out)


def trained(samples: list[list[str]], size: int, segment: int, widen: Widener) -> bytes:
    """Widened content of the zstandard dictionary trained on windows; where these are too few to choose from, of all of them."""
    import zstandard

    texts = [f" {' '.join(w)} ".encode("utf-8", "surrogatepass") for w in samples]
    try:
        text = zstandard.train_dictionary(size, texts, k=segment, d=PATTERN).as_bytes()
    except zstandard.ZstdError:
        text = b"".join(dict.fromkeys(texts))[-size:]
    # the header of a trained dictionary reads as a few odd words, which match nothing
    return widen(text.decode("utf-8", "ignore").split())


def compressed_length(content: bytes):
    """Function that gives the compressed length of widened windows under a dictionary."""
    import zstandard

    # tables that hold every place of the dictionary, and matches of a whole symbol nearly
    tables = {"window_log": 23, "hash_log": 21, "chain_log": 21, "search_log": 3, "min_match": 7, "strategy": zstandard.STRATEGY_GREEDY}
    how = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(content), source_size=400, write_content_size=0, write_checksum=0, write_dict_id=0, **tables)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress
    return lambda wide: len(compress(wide))


class Savings:
    """Bytes that windows save with the toxic dictionary behind the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.alone, self.both = compressed_length(ordinary), compressed_length(ordinary + toxic)
        split = lambda content: {content[i : i + 8] for i in range(0, len(content), 8)}
        self.added = split(toxic) - split(ordinary)
        self.seen: dict[str, tuple[bytes, bool]] = {}

    def word(self, word: str) -> tuple[bytes, bool]:
        """Widened word; whether the toxic dictionary knows a symbol of it that the ordinary one does not."""
        found = self.seen.get(word)
        if found is None:
            own = symbols(word)
            found = self.seen[word] = b"".join(own), not self.added.isdisjoint(own)
        return found

    def of_words(self, own: list[str]) -> np.ndarray:
        """Savings of the words' windows that have a symbol which only the toxic dictionary knows; what others save comes from longer runs of shared language."""
        if len(self.seen) > MEMO:
            self.seen.clear()
        known = [self.word(w) for w in own]
        at = {max(0, i - k) for i, (_, new) in enumerate(known) if new for k in range(WINDOW)}
        last = max(0, len(own) - WINDOW)
        wide = [b"".join([w for w, _ in known[i : i + WINDOW]]) for i in sorted(at) if i <= last]
        return np.array([self.alone(w) - self.both(w) for w in wide], np.int64)

    def features(self, text: str) -> list[float]:
        own = words(text)
        saved = self.of_words(own)
        n = max(0, len(own) - WINDOW + 1)
        counts = [float((saved >= s).sum()) for s in STEPS]
        top = [*np.sort(saved[saved >= STEPS[0]])[::-1][:3], 0, 0, 0][:3]
        return [*np.log1p(counts), *(x / 40 for x in top), counts[1] / max(n, 20) * 20, counts[3] / max(n, 20) * 20, np.log1p(n) / 10]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def calibrate(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve, moved so that THRESHOLD lies where it makes the fewest errors on (x, y)."""
    z = x @ weights[:-1] + weights[-1]
    order = np.argsort(z)
    z, positive = z[order], y[order] == 1
    # errors with the threshold below the i-th value: the toxic below it and the ordinary from there on
    errors = np.concatenate([[0], np.cumsum(positive)]) + np.concatenate([np.cumsum(~positive[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(edges[best + 1] - edges[best])]
    moved = weights.copy()
    moved[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - (edges[at] + edges[at + 1]) / 2
    return moved


class Model:
    """What scoring needs: two dictionaries and a curve, or a constant where there was nothing to learn."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", weights: np.ndarray | None = None, constant: float = 0.0):
        self.ordinary, self.toxic, self.weights, self.constant = ordinary, toxic, weights, constant


def spread(items: list, most: int) -> list:
    """At most `most` of the items, evenly spaced."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def train_both(rows: list[tuple[int, bool, str]]) -> tuple[bytes, bytes] | None:
    """Widened contents of the ordinary and the toxic dictionary, from (label, half, text); None where there is too little to train on."""
    widen, same = Widener(), {}
    own = lambda text: [same.setdefault(w, w) for w in words(text)]  # noqa: E731  each distinct word is held once
    ordinary = [w for label, _, text in rows if not label for w in windows(own(text), WINDOW)]
    random.Random(6).shuffle(ordinary)
    ordinary = ordinary[:TRAINING_WINDOWS]
    toxic = [[], []]
    for i, text in enumerate(text for label, _, text in rows if label):
        toxic[i % 2] += windows(own(text), 2)
    if not ordinary or not toxic[0] or not toxic[1]:
        return None
    content = trained(ordinary, ORDINARY_BYTES, LONG_SEGMENT, widen)
    alone = compressed_length(content)
    lengths = lambda how, some: np.array([how(widen(w)) for w in some])
    measured = spread(ordinary, MEASURED_WINDOWS)
    of_measured, of_toxic = lengths(alone, measured), [lengths(alone, some) for some in toxic]
    poorly = np.quantile(of_measured, POORLY)
    chosen = [[w for w, n in zip(some, own) if n > poorly] or some for some, own in zip(toxic, of_toxic)]
    for _ in range(ROUNDS):
        new = [[], []]
        for half in (0, 1):  # one half's dictionary chooses windows of the other half
            both = compressed_length(content + trained(chosen[half], TOXIC_BYTES, SEGMENT, widen))
            least = max(LEAST, np.quantile(of_measured - lengths(both, measured), CLEARLY))
            saved = of_toxic[1 - half] - lengths(both, toxic[1 - half])
            new[1 - half] = [w for w, n in zip(toxic[1 - half], saved) if n >= least]
        if not new[0] or not new[1]:
            break
        chosen = new
    last = trained(chosen[0] + chosen[1], TOXIC_BYTES, SEGMENT, widen)
    both = compressed_length(content + last)
    shortened = [w for w, n in zip(ordinary, lengths(alone, ordinary) - lengths(both, ordinary)) if n >= EXTENDS]
    return (trained(shortened, EXTENSION_BYTES, SEGMENT, widen) if shortened else b"") + content, last


def fit(rows: list[tuple[int, bool, str]]) -> Model:
    """rows: (label, half, text). Dictionaries of either half score the other one, which the curve is fitted to; the model has dictionaries of both."""
    rows = list({(r[0], r[2]): r for r in rows}.values())  # copies of a text say nothing new
    labels = [r[0] for r in rows]
    share = float(np.mean(labels)) if labels else 0.0
    if not labels or share in (0.0, 1.0):
        return Model(constant=share)
    halves = [[r for r in rows if r[1]], [r for r in rows if not r[1]]]
    x, y = [], []
    for learn, rest in (halves, halves[::-1]):
        if dictionaries := train_both(learn):
            savings = Savings(*dictionaries)
            x += [savings.features(r[2]) for r in rest]
            y += [float(r[0]) for r in rest]
    dictionaries = train_both(rows)
    if not dictionaries or len(set(y)) < 2:
        return Model(constant=share)
    x, y = np.array(x), np.array(y)
    return Model(*dictionaries, weights=calibrate(fit_curve(x, y), x, y))


def _stretches(batches):
    for batch in batches:
        for some in text_batches(batch, "text"):
            apart = [STRETCH * max(1, -(-len(t) // SAMPLE_CHARS)) for t in some["text"].tolist()]
            yield some.assign(text=[t if n == STRETCH else " ".join(t[i : i + STRETCH] for i in range(0, len(t), n)) for t, n in zip(some["text"].tolist(), apart)])
    some = batch = None
    give_back()


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Model from at most `sample` rows of each label whose id isn't held out; half of them train the dictionaries, half the curve."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).withColumn("h", order).orderBy("h", "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 x sample short rows, which find their texts on the executors; these are cut there, one to a doc_id
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    own = own.select("h", "toxic", "text").mapInPandas(_stretches, f"h {types['h']}, toxic int, text string")
    rows = materialise(own.groupBy("h", "toxic").agg(F.min("text").alias("text")), "sample")

    def train(batches):
        give_back()
        got = sorted((r for batch in batches for r in batch[["h", "toxic", "text"]].itertuples(index=False)), key=lambda r: (r.h, r.text))
        half = lambda h: zlib.crc32(f"half{h}".encode()) % 2 == 0
        model = pickle.dumps(fit([(r.toxic, half(r.h), r.text) for r in got]), 5)
        del got
        give_back()
        yield pd.DataFrame({"model": [model]})

    return pickle.loads(rows.coalesce(1).mapInPandas(train, "model binary").first()["model"])


def _savings_of(model: Model) -> Savings:
    """One for a worker and model, so that later tasks find its memory filled."""
    key = zlib.crc32(model.toxic, zlib.crc32(model.ordinary))
    return kept(("savings", key), lambda: Savings(model.ordinary, model.toxic))


def scores(texts: list[str], model: Model) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.constant)
    savings = _savings_of(model)
    x = np.array([savings.features(t) for t in texts]).reshape(len(texts), -1)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def with_toxicity(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep (default: all) and score; a `score` of the input is replaced."""
    keep = [c for c in (keep or df.columns) if c != "score"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a dozen weights

    def score(batches):
        for batch in batches:
            for some in text_batches(batch, "__text"):
                yield some.drop(columns="__text").assign(score=scores(some["__text"].tolist(), shared.value))
        give_back(memo=False)  # later tasks find the memo filled

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double"
    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInPandas(score, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted (score of 0.7 or more)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return with_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
