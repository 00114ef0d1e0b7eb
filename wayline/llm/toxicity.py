"""Toxicity by weak supervision.

Voters: a lexicon of each kind of entry (whole words, beginnings of words, pairs of words), mined apart by what goes with toxic labels, and fixed
patterns. A generative label model estimates by expectation-maximisation how often each voter fires on either class, and from what
it leaves unexplained how voters correlate; correlated voters share their evidence. Its posteriors, not the labels, then train a
linear classifier on the lexicons' entries and the patterns, which scores every whole text.

Fitting sees a bounded sample of labelled rows: the SAMPLE first by a hash of id and text. A lexicon holds every entry of the sample that is
strong enough (STRENGTH, a log-likelihood ratio, and PURITY), so its size is bounded by the sample. Scoring is one narrow pass.

Defined results: null and empty texts get the score of a text without any feature. Without labelled rows every score is 0. A repeated
doc_id with labels that disagree counts as toxic. Very long texts are scored whole. Rows without an id are scored and never learned from. Equal texts get equal
scores, and a score of just the level is toxic. Columns besides those named, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, chunks, cut, give_back, mix, without_rows, word_hashes

#: Rows of the sample at most, the least strength (log-likelihood ratio) of an entry, and the least share of toxic texts among those that hold it.
SAMPLE, STRENGTH, PURITY = 8000, 18.0, 0.9
#: A text is toxic from this score on.
LEVEL = 0.3
#: Kinds of entries, a lexicon each: whole words, beginnings of so many characters, and pairs of words.
BEGINNINGS = (4, 5)
KINDS = 2 + len(BEGINNINGS)

_PARTS = np.ones(256, bool)
_PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PATTERNS = 3


def entries(run: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: hashes of the entries of a run of texts, and each text's end. The kind is in the lowest bits of a hash."""
    words, ends = word_hashes(run, _PARTS)
    pairs = words * np.uint64(0xD1B54A32D192ED03) + np.append(words[1:], np.uint64(0))
    inside = np.ones(len(words), bool)
    inside[ends[ends > 0] - 1] = False  # a text's last word begins no pair
    found = [(words, ends), *(word_hashes(run, _PARTS, n) for n in BEGINNINGS), (pairs[inside], np.concatenate([[0], np.cumsum(inside)])[ends])]
    for kind, (hashes, at) in enumerate(found):
        yield ((mix(hashes) & ~np.uint64(KINDS - 1)) | np.uint64(kind)).view(np.int64), at


def patterns(raw: bytes) -> list[float]:
    """Fixed patterns: runs of exclamation marks, words in capitals, and words spelt with symbols in them, each 1 if it takes a large part of the text."""
    b = np.frombuffer(raw + b"  ", np.uint8)
    upper, letter = (b >= 0x41) & (b <= 0x5A), ((b | 32) >= 0x61) & ((b | 32) <= 0x7A)
    n = max(1, int(letter.sum()))
    marks = int(((b[:-1] == 0x21) & (b[1:] == 0x21)).sum())
    symbol = np.isin(b, np.frombuffer(b"*@#$%", np.uint8))
    inside = int((symbol[1:-1] & letter[:-2] & letter[2:]).sum())
    return [float(marks * 50 > n), float(int(upper.sum()) * 3 > n and n > 20), float(inside * 50 > n)]


@dataclass
class Model:
    keys: np.ndarray  # sorted entries
    weights: np.ndarray  # of the entries in that order, then of the patterns
    bias: float

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the texts hold: (text, entry) pairs without repeats, and patterns of each text."""
        rows, columns, marks = [], [], np.zeros((len(texts), PATTERNS))
        for first, run in chunks(texts):
            for hashes, ends in entries(run):
                at = np.searchsorted(self.keys, hashes) if len(self.keys) else np.zeros(len(hashes), int)
                hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes) if len(self.keys) else np.zeros(0, int)
                rows.append(np.searchsorted(ends, hit, "right") + first)
                columns.append(at[hit])
            for i, raw in enumerate(run):
                marks[first + i] = patterns(raw)
        pairs = np.unique(np.concatenate(rows or [np.zeros(0, int)]) * np.int64(len(self.keys) + 1) + np.concatenate(columns or [np.zeros(0, int)]))
        return pairs // (len(self.keys) + 1), pairs % (len(self.keys) + 1), marks

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, columns, marks = self.matrix(texts)
        n = len(self.keys)
        z = self.bias + marks @ self.weights[n:] + np.bincount(rows, self.weights[columns], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None, abstain: bool = False, rounds: int = 50) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """votes: 0/1 for each text and voter. Posterior of each text, and fire rates, correlations and shares of evidence of the voters.

    Expectation-maximisation, from start (a first guess for each text, such as an annotator's) or from the share of voters that fire. The
    guess itself is no voter: it anchors the rates, and no text's posterior depends on its own guess alone. A voter's evidence is divided by the correlations, within the classes, that tie it to others. abstain: a voter that
    doesn't fire says nothing, unless none does, which counts as often as it happens in either class.
    """
    n, k = votes.shape
    # voters that all but copy each other count as one from the start, or they would make a class of their own
    centered = votes - votes.mean(0)
    lengths = np.maximum(np.sqrt((centered**2).sum(0)), 1e-9)
    copies = 1 / np.maximum(1, ((centered.T @ centered) / np.outer(lengths, lengths) > 0.95).sum(1))
    level = votes @ copies if start is None else start
    q = np.clip(level / max(1e-9, level.max(initial=0)), 0.01, 0.99) if votes.any() else np.full(n, prior)
    share, correlation, rates = copies, np.eye(k), np.full((2, k), 0.5)
    for step in range(rounds):
        weight = np.stack([1 - q, q])
        if start is not None:  # the guess also counts as a prior of the rates, or the classes could drift away from it
            weight = (weight + np.stack([1 - start, start])) / 2
        rates = (weight @ votes + np.array([[0.02], [0.5]])) / (weight.sum(1, keepdims=True) + 1.0)
        if step % 5 == 4:  # what the classes leave unexplained
            rest = [votes - rates[y] for y in (0, 1)]
            covariance = sum((r * w[:, None]).T @ r for r, w in zip(rest, weight, strict=True)) / n
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            correlation = np.clip(covariance / np.outer(spread, spread), -1, 1)
            share = np.minimum(copies, 1 / np.maximum(1, np.abs(np.where(np.abs(correlation) > 0.1, correlation, 0)).sum(1)))
        if abstain:
            none = ~votes.any(1)
            silent = (weight @ none + np.array([0.5, 0.5])) / (weight.sum(1) + 1.0)
            gain = np.where(none, np.log(silent[1] / silent[0]), votes @ (share * np.log(rates[1] / rates[0])))
        else:
            gain = np.where(votes, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))) @ share
        new = 1 / (1 + np.exp(-np.clip(gain + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(new - q).max(initial=0) < 1e-6 and step > 10:
            q = new
            break
        q = new
    return q, {"rates": rates, "correlation": correlation, "share": share}


def linear(rows: np.ndarray, columns: np.ndarray, marks: np.ndarray, q: np.ndarray, k: int, rounds: int = 1000, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels q: gradient steps with momentum. Columns are (entries, patterns); the entries' part stays sparse."""
    n = len(q)
    w, b, vw, vb = np.zeros(k + marks.shape[1]), float(np.log((q.mean() + 1e-6) / (1 - q.mean() + 1e-6))), 0.0, 0.0
    rate = 4.0 / max(1.0, (len(rows) + marks.sum()) / n + 1)
    for _ in range(rounds):
        z = np.bincount(rows, w[columns], n) + marks @ w[k:] + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        step = np.concatenate([np.bincount(columns, off[rows], k)[:k], marks.T @ off]) / n + ridge * w
        vw, vb = 0.9 * vw - rate * step, 0.9 * vb - rate * float(off.mean())
        w, b = w + vw, b + vb
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model | None:
    """A model from at most sample labelled rows (labels: doc_id, toxic) where learn (on doc_id) holds."""
    known = labels.filter(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    n = known.count()
    if not n:
        return None
    rows = docs.select("doc_id", "text").withColumn("_at", F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text"))
    joined = rows.join(F.broadcast(known) if n <= BROADCAST_IDS else known, "doc_id")
    # repeated rows may be many for one id, so rows are bounded and not ids: a top-n, kept by each task before one ends it
    own = cut(joined.orderBy("_at").limit(sample).select("_at", "text", "_toxic"), "toxicity-sample")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for first, run in chunks(batch.column(0).to_pylist()):
                for found, ends in entries(run):
                    text = np.searchsorted(ends, np.arange(len(found)), "right")
                    order = np.lexsort((text, found))
                    found, text = found[order], text[order]
                    new = np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])]) if len(found) else np.zeros(0, bool)
                    found, text = found[new], text[new]
                    keys, at = np.unique(found, return_inverse=True)
                    sums = np.bincount(at, toxic[first + text], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, minlength=len(keys))), pa.array(sums)], ["entry", "n", "toxic"])

    counts = own.agg(F.count("*").alias("n"), F.sum("_toxic").alias("toxic")).first()
    if not counts["n"] or not counts["toxic"] or counts["toxic"] == counts["n"]:
        rate = (counts["toxic"] or 0) / max(1, counts["n"])
        return Model(np.zeros(0, np.int64), np.zeros(PATTERNS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    prior = counts["toxic"] / counts["n"]
    summed = own.select("text", "_toxic").mapInArrow(hashed, "entry long, n long, toxic long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / F.col("n")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    strength = 2 * (part(F.col("toxic"), F.col("n") * prior) + part(F.col("n") - F.col("toxic"), F.col("n") * (1 - prior)))
    strong = summed.filter((F.col("n") >= 3) & (rate >= PURITY) & (strength >= STRENGTH))
    keys = np.array(sorted(r["entry"] for r in strong.select("entry").collect()), np.int64)  # bounded: entries of the sample
    bare = Model(keys, np.zeros(len(keys) + PATTERNS), 0.0)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, marks = bare.matrix(batch.column(1).to_pylist())
            cuts = np.searchsorted(rows, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tolist() for x in np.split(columns, cuts)], pa.list_(pa.int32())), pa.array(marks.tolist(), pa.list_(pa.float64()))], ["at", "toxic", "columns", "marks"])

    found = own.mapInArrow(held, "at long, toxic int, columns array<int>, marks array<double>").collect()  # sample rows at most
    found.sort(key=lambda r: (r["at"], r["columns"], r["marks"]))
    rows = np.repeat(np.arange(len(found)), [len(r["columns"]) for r in found])
    columns = np.array([c for r in found for c in r["columns"]], int)
    marks = np.array([r["marks"] for r in found], float).reshape(-1, PATTERNS)
    votes = np.zeros((len(found), KINDS + PATTERNS))
    votes[rows, keys[columns] & (KINDS - 1)] = 1
    votes[:, KINDS:] = marks
    q, _ = label_model(votes, prior, np.array([r["toxic"] for r in found], float), abstain=True)
    weights, bias = linear(rows, columns, marks, q, len(keys))
    return Model(keys, weights, bias)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted (1: toxic) of each row of docs (doc_id, text)."""
    own = docs.select("doc_id", "text")
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= LEVEL).astype(np.int32))], ["doc_id", "score", "predicted"])
            give_back()

    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that are not judged toxic. Only ids and texts go through Python; rows are known by id and a hash of the text."""
    if model is None:
        return docs
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    toxic = cut(judge(own, model).filter("predicted = 1").select("doc_id.*"), "toxicity-rows", texts=True)
    return without_rows(docs, toxic)
