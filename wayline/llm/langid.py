"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD, with calibrated rejection.

Subwords are the runs of 2 to 4 bytes inside a word of letters and its two edges (A-Z lower-cased, other ASCII bytes
taken as blanks), hashed to DIM embeddings. A text is the mean of its subwords' embeddings; since what follows is linear, a
fitted model is one table (subword, language) and scoring is a look-up and a mean over the whole text.

Fitting sees a bounded sample (PER_LABEL rows at most of each language, by hash of id and text), so model and fit don't
grow with the table; scoring is one narrow pass. A temperature, fitted on a fifth of the sample, turns scores into probabilities, and the
least probability at which accepted predictions of that fifth err at most max_error of the time is the rejection level (column accepted).

Defined results: null texts and texts without a letter are "und" with score 0. With nothing to learn from, every
text is "und"; with one language, each text with letters gets it. Equal scores go to the smaller label. Very long texts are read whole. Repeated rows each get
their result, and so do rows without an id, which may be learned from. Columns besides those named, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, joined

#: Hashed subwords, embedding size, and rows of the sample at most for each language.
DIM, WIDTH, PER_LABEL = 1 << 15, 16, 400
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
#: An odd multiplier for each length.
_TIMES = {2: np.uint32(2654435761), 3: np.uint32(2246822519), 4: np.uint32(3266489917)}


def subwords(buffer: np.ndarray) -> list[np.ndarray]:
    """For each length an array as long as the buffer: the subword that begins at each byte, or DIM where none does."""
    b = np.concatenate([_LETTER[buffer], np.full(3, 0x20, np.uint8)])
    n = len(buffer)
    blank = b == 0x20
    wide = b.astype(np.uint32)
    packed, out = wide[:n].copy(), []
    inner = np.zeros(n, bool)  # a blank strictly inside
    for length in (2, 3, 4):
        packed |= wide[length - 1 : n + length - 1] << np.uint32(8 * (length - 1))
        if length > 2:
            inner |= blank[length - 2 : n + length - 2]
        none = inner | (blank[:n] & blank[length - 1 : n + length - 1])
        ids = ((packed * _TIMES[length]) >> np.uint32(32 - 15)).astype(np.int32)
        ids[none] = DIM
        out.append(ids)
    return out


def parted(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the run, each text after a blank of its own and before the next one's, and where those blanks are: no subword spans two texts."""
    buffer, starts = joined(run)
    return np.concatenate([np.full(1, 0x20, np.uint8), buffer]), starts


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct subwords and their shares."""
    out = []
    for _, run in chunks(texts):
        buffer, starts = parted(run)
        ids = subwords(buffer)
        for low, high in zip(starts, np.append(starts[1:], len(buffer)), strict=True):
            counts = np.bincount(np.concatenate([x[low:high] for x in ids]), minlength=DIM + 1)[:DIM]
            found = np.flatnonzero(counts)
            out.append((found.astype(np.int32), (counts[found] / max(1, counts.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (DIM + 1, labels): logits of each subword; the last row is 0
    bias: np.ndarray
    temperature: float
    level: float  # least accepted probability

    def logits(self, run: list[bytes]) -> np.ndarray:
        buffer, starts = parted(run)
        total, n = np.zeros((len(run), len(self.labels))), np.zeros(len(run))
        for ids in subwords(buffer):
            n += np.add.reduceat((ids < DIM).astype(np.int64), starts)
            for k in range(len(self.labels)):
                total[:, k] += np.add.reduceat(self.table[:, k][ids], starts, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index and calibrated probability of the likeliest label of each text."""
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        for first, run in chunks(texts):
            p = softmax(self.logits(run) / self.temperature)
            best[first : first + len(run)] = p.argmax(1)
            score[first : first + len(run)] = p.max(1)
        return best, score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], epochs: int = 12, rate: float = 2.0, seed: int = 7, max_error: float = 0.01) -> Model:
    """Stochastic gradient descent, one text at a time, a falling rate; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    k = len(labels)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (DIM, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    aside = np.arange(len(rows)) % 5 == 4
    fit, steps, at = np.flatnonzero(~aside), max(1, epochs * int((~aside).sum())), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, share = rows[i]
            step = np.float32(rate * (1 - at / steps))
            at += 1
            hidden = share @ embed[ids]
            p = softmax((hidden @ out + bias)[None])[0]
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            embed[ids] -= step * np.outer(share, back) * np.float32(len(ids) ** 0.5)
    table = np.vstack([embed @ out, np.zeros((1, k), np.float32)]).astype(np.float32)
    held = np.flatnonzero(aside) if aside.any() else fit
    logits = np.array([share @ table[ids] + bias for ids, share in (rows[i] for i in held)]).reshape(len(held), k)
    temperature, level = 1.0, 0.0
    if len(held):
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-9)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        order = np.argsort(-p.max(1))
        wrong = np.cumsum((p.argmax(1) != y[held])[order]) / np.arange(1, len(held) + 1)
        good = np.flatnonzero(wrong <= max_error)
        level = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return Model(labels, np.ascontiguousarray(table), bias.astype(float), temperature, level)


def drawn(known: DataFrame, per_label: int) -> tuple[DataFrame, list[str]]:
    """At most per_label rows of each language of known (doc_id, text, lang), as at, text and lang, and the languages.

    Rows are drawn by a hash of id and text: a share of about twice as many, equal rows once, and of those the least hashes. So rows are
    bounded, whatever ids are repeated or missing.
    """
    own = known.select(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text").alias("at"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()}  # a row for each language
    labels = sorted(counts)
    if not labels:
        return own, labels
    shares = known.sparkSession.createDataFrame([(x, min(1.0, 2 * per_label / max(1, counts[x]))) for x in labels], "lang string, _share double")
    chance = F.pmod(F.col("at"), F.lit(1 << 30)) / float(1 << 30)
    some = own.join(F.broadcast(shares), "lang").filter(chance < F.col("_share")).drop("_share").dropDuplicates(["lang", "at"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("at"), F.lit(1 << 30)), "at"))
    return some.withColumn("_place", place).filter(F.col("_place") <= per_label).select("at", "text", "lang"), labels


def fit(docs: DataFrame, learn: Column, per_label: int = PER_LABEL) -> Model | None:
    """A model from a bounded sample of the rows of docs (doc_id, text, lang) where learn holds and text and lang are not null."""
    sample, labels = drawn(docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()), per_label)
    if not labels:
        return None

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                own = bags(part["text"].tolist())
                yield pd.DataFrame({"at": part["at"].to_numpy(), "lang": part["lang"].to_numpy(), "ids": [x.tobytes() for x, _ in own], "shares": [x.tobytes() for _, x in own]})

    found = sample.mapInPandas(features, "at long, lang string, ids binary, shares binary").collect()
    found.sort(key=lambda r: (r["at"], r["lang"], r["ids"]))
    where = {x: i for i, x in enumerate(labels)}
    rows = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in found]
    return train(rows, np.array([where[r["lang"]] for r in found], int), labels)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row of docs (doc_id, text)."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = docs.select("doc_id", F.when(letters, F.col("text")).alias("text"))
    if model is None:
        return own.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                best, p = model.predict(texts)
                known = np.array([t is not None for t in texts], bool)
                p = np.where(known, p, 0.0)
                names = pa.array([model.labels[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(p), pa.array(known & (p >= model.level))], ["doc_id", "lang_pred", "score", "accepted"])

    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
