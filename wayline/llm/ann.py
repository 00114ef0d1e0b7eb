"""Approximate nearest neighbours by additive quantisation, reranked exactly.

A vector is approximated by the sum of one word from each of STAGES full-dimensional codebooks, fitted stage by stage on the residuals
of a bounded sample. Encoding is a beam search over the stages. With the approximation's squared norm
stored beside the code, a query's squared distance needs one look-up for each stage: norm - 2 * sum(dot products of the query and the words).
The best approximate candidates of a query are measured again on the original vectors.

Rows lie in coarse cells (the nearest of some centroids of the sample). How many of its nearest cells a query looks into, and how many candidates
are measured again, is calibrated on the whole table: TRIALS vectors of the sample meet every row once, exactly and by code, and both
numbers are such that AIM of their true neighbours are within. So both follow the table, whatever its size; where vectors have no structure,
all cells are looked into. RERANK candidates are measured at least.

Scale: what meets queries is codes and norms, 48 bytes a row, once for each block of queries of a cell. A cell of any size is cut into
blocks of ROWS_BLOCK by hash, and a task holds one of them with about QUERIES_BLOCK queries. The blocks that a query looks into give SLACK times
as many candidates as are measured, nearer cells more than farther ones (k each at least), so candidates grow with the queries and not with queries
times blocks; the best of them are joined with their vectors, and k of those stay. Calibration reads the rows twice more, with TRIALS vectors, and
gives k rows for each of them.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of different
lengths are not compared; each length has its own codebooks, and a length that the sample lacks is measured exactly. Equal distances go to the smaller
id. With fewer candidates than k all are returned. Of rows with a repeated id each is a candidate, none for its own id's query. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embdedup import matrix, sound
from .shared import BROADCAST_IDS, cut

#: Codebooks, words in each, beam width, and vectors of the sample at most.
STAGES, WORDS, BEAM, SAMPLE = 24, 256, 2, 8192
#: Candidates of a query that are measured exactly at least, how many times as many its blocks give together, and queries whose vectors are broadcast at most.
RERANK, SLACK, BROADCAST_QUERIES = 300, 2, 20_000
#: Rows and queries in a block, rows for each coarse cell aimed at, and cells at most.
ROWS_BLOCK, QUERIES_BLOCK, PER_CELL, CELLS = 4096, 1024, 4096, 1024
#: Vectors of each length that calibrate, the share of their true neighbours that cells and candidates must hold, and queries scored at a time.
TRIALS, AIM, AT_ONCE = 64, 0.99, 32


def least(x: np.ndarray, width: int, strides: int = 16) -> np.ndarray:
    """Places of the `width` least values of each row, in any order: they lie in the groups (every so many places) with the least minima."""
    n, m = x.shape
    if m % strides or m // strides <= width:
        return np.argpartition(x, width - 1, axis=1)[:, :width]
    grouped = x.reshape(n, strides, -1)
    minima = grouped.min(1)
    groups = np.argpartition(minima, width - 1, axis=1)[:, :width]
    some = np.take_along_axis(grouped, groups[:, None, :], 2).reshape(n, -1)
    row, at = np.divmod(np.argpartition(some, width - 1, axis=1)[:, :width], width)
    return row * (m // strides) + np.take_along_axis(groups, at, 1)


@dataclass
class Quantiser:
    books: np.ndarray  # (stages, words, dimensions)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, stages) and squared norms of what they add up to; a beam search over the stages."""
        codes, norms = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        x = x.astype(np.float32)  # codes are approximate anyway
        squared = (self.books.astype(np.float32) ** 2).sum(2)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            rest, error = part[:, None, :], (part**2).sum(1)[:, None]
            held = np.zeros((n, 1, 0), np.uint8)
            for book, norm in zip(self.books.astype(np.float32), squared, strict=True):
                dots = (rest.reshape(-1, x.shape[1]) @ book.T).reshape(*rest.shape[:2], -1)  # one product for the whole part
                after = (error[:, :, None] + norm - 2 * dots).reshape(n, -1)
                best = least(after, min(beam, after.shape[1]))
                row, word = np.divmod(best, len(book))
                error = np.take_along_axis(after, best, 1)
                rest = np.take_along_axis(rest, row[:, :, None], 1) - book[word]
                held = np.concatenate([np.take_along_axis(held, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            first = error.argmin(1)
            codes[at : at + n] = held[np.arange(n), first]
            norms[at : at + n] = ((part - rest[np.arange(n), first]) ** 2).sum(1)
        return codes, norms

    def distances(self, query: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate squared distances, but for the query's own norm, by look-up tables; a row of them for each of several queries."""
        out = norms.copy() if query.ndim == 1 else np.repeat(norms[:, None], len(query), 1)
        for stage, book in enumerate(self.books):
            out -= (2 * (book @ query.T))[codes[:, stage]]
        return out.T


def train(sample: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 6, seed: int = 11) -> Quantiser:
    """Codebooks by k-means on the residuals that the books before leave."""
    rng, rest, books = np.random.default_rng(seed), sample.copy(), []
    for _ in range(stages):
        book = np.zeros((words, sample.shape[1]))
        book[: min(words, len(rest))] = rest[rng.choice(len(rest), min(words, len(rest)), replace=False)]
        for _ in range(rounds):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            sums, n = np.zeros_like(book), np.bincount(near, minlength=words)
            np.add.at(sums, near, rest)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
        books.append(book)
    return Quantiser(np.stack(books))


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    return np.sqrt(np.cumsum((rows - query) ** 2, axis=1)[:, -1])


@dataclass
class Index:
    """Of one length of vectors: the quantiser, the centroids of the coarse cells, and how many of them a query looks into."""

    quantiser: Quantiser
    centroids: np.ndarray
    probes: int

    def cells(self, x: np.ndarray, many: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        away = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(away, axis=1, kind="stable")[:, :many]


def learn(sample: np.ndarray, rows: int) -> Index:
    """An index for about so many rows like the sample; it looks into all cells until it is calibrated."""
    rng = np.random.default_rng(5)
    n = int(np.clip(rows // PER_CELL, 1, min(CELLS, len(sample))))
    centroids = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(8 if n > 1 else 0):
        near = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(1)
        many = np.bincount(near, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids[many > 0] = sums[many > 0] / many[many > 0, None]
    return Index(train(sample), centroids, n)


def calibrate(index: DataFrame, indexes: dict[int, Index], trials: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> int:
    """Sets each length's number of cells to look into; gives how many candidates by code hold AIM of the true neighbours.

    index: vec_id, v, size, cell, code, norm. trials: of each length the ids and the vectors that are compared with all rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                if int(size) in indexes:
                    codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    for at in range(0, len(part), ROWS_BLOCK):
                        some = slice(at, at + ROWS_BLOCK)
                        about = indexes[int(size)].quantiser.distances(trials[int(size)][1], codes[some], part["norm"].to_numpy()[some])
                        yield int(size), part.iloc[some], np.where(part["vec_id"].to_numpy()[some] == trials[int(size)][0][:, None], np.inf, about)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for size, part, about in rows(batches):
            x, asked = matrix(part["v"]), trials[size][1]
            away = np.where(np.isinf(about), np.inf, (x**2).sum(1) - 2 * asked @ x.T)
            near = np.argpartition(away, min(k, len(x)) - 1, axis=1)[:, :k]
            trial = np.repeat(np.arange(len(asked)), near.shape[1])
            found = pd.DataFrame({"size": size, "trial": trial, "away": away[trial, near.ravel()], "about": about[trial, near.ravel()], "cell": part["cell"].to_numpy()[near.ravel()]})
            found = pd.concat([best[size], found[np.isfinite(found["away"])]]) if size in best else found[np.isfinite(found["away"])]
            best[size] = found.sort_values("away", kind="stable").groupby("trial").head(k)
        yield from best.values()

    first = index.select("vec_id", "v", "size", "cell", "code", "norm").mapInPandas(nearest, "size int, trial int, away double, about double, cell int")
    place = F.row_number().over(Window.partitionBy("size", "trial").orderBy("away", "about"))
    truth = first.withColumn("n", place).filter(F.col("n") <= k).drop("n").toPandas()  # k rows for each trial
    if truth.empty:
        return 0
    held = {int(size): part for size, part in truth.groupby("size")}

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {size: np.zeros(len(part), np.int64) for size, part in held.items()}
        for size, _, about in rows(batches):
            about.sort(axis=1)
            if size in held:
                trial, limit = held[size]["trial"].to_numpy(), held[size]["about"].to_numpy()
                for one in np.unique(trial):
                    counts[size][trial == one] += np.searchsorted(about[one], limit[trial == one])
        for size, n in counts.items():
            yield pd.DataFrame({"size": size, "place": np.arange(len(n)), "n": n})

    depths = index.select("vec_id", "size", "code", "norm").mapInPandas(deeper, "size int, place int, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toPandas()
    for size, part in held.items():
        own = indexes[size]
        order = np.argsort(own.cells(trials[size][1], len(own.centroids)), axis=1)  # where each cell comes in a trial's list
        own.probes = int(np.quantile(order[part["trial"], part["cell"]], AIM, method="higher")) + 1
    return max(int(np.quantile(part["n"], AIM, method="higher")) + 1 for _, part in depths.groupby("size"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, rerank: int | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where is_query (on vec_id) holds, among all others.

    rerank: so many candidates are measured exactly; if not given, as many as calibration asks for.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    own = own.filter(sound(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("size", F.size("v"))
    drawn = own.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("vec_id", "v", "size").toPandas()  # SAMPLE vectors at most
    n = own.count()
    indexes = {int(size): learn(matrix(part["v"]), n * len(part) // len(drawn)) for size, part in drawn.groupby("size")}
    trials = {int(size): (part["vec_id"].to_numpy()[:TRIALS], matrix(part["v"][:TRIALS])) for size, part in drawn.groupby("size")}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                found = indexes.get(int(size))
                if found is None:
                    yield part.assign(cell=0, code=None, norm=0.0)
                else:
                    x = matrix(part["v"])
                    codes, norms = found.quantiser.encode(x)
                    yield part.assign(cell=found.cells(x, 1)[:, 0].astype(np.int32), code=[c.tobytes() for c in codes], norm=norms)

    element = own.schema["v"].dataType.simpleString()
    coded = own.mapInPandas(encode, f"vec_id long, v {element}, size int, cell int, code binary, norm double")
    # a row's number is as written: ids may be repeated
    index = cut(coded.withColumn("row", F.monotonically_increasing_id()), "ann-index")
    needed = calibrate(index, indexes, trials, k)
    rerank = rerank or max(RERANK, needed)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                found = indexes.get(int(size))
                to = np.zeros((len(part), 1), np.int32) if found is None else found.cells(matrix(part["v"]), found.probes)
                yield part.iloc[np.repeat(np.arange(len(part)), to.shape[1])].assign(cell=to.ravel().astype(np.int32), nth=np.tile(np.arange(1, to.shape[1] + 1, dtype=np.int32), len(part)))

    queries = own.filter(is_query).select("vec_id", "v", "size").withColumn("query", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "v"])
    queries = cut(queries, "ann-queries")
    asked = cut(queries.mapInPandas(probe, f"vec_id long, v {element}, size int, query long, cell int, nth int"), "ann-asked")
    place = ["size", "cell"]
    rows_in = index.groupBy(*place).agg(F.ceil(F.count("*") / ROWS_BLOCK).cast("int").alias("rows_blocks"))
    asked_in = asked.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES_BLOCK).cast("int").alias("queries_blocks"))
    blocks = cut(rows_in.join(asked_in, place), "ann-blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_IDS else blocks
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, many: F.pmod(F.xxhash64(c), F.col(many)).cast("int")
    left = index.select("row", "vec_id", "code", "norm", *place, F.when(F.col("code").isNull(), F.col("v")).alias("v")).join(blocks, place).withColumns({"rows_block": part("row", "rows_blocks"), "queries_block": every("queries_blocks")})
    met = asked.join(blocks, place)
    # a query's nth cell gives 1 / n of what its first gives, its blocks together; k at least and no more than are measured
    total = met.groupBy(F.col("query").alias("_query")).agg(F.sum(1 / F.col("nth")).alias("_total"))
    share = F.ceil(SLACK * rerank / (F.col("_total") * F.col("nth") * F.col("rows_blocks")))
    right = met.join(total, F.col("query") == F.col("_query")).withColumn("share", F.greatest(F.lit(k), F.least(F.lit(rerank), share)).cast("int")).drop("_query", "_total", "nth").withColumns({"queries_block": part("query", "queries_blocks"), "rows_block": every("rows_blocks")})

    def nearest(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values(["vec_id", "row"], kind="stable")
            ids, numbers, found = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), indexes.get(int(rows["size"].iloc[0]))
            if found is not None:
                codes, norms = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(ids), -1), rows["norm"].to_numpy()
            each = matrix(asked["v"])
            for at, (query, query_id, held) in enumerate(zip(asked["query"], asked["vec_id"], asked["share"], strict=True)):
                if found is None:
                    about = exact(each[at], matrix(rows["v"]))
                else:
                    if at % AT_ONCE == 0:
                        scored = found.quantiser.distances(each[at : at + AT_ONCE], codes, norms)
                    about = scored[at % AT_ONCE].copy()
                about[ids == query_id] = np.inf
                some = np.flatnonzero(ids != query_id)
                if len(some) > held:
                    limit = np.partition(about, held - 1)[held - 1]
                    some = np.flatnonzero(about < limit)
                    # equal codes are equally near: the smaller ids fill what is left
                    some = np.concatenate([some, np.flatnonzero(about == limit)[: held - len(some)]])
                out.append(pd.DataFrame({"query": query, "query_id": query_id, "vec_id": ids[some], "row": numbers[some], "about": about[some]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query", "query_id", "vec_id", "row", "about")})

    keys = [*place, "rows_block", "queries_block"]
    found = left.drop("rows_blocks", "queries_blocks").groupBy(*keys).cogroup(right.drop("rows_blocks", "queries_blocks").groupBy(*keys)).applyInPandas(nearest, "query long, query_id long, vec_id long, row long, about double")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("about", "vec_id", "row"))).filter(F.col("_n") <= rerank)
    own_vectors = queries.select("query", F.col("v").alias("q"))
    measured = best.join(index.select("row", F.col("v").alias("r")), "row").join(F.broadcast(own_vectors) if queries.count() <= BROADCAST_QUERIES else own_vectors, "query")
    # in double precision, components added in order
    squares = F.zip_with("r", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    measured = measured.select("query", "query_id", "vec_id", "row", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    ranked = measured.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
