"""Ranked lexical search over sharded inverted lists with blocks of variable length.

Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and characters from U+0080 on, known by 64-bit hashes. With N documents that hold
a term, L terms in all, n in the document, df documents with the term and tf occurrences in the document:

    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))    m = 25 + (75 n N) div L    score = sum over the query's terms of w * ((10^9 tf) div (1000 tf + 8 m))

index() deals documents into shards. A shard numbers its documents by length, so that neighbours score alike, and each term's list of impacts (what w
is multiplied with) is cut into blocks by dynamic programming: each block pays a fixed cost and the sum of what its bound, its largest impact, exceeds
its entries by. search() holds each query against each shard: between the block boundaries of its lists the bounds add up to one number for each range of
documents. Ranges are visited from the highest bound down, and all whose bound is below the k-th best score so far are skipped, without their
blocks being read. What is skipped can't be among the best, so results are exact. The best of all shards are ranked together.

Scale: texts are read once; what is shuffled is (term, tf) of documents to their shard, and the lists to the search. A shard holds about SHARD entries
at any size of the corpus, so a task's memory is bounded; documents are dealt by their place in a written table, so neither equal ids nor equal texts meet in
one. index() can be told the queries' vocabulary, and then leaves other terms out. Queries go to tasks in blocks of QUERY_TERMS terms.

Defined results: a null text has no term. Documents without a term, and queries without one, have no result. Each row is a document, and each row of queries a
query, whatever ids repeat; a null doc_id ranks before others of equal score. Very long texts count whole. Columns besides those named, whatever their
names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, cut, give_back, word_hashes

#: Bytes that part terms.
PARTS = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    PARTS[_low:_high] = False
#: Entries of a shard, and shards at least.
SHARD, SHARDS = 1 << 20, 8
#: A block costs as much as so many entries that are a standard deviation below their bound; units of a block at most; entries of a long list's unit.
COST, WIDEST, UNIT = 16, 64, 4
#: Distinct terms that a task is told, and terms of a block of queries.
VOCABULARY, QUERY_TERMS = 1 << 20, 1 << 20
#: A null doc_id inside a shard.
NONE = -(1 << 63)


# ---- documents as terms


def forward(docs: DataFrame, key: str = "doc_id", vocabulary: np.ndarray | None = None) -> DataFrame:
    """id, n (terms, with repeats), and the distinct terms with their occurrences, of those in vocabulary (sorted unsigned hashes; None: all)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, run in chunks(batch.column(1).to_pylist()):
                hashes, ends = word_hashes(run, PARTS)
                lengths = np.diff(np.concatenate([[0], ends]))
                at = np.repeat(np.arange(len(run)), lengths)
                if vocabulary is None:
                    terms, place = np.unique(hashes, return_inverse=True)
                elif len(vocabulary):
                    terms, place = vocabulary, np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    there = vocabulary[place] == hashes
                    at, place = at[there], place[there]
                else:
                    terms, at, place = vocabulary, at[:0], at[:0]
                found, tf = np.unique(at * max(1, len(terms)) + place, return_counts=True)
                offsets = np.searchsorted(found, np.arange(len(run) + 1) * max(1, len(terms)))
                own = terms[found % max(1, len(terms))].view(np.int64) if len(found) else np.zeros(0, np.int64)
                where = pa.array(offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(where, pa.array(x)) for x in (own, tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array(lengths.astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])
            give_back()

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(count, "id long, n long, terms array<long>, tfs array<int>")


def vocabulary_of(queries: DataFrame) -> np.ndarray | None:
    """The sorted hashes of the terms of queries (text), or None if they are too many to tell every task."""
    terms = forward(queries.withColumn("_none", F.lit(None).cast("long")), "_none").select(F.explode("terms").alias("term")).distinct().limit(VOCABULARY + 1)
    found = [r["term"] for r in terms.collect()]
    return None if len(found) > VOCABULARY else np.sort(np.array(found, np.int64).view(np.uint64))


# ---- blocks


def boundaries(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Where the blocks of each list of impacts end, for the least sum of block costs and bound errors.

    Lists of like length go through the dynamic program together. Blocks have WIDEST units at most; a unit is an entry, and UNIT entries in
    lists of over 1024.
    """
    out: list[np.ndarray | None] = [None] * len(lists)
    step_of = lambda n: 1 if n <= 1024 else UNIT
    order = sorted(range(len(lists)), key=lambda i: (step_of(len(lists[i])), -len(lists[i])))
    at = 0
    while at < len(order):
        most, step = len(lists[order[at]]), step_of(len(lists[order[at]]))
        many, room = at, 1 + (1 << 22) // max(1, -(-most // step))
        while many < len(order) and many - at < room and step_of(len(lists[order[many]])) == step and len(lists[order[many]]) * 1.25 + 4 >= most:
            many += 1
        group = order[at:many]
        for i, ends in zip(group, _cut_alike([lists[i] for i in group], step), strict=True):
            out[i] = ends
        at = many
    return out


def _cut_alike(lists: list[np.ndarray], step: int) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in lists])
    units = -(-sizes // step)
    steps, n = int(units.max()), len(lists)
    high = np.zeros((n, steps * step))
    for row, x in zip(high, lists, strict=True):
        row[: len(x)] = x
    high = high.reshape(n, steps, step).max(2)
    cost = np.array([1 + COST * x.std() for x in lists])[:, None]
    # entries of a block of 1 .. WIDEST units; a list's last unit may be short
    width = (np.arange(WIDEST) + 1) * step
    short = units * step - sizes
    bound, before = np.zeros((n, WIDEST)), np.full((n, WIDEST), np.inf)
    before[:, 0] = 0
    chosen = np.zeros((n, steps + 1), np.int16)
    for t in range(1, steps + 1):
        own = high[:, t - 1 : t]
        bound[:, 1:] = np.maximum(bound[:, :-1], own)
        bound[:, :1] = own
        less = np.where(units == t, short, 0)[:, None]
        total = before + cost + bound * (width - less)
        best = total.argmin(1)
        chosen[:, t] = best
        before[:, 1:] = before[:, :-1]
        before[:, 0] = total[np.arange(n), best]
    out = []
    for k in range(n):
        ends, t = [], int(units[k])
        while t > 0:
            ends.append(min(t * step, int(sizes[k])))
            t -= int(chosen[k, t]) + 1
        out.append(np.array(ends[::-1], np.int32))
    return out


# ---- the index

INDEX = "shard int, term long, many int, docs array<int>, impacts array<int>, ends array<int>, bounds array<int>, ids array<long>"


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists in a row, and how many each has."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole]
    entries = [x.flatten().to_numpy(zero_copy_only=False) for x in parts]
    sizes = [np.diff(x.offsets.to_numpy()) for x in parts]
    return np.concatenate(entries) if entries else np.zeros(0, np.int64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """The lists of each shard, a row for each term, and one (term null) with the documents' ids; and N, the number of documents with a term."""
    rows = cut(forward(docs, vocabulary=vocabulary), "lexical-forward", texts=True)
    n_docs, n_terms, entries = (int(x or 0) for x in rows.filter("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first())
    shards = max(SHARDS, -(-entries // SHARD))
    dealt = rows.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table["id"].fill_null(NONE).to_numpy()
        n = table["n"].to_numpy()
        terms, sizes = _lists(table["terms"])
        tfs, _ = _lists(table["tfs"])
        place = np.empty(len(ids), np.int64)
        order = np.lexsort((ids, n))
        place[order] = np.arange(len(ids))
        at = np.repeat(place, sizes)
        m = np.repeat(np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n.tolist()], np.int64), sizes)
        tf = tfs.astype(np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        by = np.lexsort((at, terms))
        terms, at, impacts = terms[by], at[by], impacts[by]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        ends = np.append(starts[1:], len(terms))
        own = [impacts[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        blocks = boundaries(own)
        bounds = [np.maximum.reduceat(x, np.concatenate([[0], e[:-1]])) for x, e in zip(own, blocks, strict=True)]
        shard = table["shard"][0].as_py()
        flat = lambda xs, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs), kind))
        entries_of = lambda x: pa.ListArray.from_arrays(pa.array(np.append(starts, len(terms)).astype(np.int32)), pa.array(x))
        made = [
            pa.array(np.full(len(starts), shard, np.int32)), pa.array(terms[starts]), pa.array((ends - starts).astype(np.int32)),
            entries_of(at.astype(np.int32)), entries_of(impacts.astype(np.int32)), flat(blocks, pa.int32()), flat(bounds, pa.int32()), pa.array([None] * len(starts), pa.list_(pa.int64())),
        ]
        names = ["shard", "term", "many", "docs", "impacts", "ends", "bounds", "ids"]
        of_docs = [pa.array([shard], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int32()), *[pa.array([[]], pa.list_(pa.int32()))] * 4, pa.array([ids[order]], pa.list_(pa.int64()))]
        give_back()
        return pa.concat_tables([pa.table(made, names), pa.table(of_docs, names)])

    return cut(dealt.groupBy("shard").applyInArrow(build, INDEX), "lexical-index"), n_docs


# ---- search


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], ids: np.ndarray, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard for one query, as (ids, scores), and how many entries were read.

    lists: (docs, impacts, block ends, block bounds, weight) of each of the query's terms. scores: zeros for each document, left as they were.
    """
    at, change = [], []
    for docs, _, ends, bounds, weight in lists:
        first = np.concatenate([[0], ends[:-1]])
        at += [docs[first], docs[ends - 1] + 1]
        change += [bounds * weight, -bounds * weight]
    at, change = np.concatenate(at), np.concatenate(change)
    by = np.argsort(at, kind="stable")
    at, total = at[by], np.cumsum(change[by])
    # the bound of a range holds from its own boundary to the next
    last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    low, bound = at[last], total[last]
    high = np.append(low[1:], low[-1:])
    kept = np.flatnonzero(bound > 0)
    kept = kept[np.argsort(-bound[kept], kind="stable")]
    low, high, bound = low[kept], high[kept], bound[kept]
    width = np.cumsum(high - low)
    best_ids, best, read, done, goal = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 16 * k
    while done < len(low):
        least = best[-1] if len(best) == k else 1
        stop = min(int(np.searchsorted(-bound, -least, "right")), int(np.searchsorted(width, goal)) + 1)  # bounds as high as the k-th score may tie with it
        if stop <= done:
            if done < len(low) and bound[done] < least:
                break
            stop = done + 1
        ranges = done + np.argsort(low[done:stop])
        a, b = low[ranges], high[ranges]
        touched = []
        for docs, impacts, _, _, weight in lists:
            left, right = np.searchsorted(docs, a), np.searchsorted(docs, b)
            many = right - left
            n = int(many.sum())
            if n:
                where = np.repeat(left - np.cumsum(many) + many, many) + np.arange(n)
                own = docs[where]
                scores[own] += impacts[where] * weight
                touched.append(own)
                read += n
        if touched:
            own = np.unique(np.concatenate(touched))
            found = scores[own]
            scores[own] = 0
            good = found >= max(1, least)
            best_ids, best = np.concatenate([best_ids, ids[own[good]]]), np.concatenate([best, found[good]])
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        done, goal = stop, goal + max(goal, 1024)
    return best_ids, best, read


def search(lists: DataFrame, n_docs: int, queries: DataFrame, key: str = "item_id", k: int = 10) -> DataFrame:
    """query (a number for each row of queries), id, rank, doc_id, score: the k best documents of each query, those above 0. lists: as index() gives them."""
    counted = cut(forward(queries, key), "lexical-queries").filter("n > 0")
    total = counted.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // QUERY_TERMS))
    numbered = counted.withColumn("part", F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(parts)))
    found = [_part(lists, n_docs, numbered.filter(F.col("part") == p), p, k) for p in range(parts)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("part", "query").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query", "id", "rank", F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), "score")


def _part(lists: DataFrame, n_docs: int, queries: DataFrame, part: int, k: int) -> DataFrame:
    """The k best of each shard for one block of queries, which every task is told."""
    told = [(r["id"], r["terms"], r["tfs"]) for r in queries.select("id", "terms", "tfs").collect()]
    spark = lists.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for _, terms, _ in told for t in terms})], "term long")
    df = lists.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("many").alias("df"))
    weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in df.collect()}
    weighed = [(i, [(t, tf * weights[t]) for t, tf in zip(terms, tfs, strict=True) if weights.get(t, 0) > 0]) for i, terms, tfs in told]

    def run(table: pa.Table) -> pa.Table:
        terms = table["term"].to_pylist()
        docs, n_of = _lists(table["docs"])
        impacts, _ = _lists(table["impacts"])
        ends, n_ends = _lists(table["ends"])
        bounds, _ = _lists(table["bounds"])
        ids, _ = _lists(table["ids"])
        to, to_end, known = np.cumsum(n_of), np.cumsum(n_ends), {}
        for i, term in enumerate(terms):
            own, blocks = slice(to[i] - n_of[i], to[i]), slice(to_end[i] - n_ends[i], to_end[i])
            if term is not None:
                known[term] = (docs[own], impacts[own].astype(np.int64), ends[blocks].astype(np.int64), bounds[blocks].astype(np.int64))
        scores, out = np.zeros(len(ids), np.int64), []
        for number, (i, own) in enumerate(weighed):
            there = [(*known[t], w) for t, w in own if t in known]
            if there:
                best_ids, best, _ = best_of_shard(there, ids, k, scores)
                out += [(part, number, i, d, s) for d, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        give_back()
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["part", "query", "id", "doc_id", "score"])

    rows = lists.join(F.broadcast(wanted), "term", "left_semi").unionByName(lists.filter("term IS NULL"))
    return cut(rows.groupBy("shard").applyInArrow(run, "part int, query long, id long, doc_id long, score long"), "lexical-best")
