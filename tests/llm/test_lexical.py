"""Lexical search against a plain scorer, blocks against the best of all cuts, and what is skipped; nulls, ties, repeats, empty tables, long texts, clashing names."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from wayline.llm import lexical
from wayline.llm.queries import QUERIES, SQL

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERMS.findall(text or "")]


def ranked(docs, queries, k=10):
    """(query text, rank, doc_id, score), scoring every document for every query."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["The", "the", "ÉTÉ", "été", "naïve", "x1", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    say = lambda n: draw.choice([" ", "-", "\n", "\x7f", "_"]).join(draw.choices(vocabulary, weights, k=n))
    docs = [(i, say(draw.choice([1, 3, 20, 80, 400]))) for i in draw.sample(range(5000), 400)]
    docs += [(9000 + i, docs[0][1]) for i in range(60)] + docs[5:9] + [(None, docs[3][1]), (None, "w1"), (8001, None), (8002, ""), (8003, " -_ "), (8004, say(120_000))]
    queries = [(i, say(draw.choice([1, 2, 8, 30]))) for i in range(25)] + [(100, None), (101, "absent words"), (102, ""), (None, "w3 w9"), (7, "w2"), (103, docs[0][1])]
    draw.shuffle(docs)
    return docs, queries


def told(rows):
    return sorted(tuple((x is not None, x or 0) for x in r) for r in rows)


@pytest.mark.parametrize("restricted", [True, False])
def test_equals_a_plain_scorer(spark, restricted):
    docs, queries = corpus(3)
    d = spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in docs], "doc_id long, text string, n int, terms string, term string, shard int").repartition(5)
    q = spark.createDataFrame([(*r, 5) for r in queries], "item_id long, text string, doc_id int")
    lists, n_docs = lexical.index(d, lexical.vocabulary_of(q) if restricted else None)
    got = lexical.search(lists, n_docs, q)
    assert told(tuple(r) for r in got.select("id", "rank", "doc_id", "score").collect()) == told(ranked(docs, queries))
    if not restricted:
        assert lists.filter("term IS NOT NULL").select("term").distinct().count() == len({t for _, x in docs for t in terms(x)})


def test_queries_in_blocks_and_small_shards(spark):
    docs, queries = corpus(4)
    shard, block = lexical.SHARD, lexical.QUERY_TERMS
    lexical.SHARD, lexical.QUERY_TERMS = 300, 60
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        q = spark.createDataFrame(queries, "item_id long, text string")
        lists, n_docs = lexical.index(d)
        assert lists.select("shard").distinct().count() > 8
        got = lexical.search(lists, n_docs, q, k=4)
        assert told(tuple(r) for r in got.select("id", "rank", "doc_id", "score").collect()) == told(ranked(docs, queries, 4))
    finally:
        lexical.SHARD, lexical.QUERY_TERMS = shard, block


def test_empty_tables(spark):
    docs, queries = corpus(5)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    for some, asked in ((d.limit(0), q), (d, q.limit(0)), (d.filter("text IS NULL"), q)):
        assert lexical.search(*lexical.index(some, lexical.vocabulary_of(asked)), asked).count() == 0


def spent(impacts, ends):
    """Block costs and bound errors of a cut."""
    cost, total, at = 1 + lexical.COST * impacts.std(), 0, 0
    for e in ends:
        total += cost + sum(impacts[at:e].max() - impacts[at:e])
        at = e
    return total


def test_blocks_cost_least():
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 3, 7, 9, 10, 10, 12)] + [np.repeat([5, 90, 7], 4), np.full(9, 3)]
    for x, ends in zip(lists, lexical.boundaries(lists), strict=True):
        assert ends[-1] == len(x) and all(np.diff(ends) > 0)
        cuts = [[*(i + 1 for i in range(len(x) - 1) if mask >> i & 1), len(x)] for mask in range(1 << (len(x) - 1))]
        assert spent(x, ends) == pytest.approx(min(spent(x, c) for c in cuts))


def test_long_lists_are_cut_no_worse_than_evenly():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.integers(1, 500_000, n)) + rng.integers(0, 9000, n) for n in (1025, 1500, 5003, 800, 801)]
    for x, ends in zip(lists, lexical.boundaries(lists), strict=True):
        assert ends[-1] == len(x) and np.diff(np.concatenate([[0], ends])).max() <= lexical.WIDEST * lexical.UNIT
        for size in (16, 40, 64, 128):
            assert spent(x, ends) <= spent(x, [*range(size, len(x), size), len(x)])


def test_blocks_are_skipped():
    """Few entries are read where some documents score far above the others, and the result is that of reading all."""
    rng = np.random.default_rng(3)
    n, lists = 20_000, []
    for size in (15_000, 9000, 4000):
        docs = np.sort(rng.choice(n, size, replace=False))
        impacts = np.sort(rng.integers(1000, 500_000, size))[::-1].copy()
        ends = lexical.boundaries([impacts])[0].astype(np.int64)
        lists.append((docs, impacts, ends, np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]])), 3))
    scores, ids = np.zeros(n, np.int64), rng.permutation(n)
    got_ids, got, read = lexical.best_of_shard(lists, ids, 10, scores)
    whole = np.zeros(n, np.int64)
    for docs, impacts, *_, w in lists:
        whole[docs] += impacts * w
    order = np.lexsort((ids, -whole))[:10]
    assert got_ids.tolist() == ids[order].tolist() and got.tolist() == whole[order].tolist()
    assert read < 0.2 * sum(len(x[0]) for x in lists) and not scores.any()


def test_query_equals_sql(spark):
    for sf in ("0.001", "0.01"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
        want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({SQL['op12_lexical_search']})").fetchall()
        got = QUERIES["op12_lexical_search"](spark, f"/root/testdata/sf{sf}").select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(tuple(r) for r in got) == sorted(want) and len(got) > 100
