"""The prefix trie against one built by walking in plain Python: nulls, ties, repeats, deep and empty conversations, popular prefixes, clashing names."""

import hashlib
import random
import zlib

import duckdb
import pytest

from wayline.llm import trie
from wayline.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string, position string"


def turn_key(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def forks(rows):
    """conv_id -> its rebuilt turns."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, turn_key((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def walked(rebuilt):
    """A row for each node, from sets of members and a walk over all of a node's descendants."""
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    rows = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[node] if x)
        leaves = sum(x not in children for x in below[node])
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children.get(node, 0), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
in_order = lambda rows: sorted(tuple((x is not None, x if x is not None else 0) for x in r) for r in rows)


def talks(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(40), *range(100, 140), *range(205, 230), 317]:  # 200 is absent, and so is 300
        said = ["hello"] if c % 3 else []  # a popular first turn
        said += [draw.choice(["a", "b", "é" * 5, "", None]) for _ in range(draw.choice([0, 1, 2, 3, 9]))]
        rows += [(c, i if draw.random() < 0.9 else None, draw.choice(["user", "user", None, "assistant"]) if c % 2 else "user", x) for i, x in enumerate(said)]
    rows += [(c, i, "user", "same") for c in range(400, 470) for i in range(4)]  # one conversation many times
    rows += [(500, i, "user", "x" * (i % 3)) for i in range(60)] + [(501, i, "user", "x" * (i % 3)) for i in range(45)]  # deep
    rows += [(600, 0, "1", "2:x"), (601, 0, "1:2", "x"), (602, 1, "user", "y"), (602, 1, "user", "x"), (602, 1, "user", "x"), (603, 0, "user", "long " * 50_000)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk(spark, seed):
    rows = talks(seed)
    part, run = trie.PART, trie.RUN
    trie.PART, trie.RUN = 4, 40
    try:
        d = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)
        got = trie.tree(trie.forked(trie.numbered(d)))
        assert got.columns == [*COLUMNS, "digest"]
        assert in_order(got.select(COLUMNS).collect()) == in_order(walked(forks(rows)))
    finally:
        trie.PART, trie.RUN = part, run


def test_conversations_as_they_are(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 5, "user", "ho")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.tree(trie.plain(trie.numbered(d))).select(COLUMNS).collect()
    assert in_order(got) == in_order(walked({1: [("user", "hi"), ("assistant", "yes")], 2: [("user", "hi")], 3: [("user", "ho")]}))
    assert trie.tree(trie.plain(trie.numbered(d.limit(0)))).count() == 0


def test_ids_of_an_ending_cross_runs_and_tasks(spark):
    rows = [(bytes([n]) * 32, c) for n, size in ((0, 5000), (1, 1), (2, 40)) for c in range(-3, size)]
    run, trie.RUN = trie.RUN, 100
    try:
        d = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "digest binary, conv_id long").repartition(5)
        got = {bytes(r["digest"]): r["ends_sha256"] for r in trie.endings(d).collect()}
    finally:
        trie.RUN = run
    want = {n: hashlib.sha256(",".join(str(c) for m, c in rows if m == n).encode()).hexdigest() for n, _ in rows}
    assert got == want


def test_query_equals_sql(spark):
    for sf in ("0.001", "0.01"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf{sf}/conversations.parquet'")
        want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op13_prefix_trie']})").fetchall()
        got = QUERIES["op13_prefix_trie"](spark, f"/root/testdata/sf{sf}").select(COLUMNS).collect()
        assert in_order(got) == in_order(want)
