"""Reply trees against a plain walk from each leaf, with nulls, repeats, ties, cycles and clashing columns."""

import random

from pyspark.sql import functions as F

from wayline.llm import chat

SCHEMA = "id string, parent string, role string, text string, score double"


def walked(rows, best):
    """leaf -> (rank, ids from root to leaf), by walking up from each leaf."""
    known = {}
    for i, parent, role, text, score in rows:
        key = (parent is not None, parent or "", role or "", text or "", score or 0.0)
        if i is not None and (i not in known or key < known[i]):
            known[i] = key
    up = {i: (k[1] if k[0] and k[1] in known else None) for i, k in known.items()}
    trees = {}
    for leaf in set(known) - {p for p in up.values() if p is not None}:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            # summed from the leaf, as branch scores of quarters are exact in any order
            trees.setdefault(path[-1], []).append((-sum(known[i][4] for i in path) / len(path), leaf, path[::-1]))
    return {leaf: (rank, path) for found in trees.values() for rank, (_, leaf, path) in enumerate(sorted(found), 1) if best is None or rank <= best}


def forest(seed):
    draw = random.Random(seed)
    names = [f"m{i:03}" for i in range(120)]
    rows = []
    for i, name in enumerate(names):
        parent = draw.choice([None, "gone", *names[max(0, i - 12) : i]] if i % 9 else [None])
        rows.append((name, parent, draw.choice(["user", "assistant", None]), draw.choice(["", "x", None, "a<b&[c"]), draw.choice([None, 0.25, 0.5, 0.5, 1.0])))
    rows += draw.sample(rows, 15) + [(r[0], names[(i * 7) % 120], "user", "again", 0.25) for i, r in enumerate(draw.sample(rows, 10))]
    return [*rows, ("loop1", "loop2", "user", "c", 0.5), ("loop2", "loop1", "user", "c", 0.5), ("tail", "loop1", "user", "c", 0.5), (None, "m001", "user", "lost", 1.0)]


def test_paths_are_those_of_a_walk(spark):
    for seed, best in ((1, None), (2, 2), (3, 1)):
        rows = forest(seed)
        told = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("no")).withColumn("depth", F.lit(-1)).withColumn("leaf", F.lit("no"))
        paths = chat.branches(told, best)
        found = {}
        for r in paths.collect():
            found.setdefault((r["leaf"], r["branch_rank"]), []).append((r["position"], r["id"]))
        assert {leaf: (rank, [i for _, i in sorted(ids)]) for (leaf, rank), ids in found.items()} == walked(rows, best)
        back = chat.read_back(chat.format_paths(told, paths)).collect()
        assert {r["leaf"]: len(r["turns"]) for r in back} == {leaf: len(path) for leaf, (_, path) in walked(rows, best).items()}


def test_unique_ids_give_the_same_paths(spark):
    rows = list({r[0]: r for r in forest(4) if r[0]}.values())
    told = spark.createDataFrame(rows, SCHEMA)
    of = lambda unique: sorted(map(str, chat.read_back(chat.format_paths(told, chat.branches(told, 2, unique), unique)).collect()))
    assert of(True) == of(False)


def test_turns_without_a_conversation(spark):
    long = "long & <text> [" * 40000
    turns = spark.createDataFrame([(None, 1, "user", "b"), (None, 0, "user", long), (5, 0, None, None), (5, 0, None, None), (6, None, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    messages = chat.from_turns(turns.withColumn("score", F.lit(9)).withColumn("id", F.lit("no")))
    back = {r["root"]: r for r in chat.read_back(chat.format_paths(messages, chat.branches(messages, unique=True), unique=True)).collect()}
    assert {k: [t["text"] for t in r["turns"]] for k, r in back.items()} == {"null/1": [long, "b"], "5/1": ["", ""], "6/1": ["ok"]}
    assert back["6/1"]["under_mask"] == "ok"
    assert chat.from_turns(turns.limit(0)).count() == 0
