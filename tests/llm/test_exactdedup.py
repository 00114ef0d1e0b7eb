"""Exact deduplication against groups in plain Python: files that come later, colliding digests, nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wayline.llm import exactdedup
from wayline.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, digest string, file string, row int, best string, n int, _metadata string"


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def written(spark, rows, path, mode="append"):
    clash = [(*r, "c", "f", 1, "b", 2, "m") for r in rows]
    spark.createDataFrame(clash, SCHEMA).repartition(3).write.mode(mode).parquet(path)
    return path


def judged(rows, found):
    """The rows of found against groups of equal texts; exactly one row of each is kept."""
    groups = {}
    for i, text in rows:
        groups.setdefault(plain(text), []).append(i)
    assert len(found) == len(rows)
    kept = {}
    told = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found}
    want = {(i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids}
    assert told == want
    for r in found:
        kept[r["digest_of"]] = kept.get(r["digest_of"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    return kept, groups


def corpus(seed):
    draw = random.Random(seed)
    texts = [None, "", "A", "a", "É", "é", "x" * 400_000, "X" * 400_000, "tab\t", "tab\t ", "kK"] + ["".join(draw.choice("abAB \n") for _ in range(draw.randrange(4))) for _ in range(60)]
    rows = [(i, draw.choice(texts)) for i in range(300)] + [(1000 + i, "hot") for i in range(150)]
    rows += draw.sample(rows, 20) + [(None, "a"), (None, "a"), (None, "only")]
    draw.shuffle(rows)
    return rows


#: The last one is always the same: all texts collide.
DIGESTS = {"sha": exactdedup.sha256, "byte": lambda x: F.unhex(F.substring(F.sha2(x.cast("binary"), 256), 1, 2)), "none": lambda x: F.lit("same").cast("binary")}


@pytest.mark.parametrize("name", DIGESTS)
def test_equals_plain_groups(spark, tmp_path, name):
    rows = corpus(4)
    path = written(spark, rows, str(tmp_path / "docs"))
    share, exactdedup.SHARE = exactdedup.SHARE, 7
    try:
        found = exactdedup.duplicates(spark, path, digest=DIGESTS[name]).withColumn("digest_of", F.hex("digest")).collect()
    finally:
        exactdedup.SHARE = share
    kept, groups = judged(rows, found)
    assert sum(kept.values()) == len(groups)
    if name == "sha":
        assert set(kept.values()) == {1}
        assert {r["digest_of"].lower() for r in found} == {hashlib.sha256(x.encode()).hexdigest() for x in groups}


def test_state_goes_on_when_files_come(spark, tmp_path):
    """A copy is found in files that come later, and only those are read."""
    first, second = corpus(5), [*corpus(6), (5000, "hot")]
    path, home = written(spark, first, str(tmp_path / "docs")), str(tmp_path / "home")
    judged(first, exactdedup.duplicates(spark, path, home).withColumn("digest_of", F.hex("digest")).collect())
    logged = exactdedup.log(spark, home).count()
    written(spark, second, path)
    found = exactdedup.duplicates(spark, path, home).withColumn("digest_of", F.hex("digest")).collect()
    kept, groups = judged(first + second, found)
    assert sum(kept.values()) == len(groups) and exactdedup.log(spark, home).count() == logged + len(second)
    state = {bytes(r["digest"]): r for r in exactdedup.groups(spark, home).collect()}
    assert state[hashlib.sha256(b"hot").digest()]["best"]["doc_id"] == 5000 and len(state) == len(groups)
    # nothing new: nothing changes
    assert exactdedup.duplicates(spark, path, home).count() == len(found)


def test_empty_table(spark, tmp_path):
    path = written(spark, [], str(tmp_path / "docs"))
    found = exactdedup.duplicates(spark, path)
    assert found.count() == 0 and found.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]


def test_settings_are_put_back_and_no_python_runs(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    found = QUERIES["op11_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({SQL['op11_exact_dedup']})").fetchall()
    got = [tuple(r) for r in QUERIES["op11_exact_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got) == sorted(want)
