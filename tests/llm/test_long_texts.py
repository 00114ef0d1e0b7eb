"""Very long texts and clashing columns in operators that read whole texts."""

import public_tokenizers
from pyspark.sql import functions as F

from wayline.llm import langid, minhash, mixing, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n int, id long, size string, piece int, words int"


def documents(spark):
    long = " ".join(f"word{i % 9973}x{i}" for i in range(60_000))
    edited = long.replace("word17x17 ", "other ", 1) + " end"
    rows = [(1, long, "en", "a"), (2, edited, "en", "a"), (3, "short text", "en", "b"), (4, "word " * 60_000, "de", "b"), (5, None, None, None), (None, "short text", None, "b")]
    return spark.createDataFrame([(*r, 7, 8, "clash", 9, 10) for r in rows], SCHEMA)


def test_near_duplicates_and_sizes(spark):
    d = documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, 3, 85).collect()}
    assert got[1] == (59_998, 1, True) and got[2][1:] == (1, False) and got[4] == (1, 4, True) and got[3][1] == 3
    assert minhash.keep_one(d).columns == d.columns
    sizes = {r["doc_id"]: r["size"] for r in mixing.amounts(d).collect()}
    assert sizes[1] == 60_000 and sizes[2] == 60_001 and sizes[4] == 60_000 and sizes[5] == 0


def test_pieces_and_labels(spark):
    d = documents(spark)
    pieces = packing.pack(d, public_tokenizers.path("word_bpe_49k.json"), 2048)
    spans = {r["doc_id"]: r for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("many"), F.max(F.col("start") + F.col("length")).alias("end")).collect()}
    assert all(r["n"] == r["end"] and r["many"] == -(-r["n"] // 2048) for r in spans.values()) and spans[4]["n"] == 60_001 and spans[5]["n"] == 1
    model = langid.fit(d, F.lit(True))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, model).collect()}[5] == "und"
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.judge(d, toxicity.fit(d, labels, F.lit(True))).count() == 6
