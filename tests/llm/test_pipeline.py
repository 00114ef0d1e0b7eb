"""The pipeline on real and on odd documents, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import minhash, quality, toxicity
from wayline.llm.shared import cut, fold_of

SF = "/root/testdata/sf0.001"


def test_stages_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), f"test-{name}")
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    before, after = seen["quality"]
    assert ids(before) - ids(after) == ids(quality.judge(before, labels, fold_of(F.col("doc_id")) == 2).filter("rejected"))
    before, after = seen["toxicity"]
    assert ids(before) - ids(after) == ids(toxicity.judge(before, toxicity.fit(before, labels, fold_of(F.col("doc_id")) != 2)).filter("predicted = 1"))
    before, after = seen["near_dedup"]
    assert ids(after) == ids(minhash.near_duplicates(before, 5, 80).filter("kept"))
    before, after = seen["mixing"]
    assert ids(after) <= ids(before) and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    before, after = seen["packing"]
    assert after.filter("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_stages_on_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "w " * 60_000, "en", "a", 1), (4, "plain words here", "en", None, 2), (4, "plain words here", "en", None, 2), (None, "no id at all", None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("_source", "score", "row", "id", "size", "length")})
    for some in (docs, docs.limit(0)):
        d = some
        for name, stage in corpus_pipeline.STAGES:
            d = cut(stage(spark, d, SF), f"odd-{name}")
            assert name == "packing" or d.columns == docs.columns
        assert d.isEmpty() == some.isEmpty()


def test_run_leaves_other_tables_alone(spark):
    """What somebody else writes while the pipeline runs stays, and of its own tables only the result does."""
    import os

    from wayline.llm.shared import recorded, shared_dir

    home = shared_dir(spark).removeprefix("file:")
    with recorded() as others:
        other = cut(spark.range(3), "other")
        before = set(os.listdir(home))
        found = corpus_pipeline.run(spark, SF)
        added = {x for x in set(os.listdir(home)) - before if os.path.isdir(os.path.join(home, x))}
    assert other.count() == 3 and len(others) == 1
    assert [x.split("-")[1] for x in added] == ["packing"] and found.count() > 0
