"""Each language's threshold moves continuously with how many trusted unseen texts it has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import quality


@pytest.mark.parametrize("sizes", [{"aa": 6, "bb": 12, "cc": 20}, {"aa": 60, "bb": 80, "cc": 4}])
def test_languages_have_their_own_level(spark, sizes):
    rng = np.random.default_rng(3)
    letters = {"aa": "ab ", "bb": "cdefghij ", "cc": "klmnopqrstuvwxyz "}
    rows = [(lang, "".join(rng.choice(list(letters[lang]), 300))) for lang, n in sizes.items() for _ in range(2 * n)]
    d = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = d.select("doc_id", F.lit(1).alias("quality"))
    got = quality.judge(d, labels, F.col("doc_id") % 2 == 0).groupBy("lang").agg(F.max("threshold").alias("t"), F.max("perplexity").alias("p")).collect()
    level = {r["lang"]: r["t"] for r in got}
    assert level["aa"] < level["bb"] < level["cc"]
    assert level["aa"] < min(r["p"] for r in got if r["lang"] == "cc")
