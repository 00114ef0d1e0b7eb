"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt into at most BLOCKS blocks by a hash of their id; a source's quota is a number of
block draws, full passes over its blocks and then a part of one more. The tree splits the quotas of all sources among output
shards: each node draws from a multivariate hypergeometric distribution how many draws of each source go left, so every
shard gets an exact number of blocks of each source. A shard takes the next draws in the source's permuted block
order, which makes the shards disjoint, and its rows are put in random order within the shard.

Words reach the target closely: the last draw takes a prefix of its block in hash order, and one more document, the
one whose size fits what is still missing best.

Scale: one narrow pass finds sizes; sums for (source, block) combine before they shuffle, and joins use (source,
block), so a source with a third of all rows is spread over BLOCKS keys. The driver sees one row for each source (weights repeat over
them), never documents: sources are a list that somebody keeps, and the tree draws for all of them together. Sides that have a row for
each source are broadcast up to BROADCAST_BLOCKS rows and shuffled beyond.

Defined results: null text has size 0; null source is a source of its own and comes last. Sizes of 0 are taken 0
words whatever the plan. Repeated ids stand or fall together, each row counting its own size. An empty table gives no
rows. Very long texts are counted whole. Columns besides those named, whatever their names, are not read, and mix() returns them as they are. Every
choice comes from hashes and a seed, so reruns agree. More than 10^9 draws of blocks in all, which is about 490,000 sources, raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BLOCKS = 1024
#: Rows of the plan (one for each source and block) that are broadcast at most; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def word_count(text: Column) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ a text holds; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share of all sizes, dealt by weight; a target stops at most times its source's size, the excess is dealt again until none is above."""
    caps, out = [most * s for s in sizes], [0.0] * len(sizes)
    left, free = min(share * sum(sizes), sum(caps)), [i for i in range(len(sizes)) if sizes[i]]
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] >= caps[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas of each source, split among shards: int array (shards, sources) whose columns add up to quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle = (low + high) // 2
        n = int(left.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        part = rng.multivariate_hypergeometric(left, n, method="marginals")
        node(low, middle, part)
        node(middle, high, left - part)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


@dataclass
class Plan:
    """blocks: source_key, block, draws (copy and shard of each draw), last (whether the last draw is cut short), cut (its hash limit), and the source's figures."""

    blocks: DataFrame
    seed: int

    def keyed(self, docs: DataFrame) -> DataFrame:
        return docs.withColumns(_keys(F.col("doc_id"), F.col("source"), self.seed))

    def draws(self) -> Column:
        """The draws that hold a row of keyed() joined with blocks."""
        return F.concat(
            F.filter("_draws", lambda d: ~d["part"] | (F.col("_order") <= F.col("_cut"))),
            F.when((F.col("_order") == F.col("_extra")) & (F.col("_block") == F.col("_extra_block")), F.array(F.struct(F.col("_full").alias("copy"), F.col("_extra_shard").alias("shard"), F.lit(True).alias("part")))).otherwise(F.array().cast("array<struct<copy:int,shard:int,part:boolean>>")),
        )


def _keys(doc_id: Column, source: Column, seed: int) -> dict[str, Column]:
    order = F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return {
        "_source": F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source)),
        "_order": order,
        "_block": F.pmod(F.xxhash64(F.lit("block"), order), F.lit(BLOCKS)).cast("int"),
    }


def plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 17) -> Plan:
    """sized: doc_id, source, size. weights repeat over the sources by code point, null last. share: of all sizes; most: times a source's size, 2 at most."""
    if not 0 < most <= 2:
        raise ValueError("most must be above 0 and at most 2")
    spark = sized.sparkSession
    keyed = cut(sized.select(*(c.alias(k) for k, c in _keys(F.col("doc_id"), F.col("source"), seed).items()), F.col("size").alias("_size")), "mix-sizes")
    blocks = cut(keyed.groupBy("_source", "_block").agg(F.sum("_size").alias("_words")), "mix-blocks")
    found = blocks.groupBy("_source").agg(F.sum("_words").alias("words"), F.count("*").alias("n")).collect()  # a row for each source
    found = sorted(found, key=lambda r: (r["_source"] == "~", r["_source"]))
    goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    rows = []
    for r, t in zip(found, goal, strict=True):
        full = min(2, int(t // r["words"])) if r["words"] else 0
        rows.append((r["_source"], r["words"], t, full, t - full * r["words"]))
    small = F.broadcast if len(rows) <= BROADCAST_BLOCKS else (lambda side: side)
    sources = spark.createDataFrame(rows, "_source string, _source_size long, _target double, _full int, _rest double")
    ordered = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_source", "_block"), "_block")
    ranked = blocks.withColumns({"_rank": F.row_number().over(ordered) - 1, "_upto": F.sum("_words").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(Window.partitionBy("_source"))})
    ranked = cut(ranked.join(small(sources), "_source").withColumns({"_whole": F.col("_upto") <= F.col("_rest"), "_last": (F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_words") < F.col("_rest"))}), "mix-ranked")
    # the block that the target cuts: its documents in hash order, as far as they fit
    last = ranked.filter("_last").select("_source", "_block", (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("_room"))
    inside = keyed.join(small(last), ["_source", "_block"]).groupBy("_source", "_order", "_room").agg(F.sum("_size").alias("_size"))
    summed = inside.withColumn("_sum", F.sum("_size").over(Window.partitionBy("_source").orderBy("_order").rangeBetween(Window.unboundedPreceding, 0)))
    prefix = last.join(summed.filter("_sum <= _room").groupBy("_source").agg(F.max("_order").alias("_cut"), F.max("_sum").alias("_got")), "_source", "left").select(
        "_source", "_block", F.coalesce("_cut", F.lit(-(1 << 63)).cast("long")).alias("_cut"), (F.col("_room") - F.coalesce("_got", F.lit(0))).alias("_missing")
    )
    # one more document that the last pass lacks: the one nearest to what is missing, if that is nearer than none
    lacking = keyed.join(ranked.filter("_last OR NOT _whole").select("_source", "_block", "_last"), ["_source", "_block"]).join(small(prefix.select("_source", "_cut", "_missing")), "_source")
    lacking = lacking.filter("(NOT _last OR _order > _cut) AND _size > 0 AND _size < 2 * _missing")
    extra = lacking.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_missing")).alias("off"), "_order", "_block")).alias("x"))
    ends = {r["_source"]: r for r in prefix.join(extra, "_source", "left").select("_source", "_block", "_cut", "x").collect()}  # a row for each source
    counts = {r["_source"]: r["n"] for r in ranked.filter("_whole").groupBy("_source").agg(F.count("*").alias("n")).collect()}
    quotas = [full * f["n"] + counts.get(key, 0) + (key in ends) for f, (key, _, _, full, _) in zip(found, rows, strict=True)]
    dealt = split_quotas(quotas, shards, seed) if rows else np.zeros((shards, 0), np.int64)
    figures = []
    for i, (key, words, target, full, _) in enumerate(rows):
        bounds = np.cumsum(dealt[:, i]).tolist()
        end = ends.get(key)
        x = end and end["x"]
        shard = int(np.searchsorted(bounds, quotas[i] - 1, "right")) if end else None
        figures.append((key, words, target, full, bounds, end and end["_cut"], x and x["_order"], x and x["_block"], shard))
    figures = spark.createDataFrame(figures, "_source string, _source_size long, _target double, _full int, _bounds array<long>, _cut long, _extra long, _extra_block int, _extra_shard int")
    table = ranked.select("_source", "_block", "_rank", "_n", F.col("_whole") | F.col("_last"), "_last").toDF("_source", "_block", "_rank", "_n", "_again", "_last").join(small(figures), "_source")

    def draw(copy: Column) -> Column:
        at = copy * F.col("_n") + F.col("_rank")
        return F.struct(copy.cast("int").alias("copy"), F.size(F.filter("_bounds", lambda b: b <= at)).alias("shard"), (F.col("_last") & (copy == F.col("_full"))).alias("part"))

    passes = F.filter(F.sequence(F.lit(0), F.lit(1)), lambda c: (c < F.col("_full")) | ((c == F.col("_full")) & F.col("_again")))
    return Plan(cut(table.withColumn("_draws", F.transform(passes, draw)).drop("_bounds", "_rank", "_n", "_again", "_last"), "mix-plan"), seed)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def amounts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (where each copy goes) of each document."""
    own = cut(sized(docs), "mix-own")
    made = plan(own, **options)
    joined = made.keyed(own).join(made.blocks, ["_source", "_block"])
    draws = made.draws()
    return joined.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.size(draws)).alias("taken"), F.transform(draws, lambda d: d["shard"]).alias("shards")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: mix_shard, mix_copy and row (all columns of docs) for each copy taken, in random order within each shard."""
    made = plan(cut(sized(docs), "mix-own"), **options)
    blocks = F.broadcast(made.blocks) if made.blocks.count() <= BROADCAST_BLOCKS else made.blocks
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = made.keyed(rows).join(blocks, ["_source", "_block"]).withColumn("_draw", F.explode(made.draws()))
    copies = joined.select("row", F.col("_draw.shard").alias("mix_shard"), F.col("_draw.copy").alias("mix_copy"), F.xxhash64(F.lit(made.seed), "_order", "_draw.copy").alias("_at"))
    # a shard is as large as the output over the number of shards: parts of it are dealt by hash, and ordered each by itself
    return copies.repartition("mix_shard", F.pmod("_at", F.lit(64))).sortWithinPartitions("mix_shard", "_at").drop("_at")
