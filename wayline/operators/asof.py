"""What was known right before a frame: as-of lookups with a bounded reach, and running numbers, both without a window over a whole history.

A site's camera frames have one order: time, then camera, then frame number. "Before a frame" is before in this order, so at one moment the cameras
take turns, as they do where identities are assigned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A camera frame of a site, and the order of a site's camera frames.
CAMERA_FRAME = ["site_id", "cam_name", "frame_no"]
ORDER = ["ts_ms", "cam_name", "frame_no"]
#: Order inside a frame.
INSIDE = ["det_idx", "det_id"]


def latest_before(looks: DataFrame, facts: DataFrame, key: Sequence[str], value: Sequence[str], reach: int, clock: str = "ts_ms", order: Sequence[str] = ("cam_name", "frame_no"), name: str = "found") -> DataFrame:
    """looks with a struct `name`: the newest fact of the same key before the look, and not more than reach behind it by the clock; null if there is none.

    key, clock and order are columns of both; value and clock go into the struct. Of facts at one (clock, order) the last by det_idx and det_id counts, where facts have them;
    a fact at a look's own (clock, order) isn't before it. Null keys are equal. Facts are dealt to their block of the clock, as wide as the reach, and to
    the next, so a look meets all that it can reach in its own block, and no task has more of a key than two blocks.
    """
    block = F.floor(F.col(clock) / reach)
    inside = [c for c in INSIDE if c in facts.columns and c not in (*key, *order)]
    held = F.struct(*dict.fromkeys([clock, *value]))
    position = [*key, *[c for c in (clock, *order) if c not in key]]
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(f"_{c}")
    asked = looks.select(*position, block.alias("_block"), F.lit(0).alias("_kind"), *[empty(facts, c) for c in inside], F.struct(*[F.col(c) for c in looks.columns]).alias("_look"))
    known = facts.select(*position, F.explode(F.array(block, block + 1)).alias("_block"), F.lit(1).alias("_kind"), *[F.col(c).alias(f"_{c}") for c in inside], held.alias("_fact"))
    both = asked.unionByName(known, allowMissingColumns=True)
    along = Window.partitionBy(*key, "_block").orderBy(clock, *[c for c in order if c not in key], "_kind", *[f"_{c}" for c in inside]).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_fact", ignorenulls=True).over(along)
    found = both.withColumn("_last", last).filter("_kind = 0")
    near = F.col(f"_look.{clock}") - F.col(f"_last.{clock}") <= reach
    return found.select("_look.*", F.when(near, F.col("_last")).alias(name))


def last_before(looks: DataFrame, facts: DataFrame, key: Sequence[str], value: Sequence[str], part: int, clock: str = "ts_ms", order: Sequence[str] = (), name: str = "found") -> DataFrame:
    """As latest_before, with no limit to how far back a fact may be.

    The last fact of each part of the clock is carried over to the parts after it, so a window sees either one part's rows or a row for each part.
    """
    near = latest_before(looks, facts, key, value, part, clock, order, name="_near")
    inside = [c for c in INSIDE if c in facts.columns and c not in (*key, *order)]
    block, site = F.floor(F.col(clock) / part), F.struct(*key)
    held = F.struct(*dict.fromkeys([clock, *value]))
    ends = facts.groupBy(site.alias("_key"), block.alias("_block")).agg(F.max_by(held, F.struct(clock, *order, *inside)).alias("_end"))
    asked = looks.select(site.alias("_key"), block.alias("_block"), F.lit(None).cast(ends.schema["_end"].dataType).alias("_end")).distinct()
    all_ends = ends.unionByName(asked).groupBy("_key", "_block").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_ends.select("_key", "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    both = near.withColumns({"_key": site, "_block": block}).join(carried, ["_key", "_block"])
    return both.select(*looks.columns, F.coalesce("_near", "_carried").alias(name))


def starts(rows: DataFrame, others: DataFrame | None = None, key: Sequence[str] = ("cam_name",), frame: Sequence[str] = ("frame_no",), part: Column | None = None) -> DataFrame:
    """key, frame, _start: the number, from 1, that the first row of each frame has (or would have) among all rows of its key, in order of `frame`.

    others: rows whose frames are wanted too, without being counted. part: what frames are summed by on the way, rising along `frame`; sums over parts, and
    over the frames of a part, give the numbers, so no task sees the rows of a key together.
    """
    at = [*key, *frame]
    part = F.floor(F.col("frame_no") / 4096) if part is None else part
    marks = rows.select(*at, F.lit(1).cast("long").alias("_one"))
    if others is not None:
        marks = marks.unionByName(others.select(*at, F.lit(0).cast("long").alias("_one")))
    counts = marks.groupBy(*at).agg(F.sum("_one").alias("_many")).withColumn("_part", part)
    sums = counts.groupBy(*key, "_part").agg(F.sum("_many").alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(*key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_part").orderBy(*frame).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_own", F.coalesce(F.sum("_many").over(inside), F.lit(0)))
    return own.join(blocks, [*key, "_part"]).select(*at, (F.col("_before") + F.col("_own") + 1).alias("_start"))


def site_starts(rows: DataFrame, others: DataFrame | None = None, part_ms: int = 1 << 20) -> DataFrame:
    """As starts, for the numbers of a site's rows over all of its cameras."""
    return starts(rows, others, ("site_id",), tuple(ORDER), F.floor(F.col("ts_ms") / part_ms))


def numbered(rows: DataFrame, start: DataFrame, at: Sequence[str]) -> DataFrame:
    """rows with _n, their number along their key, from the numbers of their frames."""
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*[c for c in INSIDE if c in rows.columns]))
    return rows.withColumn("_in", inside).join(start, list(at)).withColumn("_n", F.col("_start") + F.col("_in") - 1).drop("_in", "_start")
