"""The live map: where each identity is now, as changes of a stream, with those that have not been seen for a while taken off."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.functions import constants as C
from wayline.functions import geometry


class Place(StatefulProcessor):
    """The newest position of one identity, and a timer for when it is too old."""

    def __init__(self, ttl_ms: int, key: Sequence[str]):
        self.ttl_ms, self.key = ttl_ms, list(key)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("place", "ts_ms long, det_id long")

    def _row(self, key: tuple, x: int | None, y: int | None, at: int, gone: bool) -> pd.DataFrame:
        told = pd.DataFrame([(*key, x, y, at, gone)], columns=[*self.key, "map_x", "map_y", "last_seen_ms", "gone"])
        return told.astype({"map_x": "Int64", "map_y": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = tuple(self.state.get()) if self.state.exists() else (-(1 << 62), -1)
        best = (*before, None, None)
        for batch in rows:
            for at, det, x, y in zip(*(batch[c].tolist() for c in ("ts_ms", "det_id", "map_x", "map_y")), strict=True):
                best = max(best, (int(at), int(det), int(x), int(y)), key=lambda b: b[:2])
        if best[:2] == before:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] + self.ttl_ms + 1)
        self.state.update(best[:2])
        yield self._row(key, best[2], best[3], best[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = self.state.get()[0] if self.state.exists() else None
        if at is not None:
            self.state.clear()
            yield self._row(key, None, None, at, True)

    def close(self) -> None:
        pass


def changes(assigned: DataFrame, delay: str = "2 seconds", ttl: float = C.MAP_TTL, key: Sequence[str] = ("site_id", "gid"), width: int = C.MAP_WIDTH, height: int = C.MAP_HEIGHT) -> DataFrame:
    """Changes of the map from a stream with key, ts_ms, det_id, map_x and map_y: key, map_x, map_y, last_seen_ms, gone.

    Positions are moved onto the floorplan, as history.latest_positions does. An identity is gone once the watermark, which is delay behind the newest row of all, is more than
    ttl seconds past its last position. Its state goes too, so what is kept is as large as the map. Ids count within a site.
    """
    x, y = geometry.on_map(F.col("map_x"), F.col("map_y"), width, height)
    placed = assigned.filter("map_x IS NOT NULL AND map_y IS NOT NULL").select(*key, "ts_ms", "det_id", x.alias("map_x"), y.alias("map_y"))
    # a millisecond later than it is, as for the assigner: what isn't after the watermark is late
    timed = placed.withColumn("ts", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("ts", delay)
    kinds = ", ".join(f"{c} {assigned.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{kinds}, map_x long, map_y long, last_seen_ms long, gone boolean"
    return timed.groupBy(*key).transformWithStateInPandas(Place(int(ttl * 1000), key), outputStructType=schema, outputMode="update", timeMode="eventTime")
