"""One-to-one matching: greedy by score, and optimal by total score. Small helpers in numpy, dealt by Spark one frame at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(pairs: Sequence[tuple[float, int, int]]) -> dict[int, int]:
    """pairs (score, detection, identity) -> detection: identity. Best score first; ties to the larger detection, then the larger identity."""
    chosen: dict[int, int] = {}
    taken: set[int] = set()
    for _, det, gid in sorted(pairs, reverse=True):
        if det not in chosen and gid not in taken:
            chosen[det] = gid
            taken.add(gid)
    return chosen


def optimal(scores: np.ndarray) -> list[tuple[int, int]]:
    """Rows matched with columns so that the total score is largest; as many pairs as the smaller side has.

    Shortest augmenting paths with potentials: each row in turn finds the cheapest alternating path to a free column.
    """
    scores = np.asarray(scores, float)
    if 0 in scores.shape:
        return []
    if scores.shape[0] > scores.shape[1]:
        return sorted((r, c) for c, r in optimal(scores.T))
    cost = -scores
    n, m = cost.shape
    row_potential, column_potential = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for root in range(n):
        least, via = cost[root] - row_potential[root] - column_potential, np.full(m, -1)
        done = np.zeros(m, bool)
        while True:
            column = int(np.where(done, np.inf, least).argmin())
            reach = least[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
            through = reach + cost[row] - row_potential[row] - column_potential
            better = ~done & (through < least)
            least[better], via[better] = through[better], column
        closed = done.copy()
        closed[column] = False
        row_potential[root] += reach
        row_potential[owner[closed]] += reach - least[closed]
        column_potential[closed] += least[closed] - reach
        while column >= 0:
            before = via[column]
            owner[column] = root if before < 0 else owner[before]
            column = before
    return sorted((int(r), int(c)) for c, r in enumerate(owner) if r >= 0)


def greedy_frames(candidates: DataFrame) -> DataFrame:
    """candidates (cam_name, frame_no, det_idx, gid, score) -> forced_gid of the detections that get one.

    A frame has few detections and a ring of identities at most; its pairs, best first (ties as greedy() has them), are folded into what is
    taken so far, all in one expression.
    """
    best = candidates.groupBy("cam_name", "frame_no", "det_idx", "gid").agg(F.max("score").alias("score"))
    pairs = F.sort_array(F.collect_list(F.struct("score", F.col("det_idx").cast("long").alias("det_idx"), F.col("gid").cast("long").alias("gid"))), asc=False)
    frames = best.groupBy("cam_name", "frame_no").agg(pairs.alias("pairs"))
    return frames.select("cam_name", "frame_no", F.explode(first_free(F.col("pairs"), "det_idx", "gid")).alias("m")).select("cam_name", "frame_no", "m.det_idx", F.col("m.gid").alias("forced_gid"))


def optimal_groups(pairs: DataFrame, key: list[str], row: str, column: str, score: str, more: Sequence[str] = ()) -> DataFrame:
    """pairs with a score -> the pairs of each key's optimal matching (and more of their columns), judged afterwards by whoever asked. A pair that is missing is never
    chosen before any that is there. A group is one frame: its detections and candidate identities."""

    @F.pandas_udf("array<int>")
    def chosen(groups: pd.Series, columns: pd.Series, scores: pd.Series) -> pd.Series:
        out = []
        for a, b, s in zip(groups, columns, scores, strict=True):
            rows, r = np.unique(a, return_inverse=True)
            cols, c = np.unique(b, return_inverse=True)
            table, at = np.full((len(rows), len(cols)), -1e6), np.full((len(rows), len(cols)), -1)
            table[r, c], at[r, c] = s, np.arange(len(s))
            out.append([int(at[p]) for p in optimal(table) if at[p] >= 0])
        return pd.Series(out)

    listed = pairs.groupBy(*key).agg(F.collect_list(F.struct(row, column, score, *more)).alias("_pairs"))
    numbers = chosen(F.col(f"_pairs.{row}"), F.col(f"_pairs.{column}"), F.col(f"_pairs.{score}"))
    picked = F.transform(numbers, lambda i: F.get("_pairs", i))
    return listed.select(*key, F.explode(picked).alias("_pair")).select(*key, *[f"_pair.{c}" for c in (row, column, score, *more)])


def first_free(pairs: Column, row: str, column: str, also: Callable[[Column, Column], Column] | None = None) -> Column:
    """Of an array of structs, in its order, those whose row and column no earlier chosen one has. also: a further condition on (chosen so far, pair)."""
    none = F.filter(pairs, lambda p: F.lit(False))

    def fits(chosen: Column, pair: Column) -> Column:
        free = ~F.exists(chosen, lambda t: (t[row] == pair[row]) | (t[column] == pair[column]))
        return free if also is None else free & also(chosen, pair)

    return F.aggregate(pairs, none, lambda s, p: F.when(fits(s, p), F.concat(s, F.array(p))).otherwise(s))
