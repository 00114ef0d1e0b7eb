"""Near duplicates of vectors: spherical k-means cells, blocked cosine products, one representative for each group.

Only vectors with equal, non-null labels are compared. Equal vectors are one class first. A label gets FEWEST cells, or about one for PER_CELL
classes (a power of two, CELLS at most), and one if it has under FEWEST classes for each: spherical k-means, fitted on a bounded sample, assigns each
class to the cell of the nearest centroid, its home. A cell's vectors are compared with each other and with visitors:
vectors at home in a later cell that could still be within the threshold of some point of this one. That test is exact: a
point of cell j lies on the far side of the plane between its centroid and a visitor's, so a visitor farther from that plane than two vectors
at the threshold can be apart has no partner there. No link is lost to the cells; they only save work.

Scale: the vectors at home in a cell, and its visitors, are cut into blocks of BLOCK by hash; a task holds two blocks, multiplies them, and
returns link counts for each vector and a spanning forest of the links, never all pairs. Counts weigh a class by its size. Vectors travel in the
type they are stored in, and a class travels once for each block that it meets.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without label, are
linked with nothing and kept. Vectors of different lengths are never alike. Rows without an id have no component and are kept; repeated ids
are rows of their own, each with its own number of links, that share a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import BROADCAST_IDS, cut

#: Vectors of the sample at most, a label's classes for each cell aimed at, cells at least and at most, and vectors in a block.
SAMPLE, PER_CELL, FEWEST, CELLS, BLOCK = 20_000, 4096, 4, 1024, 2048


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # against overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums * sums).sum(1))
        c[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return c


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of links that form a spanning forest of the graph (a, b) over n nodes: union-find."""
    up, keep = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, int)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    own = own.withColumn("ok", sound(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    text = F.concat_ws(",", F.transform("v", lambda x: (x.cast("double") + 0.0).cast("string")), F.lit("|"), F.col("label"))
    own = cut(own.withColumn("key", F.when(F.col("ok"), F.sha2(text, 256))), "emb-rows")
    classes = own.filter("ok").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    # a class has a number of its own, since ids may be repeated; it stays as written
    points = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "copies", "v", "label", F.size("v").alias("size")), "emb-points")
    least = F.when(F.col("count") >= FEWEST * FEWEST, F.lit(FEWEST)).otherwise(1)
    wanted = F.least(F.lit(CELLS), F.greatest(least, F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("count") / PER_CELL, F.lit(1.0)))))))
    cells = cut(points.groupBy("label", "size").count().select("label", "size", wanted.cast("int").alias("cells")), "emb-cells")
    fits = [(r["size"], r["cells"]) for r in cells.select("size", "cells").distinct().collect()]  # a few for each length of vector
    sample = points.orderBy(F.xxhash64("key")).limit(SAMPLE).select("v", "size").toPandas()  # SAMPLE vectors at most
    centroids: dict[tuple[int, int], np.ndarray] = {}
    for size, k in fits:
        x = matrix(sample["v"][sample["size"] == size])
        centroids[size, k] = spherical_kmeans(unit(x), k) if len(x) else np.eye(1, size)
    apart = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9  # distance of unit vectors at the threshold
    element = own.schema["v"].dataType.simpleString()
    schema = f"cid long, copies long, label string, size int, v {element}, cell int, home boolean"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (size, k), part in batch.groupby(["size", "cells"]):
                c = centroids[int(size), int(k)]
                dots = unit(matrix(part["v"])) @ c.T
                near = dots.argmax(1)
                between = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[near]
                lead = dots[np.arange(len(part)), near][:, None] - dots
                # distance from the plane between two centroids; a centroid that equals another has no plane
                # a pair of vectors at home in two cells meets in the earlier one
                goes = (lead <= apart * np.maximum(between, 1e-12)) & (np.arange(len(c)) < near[:, None])
                goes[np.arange(len(part)), near] = True
                row, cell = np.nonzero(goes)
                yield part.iloc[row][["cid", "copies", "label", "size", "v"]].assign(cell=cell.astype(np.int32), home=cell == near[row])

    known = F.broadcast(cells) if cells.count() <= BROADCAST_IDS else cells
    placed = points.join(known, ["label", "size"]).select("cid", "copies", "label", "size", "v", "cells").mapInPandas(assign, schema)
    group = ["label", "size", "cell"]
    placed = cut(placed, "emb-placed")
    blocks = placed.groupBy(*group).agg(*[F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("int").alias(n) for c, n in ((F.col("home"), "_homes"), (~F.col("home"), "_visits"))])
    dealt = placed.join(blocks, group).withColumn("_block", F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("_homes")).otherwise(F.col("_visits"))).cast("int"))
    each = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    columns = [*group, "cid", "copies", "v", "_block", "home", "_low", "_high", "_own"]
    homes, visitors = dealt.filter("home"), dealt.filter("NOT home")
    # blocks at home meet each other, as (smaller, larger), and the blocks of visitors, as (home, visitors)
    inside = homes.withColumn("_other", each("_homes")).withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other"), "_own": F.lit(True)})
    hosts = homes.withColumn("_high", each("_visits")).withColumns({"_low": F.col("_block"), "_own": F.lit(False)})
    guests = visitors.withColumn("_low", each("_homes")).withColumns({"_high": F.col("_block"), "_own": F.lit(False)})
    paired = inside.select(columns).unionByName(hosts.select(columns)).unionByName(guests.select(columns))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid")
        ids, copies, home, block = (part[c].to_numpy() for c in ("cid", "copies", "home", "_block"))
        x = unit(matrix(part["v"]))
        if part["_own"].iloc[0]:
            same = part["_low"].iloc[0] == part["_high"].iloc[0]
            left, right = (np.flatnonzero(block == part[c].iloc[0]) for c in ("_low", "_high"))
        else:
            same, left, right = False, np.flatnonzero(home), np.flatnonzero(~home)
        found = []
        for at in range(0, len(left), 512):
            i, j = np.nonzero(x[left[at : at + 512]] @ x[right].T >= threshold - 1e-9)
            found.append(np.stack([left[at + i], right[j]]))
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
        if same:
            a, b = a[a < b], b[a < b]
        exact = np.concatenate([np.einsum("ij,ij->i", x[a[at : at + 65536]], x[b[at : at + 65536]]) for at in range(0, len(a), 65536)] or [np.zeros(0)]) >= threshold
        a, b = a[exact], b[exact]
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        tree = forest(len(x), a, b)
        has = np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate([ids[has], ids[a[tree]]]), "b": np.concatenate([ids[has], ids[b[tree]]]), "links": np.concatenate([links[has], np.zeros(len(tree))]).astype(np.int64)})

    met = cut(paired.groupBy(*group, "_own", "_low", "_high").applyInPandas(compare, "a long, b long, links long"), "emb-met")
    links = met.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    joined = components(met.filter("a <> b").select("a", "b"))
    known = points.select("cid", "key", "rep", "copies").join(links, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = cut(known, "emb-known")
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = known.join(smallest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = own.join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    if not own.filter("vec_id IS NOT NULL").groupBy("vec_id").count().filter("count > 1").isEmpty():
        # the rows of a repeated id bring their components together
        more = components(out.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("component_id").alias("b")))
        out = out.join(more, F.col("vec_id") == F.col("id"), "left").select("vec_id", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
