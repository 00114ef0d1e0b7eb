"""Vectors as array columns: products, similarity, templates and galleries without Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import constants as C

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scale(a: Column) -> Column:
    """What to divide by: the norm, or 1 if there is (almost) none."""
    return bound(norm(a), lambda n: F.when(n < TINY, 1.0).otherwise(n))


def normalized(a: Column) -> Column:
    """Unit length; a vector of (almost) no length stays as it is."""
    return bound(_scale(a), lambda n: F.transform(a.cast("array<double>"), lambda v: v / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (_scale(a) * _scale(b))


def mean_of_best(scores: Column, k: int = 3) -> Column:
    """Mean of the k largest entries; -1 for none."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.when(F.size(best) > 0, F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(best)).otherwise(F.lit(-1.0))


def gallery_similarity(emb: Column, template: Column, gallery: Column) -> Column:
    """How alike a vector is to an identity: the mean of the best three among its template and gallery."""
    held = F.concat(F.when(template.isNotNull(), F.array(template)).otherwise(F.array().cast("array<array<double>>")), gallery)
    return mean_of_best(F.transform(held, lambda g: cosine(emb, g)))


def unit_similarity(unit: Column, template: Column, gallery: Column) -> Column:
    """As gallery_similarity, of vectors that have unit length already: a product for each held vector, and no lengths."""
    held = F.concat(F.when(template.isNotNull(), F.array(template)).otherwise(F.array().cast("array<array<double>>")), gallery)
    return mean_of_best(F.transform(held, lambda g: dot(unit, g)))


def galleries(rows: DataFrame, key: list[str], order: list[str], emb: str = "emb", size: int = C.GALLERY) -> DataFrame:
    """The last vectors of each key, oldest first. Only the newest rows of a key are gathered."""
    newest = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_back") <= size)
    listed = F.array_sort(F.collect_list(F.struct(*order, normalized(F.col(emb)).alias("emb"))))
    return newest.groupBy(*key).agg(F.transform(listed, lambda s: s["emb"]).alias("gallery"))


# ---- appearance of a crop, for rows that carry pixels

#: Size that crops are brought to, and of their gray thumbnail (height, width).
CROP, THUMBNAIL = (128, 64), (32, 16)


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """images (n, h, w, ...) of 8 bits by linear interpolation between pixel centers, whole values; outside the edge pixels hold.

    To sides that are powers of two, up to 8192 pixels, single precision is exact: weights are multiples of 1 / (2 * side), so each mix has 23 bits at most.
    """
    exact = height & (height - 1) == 0 and width & (width - 1) == 0 and height * width <= 8192
    kind = np.float32 if exact else np.float64

    def along(x: np.ndarray, axis: int, new: int) -> np.ndarray:
        old = x.shape[axis]
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        share = (at - low).astype(kind).reshape((1,) * axis + (-1,) + (1,) * (x.ndim - axis - 1))
        first, second = np.take(x, low, axis).astype(kind), np.take(x, np.minimum(low + 1, old - 1), axis).astype(kind)
        first *= 1 - share
        second *= share
        first += second
        return first

    # the side that shrinks, or grows less, first
    sides = sorted(((1, height), (2, width)), key=lambda s: s[1] / images.shape[s[0]])
    for axis, new in sides:
        images = along(images, axis, new)
    images += kind(0.5)
    return images.astype(np.uint8)


def hsv(images: np.ndarray) -> np.ndarray:
    """Blue, green, red of 8 bits -> planes of hue (0 to 179), saturation and value (0 to 255). Quotients are far enough from what they aren't for single precision."""
    b, g, r = (np.ascontiguousarray(images[..., k]).astype(np.int16) for k in range(3))
    value = np.maximum(np.maximum(b, g), r)
    span = value - np.minimum(np.minimum(b, g), r)
    turn = np.where(value == r, g - b, np.where(value == g, b - r + 2 * span, r - g + 4 * span))
    hue = np.floor(turn.astype(np.float32) * np.float32(30) / np.maximum(span, 1).astype(np.float32) + np.float32(0.5)).astype(np.int16)
    hue += (hue < 0) * np.int16(180)
    hue -= (hue >= 180) * np.int16(180)
    saturation = np.floor(span.astype(np.float32) * np.float32(255) / np.maximum(value, 1).astype(np.float32) + np.float32(0.5)).astype(np.int16)
    return np.stack([hue, saturation, value])


def gray(images: np.ndarray) -> np.ndarray:
    b, g, r = (images[..., k].astype(float) for k in range(3))
    return (b * 0.114 + g * 0.587 + r * 0.299 + 0.5).astype(np.uint8)


def _histograms(planes: np.ndarray) -> np.ndarray:
    """12 hue, 4 saturation and 4 value bins of each of images as planes (hue, saturation, value; n, h, w), of unit length."""
    n = planes.shape[1]
    at = (planes[0] // 15 * 16 + (planes[1] >> 6 << 2) + (planes[2] >> 6)).reshape(n, -1)
    counts = np.stack([np.bincount(own, minlength=192) for own in at]).astype(float)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), TINY)


def features(images: np.ndarray) -> np.ndarray:
    """Crops of one size (n, h, w, 3; blue, green, red) -> n x 897: histograms of the upper 45 % and of the rest, the aspect ratio of the standard crop (always 0.5), and
    the gray thumbnail, of unit length together."""
    crops = resized(images, *CROP)
    colors, split = hsv(crops), max(1, int(CROP[0] * 0.45))
    small = resized(gray(crops), *THUMBNAIL).reshape(len(crops), -1) / 255.0
    whole = np.concatenate([_histograms(colors[:, :, :split]), _histograms(colors[:, :, split:]), np.full((len(crops), 1), CROP[1] / CROP[0]), small], axis=1)
    return whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), TINY)


@F.pandas_udf(ArrayType(DoubleType()))
def crop_features(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Features of crops as bytes (height x width x blue, green, red). Crops of one size in a batch go through together. Null if a side is below the least crop or the bytes don't fit."""
    out: list[np.ndarray | None] = [None] * len(pixels)
    whole = [(i, raw, h, w) for i, (raw, h, w) in enumerate(zip(pixels, height, width, strict=True)) if raw is not None and h is not None and w is not None]
    sizes: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for i, raw, h, w in whole:
        if h >= C.MIN_CROP and w >= C.MIN_CROP and len(raw) == h * w * 3:
            sizes.setdefault((int(h), int(w)), []).append((i, raw))
    for (h, w), own in sizes.items():
        for at in range(0, len(own), 16):
            part = own[at : at + 16]
            images = np.stack([np.frombuffer(raw, np.uint8).reshape(h, w, 3) for _, raw in part])
            for (i, _), row in zip(part, features(images), strict=True):
                out[i] = row
    return pd.Series(out)


def color_histogram(pixels: DataFrame, key: list[str]) -> DataFrame:
    """pixels (key, hue, saturation, value) -> key, bin, weight: the histogram as rows, of unit length for each key."""
    at = F.floor(F.col("hue") / 15) * 16 + F.floor(F.col("saturation") / 64) * 4 + F.floor(F.col("value") / 64)
    counts = pixels.groupBy(*key, at.cast("long").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*key)))
    return counts.select(*key, "bin", (F.col("n") / size).alias("weight"))
