"""Features from pixels against a version that goes pixel by pixel, and the registry as it was at a frame."""

import colorsys
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import vectors
from wayline.operators import asof
from wayline.plans.calibration import H, SOURCE, TARGET
from wayline.plans.queries import QUERIES
from wayline.sources import registry
from wayline.streaming import sinks


def half_up(x):
    return math.floor(x + 0.5)


def scaled(image, height, width):
    """Pixel by pixel: each is mixed from the four around its center."""
    h, w, out = len(image), len(image[0]), []
    for i in range(height):
        y = min(max((i + 0.5) * h / height - 0.5, 0), h - 1)
        row = []
        for j in range(width):
            x = min(max((j + 0.5) * w / width - 0.5, 0), w - 1)
            a, b, p, q = int(y), int(x), min(int(y) + 1, h - 1), min(int(x) + 1, w - 1)
            mix = lambda k: (image[a][b][k] * (1 - (y - a)) + image[p][b][k] * (y - a)) * (1 - (x - b)) + (image[a][q][k] * (1 - (y - a)) + image[p][q][k] * (y - a)) * (x - b)  # noqa: B023, E731
            row.append([half_up(round(mix(k), 9)) for k in range(len(image[0][0]))])
        out.append(row)
    return out


def plain_features(image):
    crop = scaled(image, 128, 64)
    parts = []
    for rows in (crop[:57], crop[57:]):
        counts = [0] * 192
        for b, g, r in (p for row in rows for p in row):
            hue, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
            counts[half_up(round(hue * 180, 9)) % 180 // 15 * 16 + half_up(round(s * 255, 9)) // 64 * 4 + half_up(v * 255) // 64] += 1
        size = math.sqrt(sum(c * c for c in counts))
        parts += [c / size for c in counts]
    grays = [[[half_up(round(0.114 * b + 0.587 * g + 0.299 * r, 9))] for b, g, r in row] for row in crop]
    parts += [0.5] + [p[0] / 255 for row in scaled(grays, 32, 16) for p in row]
    size = math.sqrt(sum(x * x for x in parts))
    return [x / size for x in parts]


@pytest.mark.parametrize(("h", "w"), [(24, 24), (128, 64), (31, 77), (300, 40)])
def test_features_equal_a_plain_version(spark, h, w):
    draw = np.random.default_rng(h)
    noise = draw.integers(0, 256, (h, w, 3), dtype=np.uint8)
    ramp = np.stack([np.add.outer(np.arange(h) * 3, np.arange(w) * k) % 256 for k in (1, 5, 2)], -1).astype(np.uint8)
    rows = spark.createDataFrame([(i, bytearray(x.tobytes()), h, w) for i, x in enumerate((noise, ramp, noise * 0, noise))], "i int, p binary, h int, w int")
    got = {r["i"]: r["f"] for r in rows.select("i", vectors.crop_features("p", "h", "w").alias("f")).collect()}
    for i, image in ((0, noise), (1, ramp), (2, noise * 0)):
        want = np.array(plain_features(image.tolist()))
        assert len(got[i]) == 897 and np.abs(np.array(got[i]) - want).max() < 1e-9
    assert got[3] == got[0]


def test_crops_that_give_nothing(spark):
    rows = spark.createDataFrame([(bytearray(3), 1, 1), (None, 30, 24), (bytearray(30 * 24 * 3 - 1), 30, 24), (bytearray(23 * 40 * 3), 23, 40), (bytearray(9), None, 3)], "p binary, h int, w int")
    assert [r[0] for r in rows.select(vectors.crop_features("p", "h", "w")).collect()] == [None] * 5


@pytest.mark.parametrize("part", [7, 1000])
def test_last_before_equals_a_loop(spark, part):
    draw = random.Random(part)
    facts = [(draw.choice(["x", None]), draw.randrange(200), i) for i in range(30)]
    looks = [(draw.choice(["x", "z", None]), draw.randrange(220), i) for i in range(80)]
    f, k = spark.createDataFrame(facts, "k string, ts_ms long, det_id long"), spark.createDataFrame(looks, "k string, ts_ms long, look long")
    got = {r["look"]: r["found"] and r["found"]["det_id"] for r in asof.last_before(k, f, ["k"], ["det_id"], part).collect()}
    assert got == {i: max(((t, d) for q, t, d in facts if q == key and t < ts), default=(0, None))[1] for key, ts, i in looks}


def test_registry_changes_under_a_stream(spark, tmp_path):
    """Frames are placed by the calibration of their own time: one that comes later doesn't reach back, and a deleted camera has none."""
    good, log = str([[float(v) for v in p] for p in SOURCE]), "name string, seq long, ts_ms long, action string, url string, points string"
    shape = "det_id long, cam_name string, ts_ms long, foot_x long, foot_y long"
    actions, frames = str(tmp_path / "log"), str(tmp_path / "in")

    def placed(rows):
        known = registry.planes(registry.valid_at(rows, spark.read.schema(log).parquet(actions)), TARGET)
        h, x, y = F.col("h"), F.col("foot_x"), F.col("foot_y")
        w = h[6] * x + h[7] * y + h[8]
        return known.select("det_id", F.round((h[0] * x + h[1] * y + h[2]) / w, 3).alias("map_x"), "url")

    def feed(rows, changes):
        spark.createDataFrame(changes, log).write.mode("append").parquet(actions)
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(frames)
        query = sinks.per_batch(spark.readStream.schema(shape).parquet(frames), placed, str(tmp_path / "out"), str(tmp_path / "c"), once=True)
        query.awaitTermination(120)
        assert query.exception() is None

    feed([(1, "a", 100, 600, 400), (2, "a", 101, 600, 400), (3, "b", 500, 600, 400)], [("a", 1, 100, "add", "one", good), ("a", 2, 300, "add", "two", "[[1,2]]")])
    feed([(4, "a", 250, 600, 400), (5, "a", 350, 600, 400), (6, "a", 800_000, 600, 400), (7, "a", 450, 600, 400)], [("a", 3, 400, "delete", None, None), ("a", 4, 500, "add", "three", good)])
    there = round((H[0] * 600 + H[1] * 400 + H[2]) / (H[6] * 600 + H[7] * 400 + H[8]), 3)
    got = {r["det_id"]: (r["map_x"], r["url"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (None, None), 2: (there, "one"), 3: (None, None), 4: (there, "one"), 5: (None, "two"), 6: (there, "three"), 7: (None, None)}


def test_image_headers(spark):
    number = lambda n, size, order: n.to_bytes(size, order)
    png = b"\x89PNG\r\n\x1a\n" + number(13, 4, "big") + b"IHDR" + number(640, 4, "big") + number(70_000, 4, "big")
    gif = b"GIF89a" + number(300, 2, "little") + number(2, 2, "little")
    bmp = b"BM" + bytes(16) + number(1, 4, "little") + number(258, 4, "little")
    segment = lambda kind, body: bytes([0xFF, kind]) + number(len(body) + 2, 2, "big") + body
    frame = segment(0xC2, b"\x08" + number(480, 2, "big") + number(1920, 2, "big") + b"\x03")
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF" + bytes(9)) + b"\xff" + segment(0xC4, bytes(30)) + frame
    files = [(0, png), (1, gif), (2, bmp), (3, jpeg), (4, png[:20]), (5, jpeg[:20]), (6, b""), (7, None), (8, b"text"), (9, b"\xff\xd8")]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in files], "i int, content binary")
    got = {r["i"]: (r["width"], r["height"]) for r in registry.with_size(rows).collect()}
    assert got == {0: (640, 70_000), 1: (300, 2), 2: (1, 258), 3: (1920, 480)} | {i: (None, None) for i in range(4, 10)}


def test_crops_are_dealt_over_cores(spark):
    """one small file was one task, whatever a crop costs."""
    crops = QUERIES["crop_features"](spark, "/root/testdata/sf0.001")
    assert crops.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_single_precision_is_exact():
    """Sizes to powers of two in single precision equal those in double, and colors that of whole numbers."""
    draw = np.random.default_rng(9)
    for h, w in ((24, 24), (131, 77), (500, 30)):
        image = draw.integers(0, 256, (1, h, w, 3), dtype=np.uint8)
        down, along = (np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1) for n, old in ((128, h), (64, w)))
        mix = lambda x, at, axis: np.take(x, np.floor(at).astype(int), axis) * (1 - at % 1).reshape([-1 if k == axis else 1 for k in range(4)]) + np.take(x, np.minimum(np.floor(at).astype(int) + 1, x.shape[axis] - 1), axis) * (at % 1).reshape([-1 if k == axis else 1 for k in range(4)])
        assert (vectors.resized(image, 128, 64) == np.floor(mix(mix(image.astype(float), down, 1), along, 2) + 0.5)).all()
    value, span = (x.ravel() for x in np.meshgrid(np.arange(1, 256), np.arange(256)))
    value, span = value[span <= value], span[span <= value]
    colors = np.stack([value - span, value - span // 3, value], -1).astype(np.uint8).reshape(1, 1, -1, 3)
    assert (vectors.hsv(colors)[1].ravel() == (span * 510 + value) // (2 * value)).all()
    assert (vectors.hsv(colors)[0].ravel() == np.where(span == 0, 0, ((span - span // 3) * 60 + np.maximum(span, 1)) // (2 * np.maximum(span, 1)))).all()
