"""Names, labels and small formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def safe_name(name: Column, default: Column) -> Column:
    """Letters, digits, blanks and ._- of a name, trimmed; the default if nothing is left."""
    kept = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} ._-]", ""))
    return F.coalesce(F.when(kept != "", kept), default)


def extension(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def is_video(name: Column) -> Column:
    return extension(name).isin(*C.VIDEO_EXTENSIONS)


def device_index(url: Column) -> Column:
    """The number of a local device if the url is all digits, else null."""
    return F.when(url.rlike(r"^[0-9]+$"), url.cast("long"))


def points(text: Column) -> Column:
    """Four [x, y] pairs from JSON; null for anything else."""
    parsed = F.from_json(text, "array<array<double>>")
    return F.when((F.size(parsed) == 4) & F.forall(parsed, lambda p: p.isNotNull() & (F.size(p) == 2)), parsed)


def label(gid: Column, conf: Column, tid: Column, debug: bool = False) -> Column:
    parts = [F.concat(F.lit("GID "), gid.cast("string")), F.when(conf.isNotNull(), F.format_string(" %.2f", conf)).otherwise(F.lit(""))]
    return F.concat(*parts, *([F.lit(" | L"), tid.cast("string")] if debug else []))


def source_label(source: Column, score: Column, overlap: Column) -> Column:
    return F.concat(source, F.format_string(":%.2f", score), F.when(overlap, F.lit(" | OCC")).otherwise(F.lit("")))


def local_identity(cam: Column, tid: Column) -> Column:
    """An identity that is only known inside its camera."""
    return F.concat_ws("-", cam, tid.cast("string"))


def tracker_of(identity: Column) -> Column:
    return F.element_at(F.split(identity, "-"), -1)


def frame_rate(fps: Column) -> Column:
    """Frames per second, 25 where unknown, not a number or not above zero."""
    return F.when(fps.isNotNull() & ~F.isnan(fps) & (fps > 0), fps).otherwise(F.lit(25.0))
