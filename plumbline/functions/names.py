"""File names, keys and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind of file.
CLOUD = ["ply", "pcd", "xyz", "xyzn", "xyzrgb", "pts"]
IMAGE = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]
#: Further extensions that the standard MIME table counts as images.
MIME_IMAGE = ["avif", "gif", "heic", "heif", "ico", "ief", "jpe", "pbm", "pgm", "pnm", "ppm", "ras", "rgb", "svg", "webp", "xbm", "xpm", "xwd"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def safe_name(name: Column) -> Column:
    """Word characters, dots and dashes kept, runs of others turned into one underscore; no name counts as ``cloud.ply``."""
    base = base_name(name)
    return F.regexp_replace(F.when(base == "", "cloud.ply").otherwise(F.coalesce(base, F.lit("cloud.ply"))), r"[^\w.\-]+", "_")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(safe_name(name), r"(?<=.)\.[^.]*$", "")


def six_digits(x: Column) -> Column:
    """Six significant digits, no trailing zeros; exponents below -4 or from 6 on are written out."""
    x = x.cast("double")
    shown = F.format_string("%.5e", x)
    power = F.regexp_extract(shown, r"e(.+)$", 1).cast("int")
    plain = F.regexp_replace(F.format_string("%.10f", shown.cast("double")), r"\.?0+$", "")
    return F.when((power >= -4) & (power < 6), plain).otherwise(F.regexp_replace(shown, r"\.?0+e", "e"))


def voxel_tag(size: Column) -> Column:
    """Six significant digits at most, ``p`` for the point: 0.05 -> 0p05."""
    return F.replace(six_digits(size), F.lit("."), F.lit("p"))


def cache_key(name: Column, size: Column, voxel: Column) -> Column:
    return F.concat(safe_stem(name), F.lit("_s"), size.cast("long").cast("string"), F.lit("_v"), voxel_tag(voxel), F.lit(".ply"))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(CLOUD), "point_cloud").when(ext.isin(IMAGE), "image").when(ext == "pdf", "pdf").otherwise("other")


def raw_kind(path: Column) -> Column:
    """The raw kind of a file by extension, then by MIME type; null if it is neither a cloud nor an image."""
    ext = extension(path)
    return F.when(ext.isin(CLOUD), "raw_pointcloud").when(ext.isin(IMAGE + MIME_IMAGE), "raw_image")


def registration_id(source: Column, target: Column, voxel: Column) -> Column:
    return F.concat(safe_stem(source), F.lit("__"), safe_stem(target), F.lit("_v"), voxel_tag(voxel))


def detection_id(name: Column, points: Column, voxel: Column, area: Column) -> Column:
    """``facade_``, the name with each odd character as an underscore (40 characters), and twelve hex digits over all parameters."""
    key = F.concat_ws("|", name, points.cast("string"), F.format_string("%.4f", voxel.cast("double")), F.format_string("%.2f", area.cast("double")))
    safe = F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_"), 1, 40)
    return F.concat(F.lit("facade_"), F.when(safe == "", "cloud").otherwise(safe), F.lit("_"), F.substring(F.sha1(key.cast("binary")), 1, 12))
