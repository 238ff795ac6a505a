"""Scan files: PLY and text clouds, sidecars, folder discovery and conversion jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import names

CLOUD = "path string, point_id long, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double"
_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_COLOURS = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b"}


def decode_ply(data: bytes) -> pd.DataFrame:
    """The vertices of a PLY file, ASCII or binary: x, y, z, and r, g, b (0 to 1), nx, ny, nz where present."""
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    form, count, fields, skip, now = "ascii", 0, [], 0, ""
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            now = w[1]
            if now == "vertex":
                count = int(w[2])
            elif not count and not fields:
                skip += 1
        elif w[:1] == ["property"] and now == "vertex":
            fields.append((w[-1], _TYPES[w[1]]))
    if skip:
        raise ValueError("vertices must be the first element")
    if form == "ascii":
        rows = np.array([x.split()[: len(fields)] for x in data[end:].decode().splitlines()[:count]], float).reshape(count, len(fields))
        got = {n: rows[:, i] for i, (n, _) in enumerate(fields)}
    else:
        order = "<" if "little" in form else ">"
        table = np.frombuffer(data, np.dtype([(n, order + t) for n, t in fields]), count, end)
        got = {n: table[n].astype(float) for n, _ in fields}
    kinds = dict(fields)
    for n, c in _COLOURS.items():
        if n in got:
            got[c] = got[n] / 255 if kinds[n] in ("u1", "i1") else got[n]
    return pd.DataFrame({c: got.get(c, np.full(count, np.nan)) for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")})


def encode_ply(points: pd.DataFrame) -> bytes:
    fields = [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]
    table = np.empty(len(points), np.dtype(fields))
    for c in "xyz":
        table[c] = points[c]
    for n, c in (("red", "r"), ("green", "g"), ("blue", "b")):
        table[n] = np.rint(np.clip(points[c].fillna(0.7) if c in points else 0.7, 0, 1) * 255)
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\n" + "".join(f"property {'double' if t == '<f8' else 'uchar'} {n}\n" for n, t in fields) + "end_header\n"
    return head.encode() + table.tobytes()


def read_ply(spark: SparkSession, path: str, batch: int = 200_000) -> DataFrame:
    """Points of all PLY files under a path (one task a file; an empty cloud has no rows)."""

    def run(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                got = decode_ply(content).astype(object).where(lambda d: d.notna(), None)
                got.insert(0, "path", where)
                got.insert(1, "point_id", range(len(got)))
                for i in range(0, len(got), batch):
                    yield got.iloc[i : i + batch]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ply").load(path)
    return files.select("path", "content").mapInPandas(run, CLOUD)


def read_text_cloud(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """xyz, xyzn, xyzrgb or pts text: whitespace-separated columns by name; rows without the numbers (a count line, say) drop out."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(columns)], F.size(parts).alias("_n"))
    return rows.where(F.col("_n") >= len(columns)).dropna(subset=["x", "y", "z"]).drop("_n")


def ply_vertex_count(header: Column) -> Column:
    """Vertices named by a PLY header's text (first 200 lines); null if it is none."""
    lines = F.array_join(F.slice(F.split(header, r"\r?\n"), 1, 200), "\n")
    return F.when(F.trim(F.substring_index(header, "\n", 1)) == "ply", F.regexp_extract(lines, r"(?m)^element vertex (\d+)\s*$", 1).try_cast("long"))


#: Fields of a scan's JSON sidecar.
SIDECAR = "scanName string, scannerType string, scannerSerial string, numCols int, numRows int, totalNumRows int, rowStartAngle_rad double, rowEndAngle_rad double, colEndAngle_rad double, scannerRange_m double, distOffset_m double, distFactor double, scanAngle_rad double, scanTime string, scanAxis array<double>, transformToGlobal array<array<double>>, gps map<string,string>, compass map<string,string>, sensorUsage map<string,string>"


def sidecars(texts: DataFrame) -> DataFrame:
    """Parsed sidecars (columns path, json) with defaults: text empty, numbers 0, the factor 1, the transform identity."""
    got = texts.select("path", F.from_json("json", SIDECAR).alias("m")).select("path", "m.*")
    text = {c: F.coalesce(c, F.lit("")) for c, t in got.dtypes if t == "string" and c != "path"}
    number = {c: F.coalesce(c, F.lit(1 if c == "distFactor" else 0).cast(t)) for c, t in got.dtypes if t in ("int", "double")}
    identity = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(4)]) for i in range(4)])
    return got.withColumns({**text, **number, "transformToGlobal": F.coalesce("transformToGlobal", identity)})


def project_index(scans: DataFrame) -> DataFrame:
    """One row a project: scans, points and the list of scans."""
    return scans.groupBy("project").agg(F.count("*").alias("scan_count"), F.sum("points").alias("total_points"), F.array_sort(F.collect_list(F.struct("scan_name", "points", "path"))).alias("scans"))


def discover_scans(files: DataFrame) -> DataFrame:
    """Scans among listed files (path, size): ``*.fls`` that are not empty and not within another ``.fls`` folder; a plain file whose
    expanded folder of the same name is listed gives way to it."""
    inside = F.regexp_extract("path", r"(?i)^(.*?\.fls)/", 1)
    packages = files.where(inside != "").select(F.lower(inside).alias("key"), inside.alias("path")).groupBy("key").agg(F.min("path").alias("path"))
    plain = files.where((inside == "") & F.lower("path").endswith(".fls") & (F.col("size") > 0)).select(F.lower("path").alias("key"), "path")
    return packages.withColumn("expanded", F.lit(True)).unionByName(plain.join(packages, "key", "left_anti").withColumn("expanded", F.lit(False))).select("path", "expanded")


def conversion_jobs(scans: DataFrame) -> DataFrame:
    """Output names; names that only differ in case get _2, _3 in path order."""
    stem = names.safe_stem(F.col("path"))
    order = Window.partitionBy(F.lower("stem")).orderBy("path")
    numbered = scans.withColumn("stem", stem).withColumn("_n", F.row_number().over(order))
    return numbered.select("path", F.concat("stem", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(".ply")).alias("output"))


def conversion_results(jobs: DataFrame, existing: DataFrame, attempts: DataFrame, *, overwrite: bool = False, keep_empty: bool = False, dry_run: bool = False) -> DataFrame:
    """jobs with status OK, SKIPPED, FAILED or DRY_RUN, points and ``remove``, whether an output left behind is to be deleted.

    ``existing`` (output, points) lists outputs from before, points null where the file cannot be read; they are skipped, or fail if unreadable, unless
    overwritten. ``attempts`` (path, exit_code, written, points) tells of converter runs: no exit code means it ran out of time.
    """
    before = existing.select("output", F.col("points").alias("_old"), F.lit(True).alias("_there"))
    tried = attempts.select("path", "exit_code", F.coalesce("written", F.lit(False)).alias("_written"), F.col("points").alias("_new"))
    rows = jobs.join(before, "output", "left").join(tried, "path", "left")
    stays = F.coalesce("_there", F.lit(False)) & F.lit(not overwrite)
    good = (F.col("exit_code") == 0) & F.col("_written") & F.col("_new").isNotNull() & ((F.col("_new") > 0) | F.lit(keep_empty))
    status = F.when(stays, F.when(F.col("_old").isNull(), "FAILED").otherwise("SKIPPED")).when(F.lit(dry_run), "DRY_RUN").when(good, "OK").otherwise("FAILED")
    out = rows.withColumn("status", status).withColumn("points", F.when(stays, F.col("_old")).when(~F.lit(dry_run), F.col("_new")))
    return out.withColumn("remove", ~stays & F.lit(not dry_run) & (F.col("status") == "FAILED") & F.coalesce("_written", F.lit(False))).select(*jobs.columns, "status", "points", "remove")


def conversion_report(results: DataFrame) -> DataFrame:
    """Results (status OK, SKIPPED, FAILED or DRY_RUN) counted."""
    return results.groupBy("status").agg(F.count("*").alias("jobs"), F.sum("points").alias("points"))


def useful_lines(text: Column) -> Column:
    """The lines of a converter's log that tell of errors, warnings, loading, saving or points."""
    wanted = F.filter(F.split(text, r"\r?\n"), lambda line: F.lower(line).rlike(r"error|warn|load|save|point"))
    return F.array_join(F.transform(wanted, lambda line: F.trim(line)), "\n")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
