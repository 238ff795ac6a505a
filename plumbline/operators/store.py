"""Saved registrations and detections: tables under a folder, one version for each time an id is saved.

A result's parts are written under a fresh version first; then one manifest, which holds the header and names the version, replaces the one before in a
single rename. Readers follow the manifest, so a save that breaks off anywhere leaves the earlier result whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is stored about a registration and a detection.
REGISTRATIONS = "created_at timestamp, source_filename string, target_filename string, voxel_size double, transformation array<double>, point_count long, metrics map<string,double>"
DETECTIONS = "created_at timestamp, source_filename string, point_count long, voxel_size double, min_area double, facade_count long"


def _file(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file written aside and moved over the one before, in one step."""
    jvm = spark.sparkContext._jvm
    temporary, files = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _file(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(temporary), files.makeQualified(target), rename)


def save(header: DataFrame, path: str, id_: str, **parts: DataFrame) -> None:
    """The one-row header and its tables, in place of an earlier result of the same id."""
    spark, version = header.sparkSession, uuid.uuid4().hex
    for name, table in parts.items():
        table.write.parquet(f"{path}/parts/{id_}/{version}/{name}")
    row = header.select("*", F.lit(id_).alias("id"), F.lit(version).alias("version"), F.array(*map(F.lit, sorted(parts))).cast("array<string>").alias("parts"))
    _replace(spark, f"{path}/header/{id_}.json", row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).first()[0])


def prune(spark: SparkSession, path: str, id_: str) -> int:
    """Deletes versions of a result that its manifest does not name, when nobody reads them any more; gives their number."""
    folder, files = _file(spark, f"{path}/parts/{id_}")
    if not files.exists(folder):
        return 0
    now = manifest(spark, path, id_)["version"]
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() != now]
    for p in old:
        files.delete(p, True)
    return len(old)


def manifest(spark: SparkSession, path: str, id_: str) -> dict:
    """The header of a result as saved; FileNotFoundError if there is none."""
    at, files = _file(spark, f"{path}/header/{id_}.json")
    if not files.exists(at):
        raise FileNotFoundError(f"no result {id_} under {path}")
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(str(at)).collect()))


def listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headers, newest first; unreadable ones are left out. ``complete`` tells whether the result has parts."""
    rows = spark.read.schema(schema + ", id string, version string, parts array<string>, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(f"{path}/header")
    kept = rows.where("created_at IS NOT NULL AND id IS NOT NULL")
    return kept.withColumn("complete", F.size("parts") > 0).drop("_corrupt", "version", "parts").orderBy(F.desc("created_at"), "id")


def load(spark: SparkSession, path: str, id_: str, part: str, *, expected: int | None = None) -> DataFrame:
    """A saved table; an error if the result lacks it or its rows are not as many as expected."""
    said = manifest(spark, path, id_)
    if part not in said["parts"]:
        raise FileNotFoundError(f"{id_} was saved without {part}")
    table = spark.read.parquet(f"{path}/parts/{id_}/{said['version']}/{part}")
    if expected is not None and (n := table.count()) != expected:
        raise ValueError(f"{part} of {id_} has {n} rows, not {expected}")
    return table


def load_labels(path: str, id_: str, points: DataFrame) -> DataFrame:
    """(point_id, facade_id) of a saved detection for the cloud it was made on, from its ``labels`` or, where those were not saved, from its ``members``
    (facade_id, point_id; ids the cloud lacks do not count). An error if the cloud has another number of points or no facade was saved."""
    from plumbline.operators.detect import dense_labels

    spark = points.sparkSession
    said, n = manifest(spark, path, id_), points.count()
    if n != said["point_count"]:
        raise ValueError(f"the cloud has {n} points, the saved result {said['point_count']}")
    if not said["facade_count"]:
        raise ValueError(f"{id_} was saved without facades")
    if "labels" in said["parts"]:
        return load(spark, path, id_, "labels", expected=n)
    return dense_labels(points.select("point_id"), load(spark, path, id_, "members"))


def thinned(points: DataFrame, path: str, voxel: float) -> DataFrame:
    """The thinned cloud kept under ``path``, made if it is missing or empty."""
    from plumbline.operators.points import voxel_downsample

    spark = points.sparkSession
    folder, files = _file(spark, path)
    if files.exists(folder):
        kept = spark.read.parquet(path)
        if not kept.isEmpty():
            return kept
    voxel_downsample(points, voxel).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
