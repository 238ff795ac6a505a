"""Scanner folders: scans found from a root, and the converter's log as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.storage import stored
from plumbline.sources import clouds, scans

ENTRIES = "path string, size long, is_dir boolean"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, size and is_dir of everything under a folder, one round of tasks a level. Folders named ``*.fls`` are listed, not entered."""
    import pandas as pd
    from pyarrow import fs

    where, top = clouds.opened(root)
    if where.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(root)

    def run(frames):
        for frame in frames:
            rows = []
            for folder in frame["path"]:
                for f in where_of(root).get_file_info(fs.FileSelector(folder)):
                    rows.append((f.path, f.size, f.type == fs.FileType.Directory))
            yield pd.DataFrame(rows, columns=["path", "size", "is_dir"])

    def where_of(path: str):
        return clouds.opened(path)[0]

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, levels = spark.createDataFrame([(top,)], "path string"), []
    while True:
        found = stored(frontier.repartition(tasks, "path").mapInPandas(run, ENTRIES))
        levels.append(found)
        frontier = found.where(F.col("is_dir") & ~F.lower("path").endswith(".fls")).select("path")
        if frontier.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, expanded) of the scans at or under a path: expanded ``.fls`` folders and plain ``.fls`` files that are not empty, none of them within another such
    folder. A path that is a file or such a folder is the scan itself; a missing one is an error."""
    from pyarrow import fs

    where, top = clouds.opened(root)
    kind = where.get_file_info(top).type
    if kind == fs.FileType.File or (kind == fs.FileType.Directory and top.rstrip("/").lower().endswith(".fls")):
        return spark.createDataFrame([(top, kind == fs.FileType.Directory)], "path string, expanded boolean")
    found = walk(spark, root).where(F.lower("path").endswith(".fls") & (F.col("is_dir") | (F.col("size") > 0)))
    return found.select("path", F.col("is_dir").alias("expanded"))


#: The converter's lines that tell of scans, and its exit codes with a known cause (signed and unsigned).
FOUND, EXPORTED = r"\[INFO\] Found (\d+) scan\(s\)", r"\[OK\] Exported: (.+?) \((\d+) points"
CAUSES = {3221225781: "a runtime library is missing", -1073741515: "a runtime library is missing", 3221225477: "access violation in the scanner's library", -1073741819: "access violation in the scanner's library"}


def _json_path(ply: Column) -> Column:
    return F.concat(F.regexp_replace(ply, r"\.[^./\\]*$", ""), F.lit(".json"))


def exported_scans(lines: DataFrame) -> DataFrame:
    """run, scan, line, ply_path, json_path, points, warnings: one row a scan of each converter run, in its order.

    ``lines`` (run, line, text) are a run's output, numbered. Warnings and errors between two exports belong to the later one.
    """
    text = F.col("text")
    ply, points = F.regexp_extract(text, EXPORTED, 1), F.regexp_extract(text, EXPORTED, 2)
    trouble = F.lower(text).rlike(r"\[(warn|warning|error|fail)\]")
    marked = lines.select("run", "line", text.rlike(EXPORTED).alias("_done"), ply.alias("ply_path"), points.try_cast("long").alias("points"), F.when(trouble, F.trim(text)).alias("_said"))
    told = marked.where(F.col("_done") | F.col("_said").isNotNull())
    before = Window.partitionBy("run").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("scan", F.coalesce(F.sum(F.col("_done").cast("long")).over(before), F.lit(0)) + 1)
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("line", "_said")))), lambda s: s["_said"])
    scan = placed.groupBy("run", "scan").agg(F.max(F.when(F.col("_done"), F.struct("line", "ply_path", "points"))).alias("e"), said.alias("warnings"))
    return scan.where("e is not null").select("run", "scan", "e.line", "e.ply_path", _json_path(F.col("e.ply_path")).alias("json_path"), "e.points", "warnings")


def conversion_runs(lines: DataFrame, exits: DataFrame) -> DataFrame:
    """run, found, exported, points, success, message of each converter run; ``exits`` (run, exit_code, elapsed_s) names all runs, without a code where
    time ran out."""
    found = lines.where(F.col("text").rlike(FOUND)).groupBy("run").agg(F.max(F.struct("line", F.regexp_extract("text", FOUND, 1).try_cast("long").alias("n"))).alias("f"))
    done = exported_scans(lines).groupBy("run").agg(F.count("*").alias("exported"), F.sum("points").alias("points"))
    rows = exits.join(found, "run", "left").join(done, "run", "left").select("run", "exit_code", "elapsed_s", F.coalesce("f.n", F.lit(0)).alias("found"), F.coalesce("exported", F.lit(0)).alias("exported"), F.coalesce("points", F.lit(0)).alias("points"))
    code = F.col("exit_code")
    cause = F.coalesce(*[F.when(code == c, F.lit(f" ({why})")) for c, why in CAUSES.items()], F.lit(""))
    good = F.concat_ws("", F.lit("exported "), "exported", F.lit(" of "), "found", F.lit(" scans, "), "points", F.lit(" points, "), F.format_string("%.1f", "elapsed_s"), F.lit(" s"))
    message = F.when(code.isNull(), "the converter ran out of time").when(code != 0, F.concat(F.lit("the converter ended with code "), code.cast("string"), cause)).when(F.col("exported") > 0, good).otherwise("no scans were found")
    return rows.withColumns({"success": F.coalesce((code == 0) & (F.col("exported") > 0), F.lit(False)), "message": message}).drop("elapsed_s")


def scan_records(lines: DataFrame, sidecar_texts: DataFrame) -> DataFrame:
    """``exported_scans`` with the fields of their sidecars (path, json); without a sidecar, or with one that is no JSON, a scan has the defaults."""
    done = exported_scans(lines)
    wanted = done.select(F.col("json_path").alias("path")).distinct().join(sidecar_texts.select("path", "json"), "path", "left")
    parsed = scans.sidecars(wanted.select("path", F.coalesce("json", F.lit("{}")).alias("json")))
    return done.join(parsed.withColumnRenamed("path", "json_path"), "json_path")
