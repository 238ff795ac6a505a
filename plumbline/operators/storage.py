"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """df written under the session's ``spark.checkpoint.dir`` and read back; a local session without one gets a temporary folder."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        where = sc.getCheckpointDir()
    path = f"{where.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables that ``stored`` made and nothing reads any more."""
    for f in frames:
        if path := getattr(f, "_plumbline_path", None):
            sc = f.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
