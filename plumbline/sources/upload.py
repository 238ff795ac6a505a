"""One file brought into a project: judged, entered in the catalog, loaded and thinned."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import catalog
from plumbline.operators.points import voxel_downsample
from plumbline.sources import clouds, scans

#: Columns of text clouds by extension.
TEXT = {"xyz": ["x", "y", "z"], "pts": ["x", "y", "z"], "xyzn": ["x", "y", "z", "nx", "ny", "nz"], "xyzrgb": ["x", "y", "z", "r", "g", "b"]}


def kind_of(spark: SparkSession, path: str) -> str:
    """raw_pointcloud or raw_image; other files are an error."""
    found = spark.range(1).select(names.raw_kind(F.lit(path))).first()[0]
    if found is None:
        raise ValueError(f"files like {path} are not supported")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """The points of a cloud file of any kind, by its extension."""
    ext = path.rpartition(".")[2].lower()
    if ext in TEXT:
        return scans.read_text_cloud(spark, path, TEXT[ext])
    return clouds.read_cloud(spark, path)


def upload(projects: DataFrame, scenes: DataFrame, files: DataFrame, path: str, now: Column, *, project_uuid: str | None = None, voxel: float = 0.05, copy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(scenes, files, display cloud or None for an image): the file is entered under the project's active scene, where a project is given; a cloud is
    loaded and thinned. With ``copy`` the entry names the file's place in the project; moving bytes is the caller's, so the file is read where it is."""
    spark = projects.sparkSession
    where, at = clouds.opened(path)
    if where.get_file_info(at).type != fs.FileType.File:
        raise FileNotFoundError(path)
    kind = kind_of(spark, path)
    if project_uuid is not None:
        listed = scans.file_hashes(spark, path).withColumn("path", F.lit(path))
        scenes, files = catalog.import_files(projects, scenes, files, listed, project_uuid, kind, now, copy=copy)
    if kind != "raw_pointcloud":
        return scenes, files, None
    cloud = load(spark, path)
    colours = tuple(c for c in "rgb" if c in cloud.columns)
    return scenes, files, voxel_downsample(cloud, voxel, attributes=colours)
