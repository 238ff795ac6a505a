"""The demo scene: ``lineitem`` read as a scan of four surfaces.

Rows with supplier number modulo 4 equal to 0 and 1 form walls, 2 a floor, 3 a slope; discounts give noise of a few
millimetres, and return flags and line numbers give colours and tilted normals.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

S = math.sqrt(0.5)
#: facade_id, plane, centre, area, type
FACADES = [
    (0, 0.0, 1.0, 0.0, 0.0, 12.5, 0.0, 25.0, 1200.0, "vertical_facade"),
    (1, 1.0, 0.0, 0.0, -30.0, 30.0, 12.5, 25.0, 1250.0, "vertical_facade"),
    (2, 0.0, 0.0, 1.0, 0.0, 12.5, 7.5, 0.0, 375.0, "horizontal"),
    (3, 0.0, S, -S, 0.0, 12.5, 12.5, 12.5, 880.0, "inclined"),
]
FACADE_COLUMNS = "facade_id int, na double, nb double, nc double, nd double, cx double, cy double, cz double, area double, type string"

POSE = {
    "camera_matrix": [[1000.0, 0.0, 960.0], [0.0, 1000.0, 540.0], [0.0, 0.0, 1.0]],
    "rotation": [[1.0, 0.0, 0.0], [0.0, 0.0, -1.0], [0.0, 1.0, 0.0]],
    "translation": [-10.0, 25.0, 60.0],
    "distortion": [-0.05, 0.01, 0.001, -0.001, 0.0],
}
QUAD = [(850.0, 300.0), (1100.0, 320.0), (1080.0, 700.0), (870.0, 680.0)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facades(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACADES, FACADE_COLUMNS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facade_id, point_id, x, y, z, r, g, b, nx, ny, nz, l_suppkey, l_linenumber."""
    l = read(spark, sf_dir, "lineitem")
    u, v, w = F.col("l_quantity") * 0.5 + F.col("l_tax"), F.col("l_extendedprice") / 2000, (F.col("l_discount") - 0.05) * 0.1
    k = F.col("k")
    point_id = (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 32768 + F.col("l_partkey")) * 1024 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("long")
    rows = l.select(F.pmod("l_suppkey", F.lit(4)).cast("int").alias("k"), point_id.alias("point_id"), u.alias("u"), v.alias("v"), w.alias("w"), "l_returnflag", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    x = F.when(k == 1, 30 + F.col("w")).otherwise(F.col("u"))
    y = F.when(k == 0, F.col("w")).when(k == 1, F.col("u")).when(k == 2, 0.3 * F.col("v")).otherwise(0.5 * F.col("v") + F.col("w"))
    z = F.when(k <= 1, F.col("v")).when(k == 2, F.col("w")).otherwise(0.5 * F.col("v"))
    tilt = [(F.col("l_discount") - 0.05) * 0.4, (F.col("l_tax") - 0.04) * 0.4, (F.col("l_linenumber") - 4) * 0.02]
    base = [F.when(k == 1, 1.0).otherwise(0.0), F.when(k == 0, 1.0).when(k == 3, S).otherwise(0.0), F.when(k == 2, 1.0).when(k == 3, -S).otherwise(0.0)]
    n = g.unit([b + t for b, t in zip(base, tilt, strict=True)])
    flag = F.col("l_returnflag")
    red, green, blue = F.when(flag == "R", 0.9).otherwise(0.3), F.when(flag == "A", 0.8).otherwise(0.2), F.col("l_linenumber") / 7
    return rows.select(k.alias("facade_id"), "point_id", x.alias("x"), y.alias("y"), z.alias("z"), red.alias("r"), green.alias("g"), blue.alias("b"), *[c.alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)], "l_suppkey", "l_linenumber")
