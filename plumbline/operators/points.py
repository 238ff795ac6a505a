"""Operators on whole clouds: thinning, bounds, sampling, merging, colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import colours
from plumbline.functions import geometry as g
from plumbline.operators.storage import stored

P = ("x", "y", "z")


def voxel_downsample(points: DataFrame, size: float, *keys: str, attributes: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One point a voxel: the mean of its points and their attributes.

    Voxels are anchored half a voxel below each group's least corner. Size zero or less keeps the cloud.
    """
    if size <= 0:
        return points
    corner = points.groupBy(*keys).agg(*[(F.min(p) - size / 2).alias(f"_{p}0") for p in P])
    if keys:
        joined = points.join(stored(corner), list(keys))  # of known size, so that it is broadcast while it is small
    else:
        first = corner.first()
        joined = points.withColumns({k: F.lit(first[k]).cast("double") for k in corner.columns})
    cells = joined.select(*keys, *[F.floor((F.col(p) - F.col(f"_{p}0")) / size).alias(f"v{p}") for p in P], *P, *attributes)
    return cells.groupBy(*keys, "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in (*P, *attributes)], F.count("*").alias("points"))


def bounding_box(points: DataFrame, *keys: str) -> DataFrame:
    found = points.groupBy(*keys).agg(*[f(p).alias(f"{p}_{n}") for p in P for n, f in (("min", F.min), ("max", F.max))])
    return found.select("*", *[((F.col(f"{p}_min") + F.col(f"{p}_max")) / 2).alias(f"{p}_centre") for p in P], *[(F.col(f"{p}_max") - F.col(f"{p}_min")).alias(f"{p}_size") for p in P])


def sample_step(count: int, most: int) -> int:
    return max(1, -(-count // most)) if most > 0 else 1


def stride_sample(points: DataFrame, step: int, key: str = "point_id") -> DataFrame:
    """Every step-th key: the display sample."""
    return points.where(F.col(key) % step == 0)


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with their places 0, 1, 2 ... in an order (columns that tell rows apart), without bringing them to one task.

    Rows are dealt by ranges, sorted and stored with their place in their task; what a task has to add is the sum of the tasks' sizes before it.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    task = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(task.cast("long"), 33)
    kept = stored(dealt.withColumns({"_task": task, "_local": local}))
    sizes = sorted(tuple(r) for r in kept.groupBy("_task").agg(F.count("*")).collect())  # one row a task
    starts = [(t, sum(n for _, n in sizes[:i])) for i, (t, _) in enumerate(sizes)]
    first = rows.sparkSession.createDataFrame(starts, "_task int, _first long")
    return kept.join(first, "_task").withColumn(name, F.col("_first") + F.col("_local")).drop("_task", "_first", "_local")


def every_kth(rows: DataFrame, step: int, *order: str) -> DataFrame:
    """Every step-th row of an order, from the first on: exactly ceil(n / step) rows."""
    return numbered(rows, *order, name="_number").where(F.col("_number") % step == 0).drop("_number")


def is_uniform(points: DataFrame, *keys: str, eps: float = 1e-4) -> DataFrame:
    """Whether all points of a group have one colour, within eps."""
    spread = F.greatest(*[F.max(c) - F.min(c) for c in "rgb"])
    return points.groupBy(*keys).agg((F.coalesce(spread, F.lit(0.0)) <= eps).alias("uniform"))


def merge(source: DataFrame, target: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Both clouds in one table; a cloud without colours of its own is painted, red for the source, blue for the target."""
    parts = []
    for name, frame, paint in (("source", source, colours.SOURCE), ("target", target, colours.TARGET)):
        uniform = bool(is_uniform(frame, eps=eps).first()[0])
        painted = [F.lit(p) for p in paint] if uniform else colours.channels()
        parts.append(frame.select(F.lit(name).alias("cloud"), "point_id", *P, *[c.alias(k) for c, k in zip(painted, "rgb", strict=True)]))
    return parts[0].unionByName(parts[1])


def transform(points: DataFrame, matrix) -> DataFrame:
    moved = g.rigid(P, matrix)
    return points.withColumns({k: c for k, c in zip(P, moved, strict=True)})


def wire_arrays(points: DataFrame, *keys: str) -> DataFrame:
    """Flat float arrays in Y-up order for a viewer; only for clouds that a viewer can hold."""
    up = g.to_yup(*P)
    row = F.struct("point_id", F.array(*[c.cast("float") for c in up]).alias("p"), F.array(*[c.cast("float") for c in colours.channels()]).alias("c"))
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return rows.select(*keys, F.flatten(F.transform("_rows", lambda x: x["p"])).alias("positions"), F.flatten(F.transform("_rows", lambda x: x["c"])).alias("colors"))


def height_interval(value: Column, low: Column, size: float, count: Column) -> Column:
    """Half-open intervals of one size, the last closed."""
    return F.least(F.floor((value - low) / size).cast("int"), (count - 1).cast("int"))
