"""Flatness and verticality of walls, measured with a simulated straightedge.

A wall's points are cut into height intervals; in each, a square window slides over the plane in small steps. A window's
gap is the distance of its points' centroid from the interval's plane; as the plane is linear, that is the
absolute mean of its points' signed distances. The windows over a point are a range along u times a range along v; points with
equal ranges are summed first, then sums are dealt along u and summed, then along v. So a point moves once, and the (ruler / step)^2
windows over it are never listed. Step counts follow from the interval's extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import planes
from plumbline.operators.storage import stored

P = ("x", "y", "z")
INTERVAL, RULER, STEP, LIMIT, LEAST = 20.0, 2.0, 0.05, 0.004, 30


def _units(digits: int | None, *lengths: float) -> list[float]:
    """Lengths as whole numbers of 10**-digits, if digits are given."""
    return [float(round(x * 10**digits)) for x in lengths] if digits is not None else list(lengths)


def _whole(length: Column, digits: int | None) -> Column:
    return F.floor(length * 10.0**digits + 0.5).cast("double") if digits is not None else length


def intervals(points: DataFrame, walls: DataFrame, size: float = INTERVAL, least: int = LEAST, *, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with their interval, interval planes).

    Intervals run along v of the wall's plane, from its least v; they are half-open but for the last. Those under
    ``least`` points vanish and the others are numbered from 0 in order. ``walls`` has facade_id, plane and centre. For ``digits`` see ``windows``.
    """
    placed = planes.with_uv(points, walls, "facade_id").drop(*planes.PLANE, "cx", "cy", "cz", "u")
    # tables of a row a wall or interval are stored: of known size, they are broadcast and no wall is dealt to one task
    span = stored(placed.groupBy("facade_id").agg(F.min("v").alias("_v0"), F.max("v").alias("_v1")))
    (units,) = _units(digits, size)
    n = F.greatest(F.lit(1), F.ceil(_whole(F.col("_v1") - F.col("_v0"), digits) / units)).cast("int")
    cut = placed.join(span, "facade_id").withColumn("slot", F.least(F.floor(_whole(F.col("v") - F.col("_v0"), digits) / units).cast("int"), n - 1)).drop("v", "_v0", "_v1")
    sizes = cut.groupBy("facade_id", "slot").agg(F.count("*").alias("points")).where(F.col("points") >= least)
    numbered = sizes.withColumn("interval_id", F.row_number().over(Window.partitionBy("facade_id").orderBy("slot")) - 1)
    kept = cut.join(stored(numbered.select("facade_id", "slot", "interval_id")), ["facade_id", "slot"]).drop("slot")
    return kept, planes.fit(kept, "facade_id", "interval_id", exact=digits is not None)


def _steps(extent: Column, ruler: float, step: float) -> Column:
    """Window positions along one axis; a span under the ruler gets one, centred."""
    return F.when(extent < ruler, 1).otherwise(F.floor((extent - ruler) / step + 1e-9) + 1).cast("int")


def _spans(points: DataFrame, interval_planes: DataFrame, ruler: float, step: float, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with u, v and s in their interval's plane, each interval's window counts nu, nv and first starts ou, ov). With ``digits``, u and v are whole
    numbers of 10**-digits from the interval's least, and so are the ruler and the step."""
    key = ["facade_id", "interval_id"]
    flat = planes.with_uv(points, interval_planes, *key).select(*key, "point_id", F.inline(F.array(F.struct("u", "v", g.signed_distance(P, planes.PLANE).alias("s")))))
    span = flat.groupBy(*key).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    if digits is not None:
        span = stored(span)
        flat = flat.join(span.select(*key, "u0", "v0"), key).select(*key, "point_id", *[_whole(F.col(a) - F.col(f"{a}0"), digits).alias(a) for a in "uv"], "s")
        span = span.select(*key, *[c.alias(f"{a}{i}") for a in "uv" for i, c in enumerate((F.lit(0.0), _whole(F.col(f"{a}1") - F.col(f"{a}0"), digits)))])
    for a in "uv":
        extent = F.col(f"{a}1") - F.col(f"{a}0")
        span = span.withColumn(f"n{a}", _steps(extent, ruler, step)).withColumn(f"o{a}", F.when(extent < ruler, (F.col(f"{a}0") + F.col(f"{a}1") - ruler) / 2).otherwise(F.col(f"{a}0")))
    return flat, stored(span.select(*key, "nu", "nv", "ou", "ov"))


def _covering(flat: DataFrame, span: DataFrame, ruler: float, step: float) -> DataFrame:
    """``flat`` with the windows over each point as ranges au..bu and av..bv, both window bounds closed; points under none drop out."""
    out = flat.join(span, ["facade_id", "interval_id"])
    guesses, exact = [], []
    for a in "uv":
        x, o = F.col(a), F.col(f"o{a}")
        # rounding of a guess is settled by the exact test on its neighbours
        guesses += [(F.ceil((x - o - ruler) / step).cast("int") - 1).alias(f"_low{a}"), (F.floor((x - o) / step).cast("int") + 1).alias(f"_high{a}")]
        reaches = lambda k, x=x, o=o: x <= o + k * step + ruler
        begins = lambda k, x=x, o=o: x >= o + k * step
        k = F.col(f"_low{a}")
        first = F.when(reaches(k), k).when(reaches(k + 1), k + 1).otherwise(k + 2)
        k = F.col(f"_high{a}")
        last = F.when(begins(k), k).when(begins(k - 1), k - 1).otherwise(k - 2)
        exact += [F.greatest(F.lit(0), first).alias(f"a{a}"), F.least(F.col(f"n{a}") - 1, last).alias(f"b{a}")]
    # behind inline each expression is evaluated once and stays out of what the optimizer infers from the filter
    out = out.select("*", F.inline(F.array(F.struct(*guesses)))).select("*", F.inline(F.array(F.struct(*exact))))
    return out.drop("_lowu", "_highu", "_lowv", "_highv").where("au <= bu AND av <= bv")


def windows(points: DataFrame, interval_planes: DataFrame, *, ruler: float = RULER, step: float = STEP, least: int = LEAST, most: int | None = None, digits: int | None = None) -> DataFrame:
    """facade_id, interval_id, window (ku, kv), points, gap (metres) of all windows with enough points.

    Both window bounds are closed. With ``digits``, places are measured from the interval's least in whole numbers of 10**-digits, so a point on a bound is
    in; without, the last bits of the interval's plane decide, which follow the order in which points were summed. Only if asked for by ``most``, a stride
    common to both axes thins the windows of an interval to about that many.
    """
    key = ["facade_id", "interval_id"]
    ruler, step = _units(digits, ruler, step)
    flat, span = _spans(points, interval_planes, ruler, step, digits)
    total = F.col("nu").cast("double") * F.col("nv")
    stride = F.when(total > most, F.ceil(F.sqrt(total / most))).otherwise(1).cast("int") if most else F.lit(1)
    sums = lambda n, s: (F.sum(n).alias("points"), F.sum(s).alias("total"))
    summed = _covering(flat, span.withColumn("stride", stride), ruler, step).groupBy(*key, "stride", "au", "bu", "av", "bv").agg(F.count("*").alias("points"), F.sum("s").alias("total"))
    rest = [*key, "stride", "av", "bv"]
    for a in "uv":
        first = (F.ceil(F.col(f"a{a}") / F.col("stride")) * F.col("stride")).cast("int")
        range_ = F.when(first <= F.col(f"b{a}"), F.sequence(first, F.col(f"b{a}"), F.col("stride"))).otherwise(F.array().cast("array<int>"))
        by = [*rest, "ku"] if a == "u" else [*key, "ku", "kv"]
        summed = summed.withColumn(f"k{a}", F.explode(range_)).groupBy(*by).agg(*sums("points", "total"))
    return summed.where(F.col("points") >= least).select(*key, "ku", "kv", "points", F.abs(F.col("total") / F.col("points")).alias("gap"))


def interval_results(points: DataFrame, interval_planes: DataFrame, found: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Each interval's worst window, gap, verticality and compliance.

    If no window has a gap above zero, the interval's own spread (largest minus least signed distance) counts, and there is no window.
    """
    key = ["facade_id", "interval_id"]
    own = planes.with_plane(points, interval_planes, *key).withColumn("_s", g.signed_distance(P, planes.PLANE))
    spread = own.groupBy(*key).agg((F.max("_s") - F.min("_s")).alias("_spread"), F.count("*").alias("point_count"))
    # the first window in scan order among the worst
    worst = found.where("gap > 0").groupBy(*key).agg(F.max(F.struct(F.col("gap"), (-F.col("kv")).alias("kv"), (-F.col("ku")).alias("ku"))).alias("_w"), F.count("*").alias("_n"))
    counted = found.groupBy(*key).agg(F.count("*").alias("windows"))
    lean = g.verticality("nc")
    joined = interval_planes.join(spread, key).join(counted, key, "left").join(worst, key, "left")
    out = joined.select(
        *key,
        "point_count",
        F.coalesce("windows", F.lit(0)).alias("windows"),
        F.coalesce("_w.gap", "_spread").alias("gap"),
        (-F.col("_w.ku")).alias("worst_ku"),
        (-F.col("_w.kv")).alias("worst_kv"),
        lean.alias("verticality"),
        g.vertical_deviation(lean).alias("deviation"),
    )
    return out.withColumn("compliant", F.col("gap") <= limit)


def overall(results: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per wall: intervals, largest gap, worst verticality and whether every interval complies."""
    gap = F.max("gap")
    return results.groupBy("facade_id").agg(F.count("*").alias("intervals"), gap.alias("gap"), F.max("verticality").alias("verticality"), F.max("deviation").alias("deviation"), (gap <= limit).alias("compliant"), F.count(F.when(F.col("compliant"), 1)).alias("compliant_intervals"))


#: Levels: 0 pass, 1 warn, 2 fail, -1 not assessed.
def level(gap: Column, limit: float = LIMIT) -> Column:
    return F.when(gap <= limit, 0).when(gap <= 2 * limit, 1).otherwise(2)


def level_results(found: DataFrame, limit: float = LIMIT, compliance: float = 0.95) -> DataFrame:
    """Per interval: windows by level, share that passes, and whether that share is enough."""
    lv = level(F.col("gap"), limit)
    counts = found.groupBy("facade_id", "interval_id").agg(F.count("*").alias("windows"), *[F.count(F.when(lv == k, 1)).alias(n) for k, n in enumerate(("passed", "warned", "failed"))], F.max("gap").alias("gap"))
    return counts.withColumn("compliance", F.col("passed") / F.col("windows")).withColumn("compliant", F.col("compliance") >= compliance)


def weighted_overall(results: DataFrame, points: DataFrame) -> DataFrame:
    """Per wall: interval gaps and compliance, weighted by points."""
    n = points.groupBy("facade_id", "interval_id").agg(F.count("*").alias("n"))
    w = F.sum("n")
    return results.join(n, ["facade_id", "interval_id"]).groupBy("facade_id").agg((F.sum(F.col("gap") * F.col("n")) / w).alias("gap"), (F.sum(F.col("compliance") * F.col("n")) / w).alias("compliance"), w.alias("points"))


def point_levels(points: DataFrame, interval_planes: DataFrame, found: DataFrame, *, ruler: float = RULER, step: float = STEP, limit: float = LIMIT) -> DataFrame:
    """Each point's worst window level, -1 where no window covers it; both window bounds are closed.

    The windows over a point are a range along u times one along v. Levels are reduced over each range along u that occurs, then over
    each along v, so points meet one row, not their windows.
    """
    key = ["facade_id", "interval_id"]
    flat, span = _spans(points, interval_planes, ruler, step)
    covered = _covering(flat, span, ruler, step).select(*key, "point_id", "au", "bu", "av", "bv")
    ranges = covered.groupBy(*key, "au", "bu", "av", "bv").agg(F.count("*").alias("_n")).drop("_n")
    levels = found.select(*key, "ku", "kv", level(F.col("gap"), limit).alias("level"))
    along = ranges.select(*key, "au", "bu").distinct().withColumn("ku", F.explode(F.sequence("au", "bu"))).join(levels, [*key, "ku"])
    along = along.groupBy(*key, "au", "bu", "kv").agg(F.max("level").alias("level"))
    worst = ranges.withColumn("kv", F.explode(F.sequence("av", "bv"))).join(along, [*key, "au", "bu", "kv"]).groupBy(*key, "au", "bu", "av", "bv").agg(F.max("level").alias("level"))
    told = covered.join(worst, [*key, "au", "bu", "av", "bv"]).select(*key, "point_id", "level")
    return points.select(*key, "point_id").join(told, [*key, "point_id"], "left").select(*key, "point_id", F.coalesce("level", F.lit(-1)).alias("level"))


def empty_overall(spark: SparkSession, size: float = INTERVAL, ruler: float = RULER, limit: float = LIMIT, *, levels: bool = False) -> DataFrame:
    """The record of a wall without points: no type, no gap, no intervals; with ``levels``, full compliance and no counted points."""
    row = {"type": "unknown", "verticality": 0.0, "horizontality": 0.0, "gap": 0.0, "point_count": 0, "intervals": 0, "interval_size": size, "ruler_size": ruler, "limit": limit}
    if levels:
        row |= {"compliance": 1.0, "passed": 0, "warned": 0, "failed": 0, "unassessed": 0}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
