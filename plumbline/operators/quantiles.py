"""Exact quantiles of groups of any size, by refining histograms.

A group's interval is cut into ``BINS`` parts and counted; the part that holds the wanted rank becomes the next interval, shrunk to the
values in it. Once it holds no more than ``FEW`` values those are ordered; an interval of one value needs no order. So a
task never holds more than ``FEW`` values of a group, and rounds are few: each divides the interval by ``BINS`` at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.storage import release, stored

BINS = 256
FEW = 4096


def quantiles(rows: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """keys, n, quantile: between the two values around rank share * (n - 1), as SQL's PERCENTILE_CONT has it. Null values do not count;
    a NaN counts as largest, and groups with one, or with infinite values, are ordered as a whole."""
    kept = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n"), *ends)
    rank = F.col("n") - 1
    state = stored(sizes.withColumns({"_below": F.lit(0).cast("long"), "_in": F.col("n"), "_at": F.floor(rank * share), "_part": rank * share - F.floor(rank * share)}))
    done = []
    on = list(keys)
    while True:
        odd = F.isnan("_hi") | (F.abs("_hi") == float("inf")) | (F.abs("_lo") == float("inf"))
        single = F.col("_lo") == F.col("_hi")
        few = (F.col("_in") <= FEW) | odd
        done.append(state.where(single).select(*keys, "n", F.col("_lo").alias("quantile")))
        # both values lie in the interval, or the lower is its greatest and the upper the least above it
        small = kept.join(state.where(few & ~single), on).where(F.col("_v").between(F.col("_lo"), F.col("_hi")) | odd)
        ordered = small.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("_v")).alias("_s"), F.first("_at").alias("_at"), F.first("_below").alias("_below"), F.first("_part").alias("_part"))
        low = F.element_at("_s", (F.col("_at") - F.col("_below") + 1).cast("int"))
        high = F.element_at("_s", F.least(F.size("_s"), (F.col("_at") - F.col("_below") + 2).cast("int")))
        mixed = F.when(F.col("_part") > 0, low * (1 - F.col("_part")) + high * F.col("_part")).otherwise(low)
        done.append(ordered.select(*keys, "n", mixed.alias("quantile")))
        left = state.where(~few & ~single)
        if left.isEmpty():
            break
        width = F.col("_hi") / BINS - F.col("_lo") / BINS
        cell = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"))
        counts = stored(kept.join(left, on).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, cell.alias("_bin")).agg(F.count("*").alias("_c"), *ends))
        part = F.struct("_bin", "_c", "_lo", "_hi")
        # at most BINS entries a group
        bins = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_bins"))
        joined = left.drop("_lo", "_hi").join(bins, on)
        before = F.aggregate("_bins", F.struct(F.col("_below").alias("sum"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("next")),
            lambda a, b: F.struct(
                (a["sum"] + b["_c"]).alias("sum"),
                F.when(a["c"].isNull() & (a["sum"] + b["_c"] > F.col("_at")), a["sum"]).otherwise(a["below"]).alias("below"),
                F.when(a["c"].isNull() & (a["sum"] + b["_c"] > F.col("_at")), b["_c"]).otherwise(a["c"]).alias("c"),
                F.when(a["c"].isNull() & (a["sum"] + b["_c"] > F.col("_at")), b["_lo"]).otherwise(a["lo"]).alias("lo"),
                F.when(a["c"].isNull() & (a["sum"] + b["_c"] > F.col("_at")), b["_hi"]).otherwise(a["hi"]).alias("hi"),
                F.when(a["c"].isNotNull() & a["next"].isNull(), b["_lo"]).otherwise(a["next"]).alias("next"),
            ))
        found = stored(joined.withColumn("_f", before).select(*keys, "n", "_at", "_part", F.col("_f.below").alias("_below"), F.col("_f.c").alias("_in"), F.col("_f.lo").alias("_lo"), F.col("_f.hi").alias("_hi"), F.col("_f.next").alias("_next")))
        last = (F.col("_at") - F.col("_below") + 1 == F.col("_in")) & F.col("_next").isNotNull() & (F.col("_part") > 0)
        done.append(found.where(last).select(*keys, "n", (F.col("_hi") * (1 - F.col("_part")) + F.col("_next") * F.col("_part")).alias("quantile")))
        state = stored(found.where(~last).drop("_next"))
        release(counts)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
