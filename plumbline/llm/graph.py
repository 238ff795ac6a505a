"""Connected components of a link table by alternating star contractions (Kiveris et al., 2014).

Each round reads and writes a table in the shared folder, so nothing gathers at the driver and a lost
executor costs one task. A hub with many links is only ever aggregated (map-side first) or joined on
its key, where adaptive execution splits a large partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (two columns a, b); root is the least node reachable."""
    edges = common.materialize(links.toDF("a", "b").where("a != b").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.toDF("a", "b")).distinct()
        edges = common.materialize(small, name)
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
