"""Connected components over grid cells and over neighbour links, and density clusters.

Every node hooks to its least lower neighbour, chains of hooks are followed by pointer jumping, and links are carried over to the
roots, of which few remain after a few rounds. Each round is written to shared storage, the one before is deleted.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import blocks, neighbors
from plumbline.operators.storage import release, stored

P = ("x", "y", "z")


def labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every node; label is the least node reachable. ``links`` (a, b) may be one-way."""
    now = stored(nodes.select("node", F.col("node").alias("label")))
    edges = stored(links.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).where("p != q").distinct())
    while not edges.isEmpty():
        roots = _jumped(stored(edges.groupBy("q").agg(F.min("p").alias("root")).withColumnRenamed("q", "tree")))
        ends = edges.join(roots.toDF("p", "_p"), "p", "left").join(roots.toDF("q", "_q"), "q", "left").select(F.coalesce("_p", "p").alias("p"), F.coalesce("_q", "q").alias("q"))
        before = (now, edges, roots)
        now = stored(now.join(roots.toDF("label", "_root"), "label", "left").select("node", F.coalesce("_root", "label").alias("label")))
        edges = stored(ends.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).where("p != q").distinct())
        release(*before)
    return now


def _jumped(hooks: DataFrame) -> DataFrame:
    """(tree, root) with every root the end of its chain of hooks; hooks lead to lower nodes."""
    while True:
        after = stored(hooks.join(hooks.toDF("root", "_next"), "root", "left").select("tree", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        release(hooks)
        hooks = after.select("tree", "root")
        hooks._plumbline_path = after._plumbline_path
        if after.where("moved").isEmpty():
            return hooks


def grid_cells(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """Cell (i, j) of each point's (u, v), counted from its group's least u and v."""
    return placed_cells(points, points, size, *keys)


def placed_cells(points: DataFrame, group: DataFrame, size: float, *keys: str) -> DataFrame:
    """``points`` with the cells that ``grid_cells`` of ``group`` has in their places."""
    corner = group.groupBy(*keys).agg(F.min("u").alias("_u0"), F.min("v").alias("_v0"))
    cell = {"i": F.floor((F.col("u") - F.col("_u0")) / size), "j": F.floor((F.col("v") - F.col("_v0")) / size)}
    return points.join(stored(corner), list(keys)).withColumns(cell).drop("_u0", "_v0")


def adaptive_size(points: DataFrame, radius: float, ratio: float = 2.5, share: float = 0.1, least: float = 0.02) -> float:
    """A grid size from the mean nearest-neighbour spacing of a hash-drawn share of the points, about twenty at least; rings start at ``radius``.
    Without two points the spacing counts as 0.1."""
    share = max(share, min(1.0, 20 / max(points.count(), 1)))
    drawn = points.where(F.pmod(F.xxhash64("point_id"), F.lit(1000)) < int(1000 * share)).select("point_id", "x", "y", "z")
    spacing = neighbors.mean_neighbour_distance(drawn, 1, radius).agg(F.avg("mean_dist")).first()[0]
    return max(least, ratio * (spacing or 0.1))


def grid_components(points: DataFrame, size: float, least_cells: int, key: str, width: int = 1 << 20) -> DataFrame:
    """(key, i, j, component): occupied cells, joined to their four neighbours; the component is named by its least
    cell number i * width + j. Components under ``least_cells`` cells drop out, but for groups under 1e-6 wide both ways, which are one component."""
    cells = stored(grid_cells(points, size, key).select(key, "i", "j").distinct())
    number = (F.col("i") * width + F.col("j")).alias("n")
    own = cells.select(F.struct(F.col(key).alias("k"), number).alias("node"))
    step = cells.select(key, F.col("i"), F.col("j"), F.explode(F.array(F.lit(width), F.lit(1))).alias("step"))
    links = step.select(F.struct(F.col(key).alias("k"), number).alias("a"), F.struct(F.col(key).alias("k"), (F.col("i") * width + F.col("j") + F.col("step")).alias("n")).alias("b"))
    links = links.join(own.select(F.col("node").alias("b")), "b", "left_semi")
    found = labels(own, links).select(F.col("node.k").alias(key), F.floor(F.col("node.n") / width).alias("i"), (F.col("node.n") % width).alias("j"), F.col("label.n").alias("component"))
    tiny = points.groupBy(key).agg(((F.max("u") - F.min("u") < 1e-6) & (F.max("v") - F.min("v") < 1e-6)).alias("_tiny"))
    sizes = found.groupBy(key, "component").agg(F.count("*").alias("cells")).join(tiny, key).where((F.col("cells") >= least_cells) | F.col("_tiny"))
    return found.join(sizes.drop("_tiny"), [key, "component"])


#: A core cell's points are boxed in CUT parts an axis to find links.
CUT = 4


def _boxes(core: DataFrame, side: float, *keys: str) -> DataFrame:
    """keys, cell i, j, k, node (the cell's least point) and the boxes of the points in each of the cell's parts."""
    cell = {c: F.floor(F.col(p) / side).cast("long") for c, p in zip("ijk", P, strict=True)}
    part = {f"s{p}": F.floor((F.col(p) / side - F.floor(F.col(p) / side)) * CUT) for p in P}
    ends = [f(p).alias(f"{p}{e}") for p in P for e, f in ((0, F.min), (1, F.max))]
    parts = core.withColumns({**cell, **part}).groupBy(*keys, *"ijk", *part).agg(F.min("point_id").alias("_least"), F.count("*").alias("_n"), *ends)
    own = parts.groupBy(*keys, *"ijk").agg(F.min("_least").alias("node"))
    return parts.drop("_least").join(own, [*keys, *"ijk"])


def cell_links(core: DataFrame, boxes: DataFrame, side: float, eps: float, *keys: str) -> DataFrame:
    """(a, b) of core cells, named by their least points, with points within eps of each other. ``boxes`` are the cells' (``_boxes``).

    Boxes of the cells' parts decide: parts wholly within eps link their cells, parts farther apart do not. For cells that this leaves open,
    the points of the open parts are searched, a block at a time.
    """
    steps = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(o).cast("long").alias(n) for o, n in zip(s, "ijk", strict=True)]) for s in steps])
    cells = boxes.select(*keys, *"ijk", "node").distinct()
    beside = cells.select(*keys, F.col("node").alias("a"), F.explode(offsets).alias("o"), *"ijk").select(*keys, "a", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "ijk"])
    pairs = beside.join(cells.withColumnRenamed("node", "b"), [*keys, *"ijk"]).select("a", "b")
    ends = [f"{p}{e}" for p in P for e in (0, 1)]
    left = boxes.select(F.col("node").alias("a"), *[F.col(f"s{p}").alias(f"as{p}") for p in P], *[F.col(e).alias(f"q{e}") for e in ends])
    right = boxes.select(F.col("node").alias("b"), *[f"s{p}" for p in P], *ends)
    gap = [F.greatest(F.lit(0.0), F.col(f"{p}0") - F.col(f"q{p}1"), F.col(f"q{p}0") - F.col(f"{p}1")) for p in P]
    far = [F.greatest(F.col(f"{p}1") - F.col(f"q{p}0"), F.col(f"q{p}1") - F.col(f"{p}0")) for p in P]
    within = lambda d: F.sqrt(sum((x * x for x in d), F.lit(0.0))) <= eps
    near = pairs.join(left, "a").join(right, "b").where(within(gap)).withColumn("sure", within(far))
    linked = stored(near.groupBy("a", "b").agg(F.max("sure").alias("sure")))
    open_pairs = linked.where("not sure").select("a", "b")
    found = linked.where("sure").select("a", "b")
    if open_pairs.isEmpty():
        return found
    asked = stored(near.join(open_pairs, ["a", "b"]).select("a", "b", *[f"as{p}" for p in P], *[f"s{p}" for p in P]))
    part = {f"s{p}": F.floor((F.col(p) / side - F.floor(F.col(p) / side)) * CUT) for p in P}
    cell = {c: F.floor(F.col(p) / side).cast("long") for c, p in zip("ijk", P, strict=True)}
    placed = core.withColumns({**cell, **part}).join(cells, [*keys, *"ijk"])
    sides = {}
    for n, columns in (("a", [f"as{p}" for p in P]), ("b", [f"s{p}" for p in P])):
        wanted = asked.select(F.col(n).alias("node"), *[F.col(c).alias(f"s{p}") for c, p in zip(columns, P, strict=True)]).distinct()
        sides[n] = blocks.packed(placed.join(wanted, ["node", *[f"s{p}" for p in P]]), side, "node")
    met = pairs_of_blocks(sides["a"], sides["b"], open_pairs, eps)
    return found.unionByName(met)


def pairs_of_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that have points within eps, by comparing their blocks whose boxes are near enough."""
    ends = [f"{p}{e}" for p in P for e in (0, 1)]
    a = left.select(F.col("node").alias("a"), *[F.col(e).alias(f"q{e}") for e in ends], *[F.col(f"{p}s").alias(f"q{p}s") for p in P])
    b = right.select(F.col("node").alias("b"), *ends, *["xs", "ys", "zs"])
    gap = [F.greatest(F.lit(0.0), F.col(f"{p}0") - F.col(f"q{p}1"), F.col(f"q{p}0") - F.col(f"{p}1")) for p in P]
    met = pairs.join(a, "a").join(b, "b").withColumn("gap", F.sqrt(sum((x * x for x in gap), F.lit(0.0)))).where(F.col("gap") <= eps)

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(2, 8)]
            offsets = [c.offsets.to_numpy() for c in columns]
            flat = [c.values.to_numpy() for c in columns]
            found = set()
            for i, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if pair not in found:
                    xyz = [f[o[i] : o[i + 1]] for f, o in zip(flat, offsets, strict=True)]
                    if blocks.distances(xyz[:3], xyz[3:]).min() <= eps:
                        found.add(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], batch.column(j).type) for j in (0, 1)], ["a", "b"])

    kinds = [pairs.schema[c].dataType.simpleString() for c in "ab"]
    rows = met.select("a", "b", *[f"q{p}s" for p in P], *["xs", "ys", "zs"]).mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}")
    return rows.distinct()


def _cube(eps: float) -> list[Column]:
    """Cube of side eps (a trace more) that a point lies in: points within eps lie in cubes that touch."""
    return [F.floor(F.col(p) / (eps * (1 + 1e-9))).cast("long").alias(f"_q{p}") for p in P]


def _touching(cubes: DataFrame) -> DataFrame:
    """``cubes``, each at its own place and at the 26 around it."""
    for p in P:
        cubes = cubes.withColumn(f"_q{p}", F.explode(F.array(*[F.col(f"_q{p}") + i for i in (-1, 0, 1)])))
    return cubes


def _beside(points: DataFrame, asking: DataFrame, eps: float, *keys: str) -> DataFrame:
    """Those of the points whose cubes touch one of ``asking``, so all within eps of it; all points where that would list more cubes than points."""
    cubes = stored(asking.where(blocks.finite()).select(*keys, *_cube(eps)).distinct())
    if 27 * cubes.count() > points.count():
        return points
    near = stored(_touching(cubes).distinct())
    return points.select("*", *_cube(eps)).join(near, [*keys, *[f"_q{p}" for p in P]], "left_semi").select(*points.columns)


def _crowded(points: DataFrame, eps: float, least: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(points that may be in a cluster, cubes of those that may be core): no point has more neighbours within eps than the cubes that touch its own have points.
    Where cubes are so sparse that their sums would be more rows than points, nothing is ruled out and the cubes are all."""
    cubes = stored(points.where(blocks.finite()).groupBy(*keys, *_cube(eps)).agg(F.count("*").alias("_n")))
    names = [*keys, *[f"_q{p}" for p in P]]
    if 27 * cubes.count() > points.count():
        return points, cubes.select(names)
    sums = _touching(cubes).groupBy(names).agg(F.sum("_n").alias("_most")).where(F.col("_most") >= least)
    able = stored(cubes.select(names).join(sums.select(names), names, "left_semi"))
    near = stored(_touching(able).distinct())
    return points.select("*", *_cube(eps)).join(near, names, "left_semi").select(*points.columns), able


def clustered(points: DataFrame, eps: float, least: int, *keys: str) -> DataFrame | None:
    """keys, point_id, x, y, z, cluster of the points of ``density_clusters`` that are in a cluster; None if no point has enough around it.

    Cells of side eps / sqrt(3) hold only neighbours (Gunawan, 2013): all points of a cell with ``least`` are core, only the others' are counted. Core cells
    are linked instead of points, and only points that are no core look for the nearest that is. No pair of points is written. Points in places that are
    too thin for a core point, by the sums of touching cubes, are not moved, and of the others only those that a search can meet.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    columns = [*keys, "point_id", *P]
    rows, able = _crowded(points.select(columns), eps, least, *keys)
    if able.isEmpty():
        return None
    names, cell = [*keys, *"ijk"], {c: F.floor(F.col(p) / side).cast("long") for c, p in zip("ijk", P, strict=True)}
    rows = stored(rows)
    placed = rows.withColumns(cell)
    full = placed.groupBy(names).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).where(" and ".join(f"{c} is not null" for c in "ijk"))
    full = stored(full.select(names))
    dense = placed.join(full, names, "left_semi").select(columns)
    sparse = stored(placed.join(full, names, "left_anti").select(columns))
    asking = sparse.select("*", *_cube(eps)).join(able, [*keys, *[f"_q{p}" for p in P]], "left_semi").select(columns)
    core, rest = dense, sparse
    if not asking.isEmpty():
        cloud, asked = (blocks.packed(x, blocks.WIDE * eps, *keys) for x in (_beside(rows, asking, eps, *keys), asking))
        counted = blocks.search(asked, cloud, blocks.Counts, eps, *keys, enough=least)
        more = stored(counted.where(F.col("neighbours") >= least).select("point_id"))
        core, rest = dense.unionByName(sparse.join(more, "point_id", "left_semi")), stored(sparse.join(more, "point_id", "left_anti"))
    boxes = stored(_boxes(core, side, *keys))
    cells = boxes.select(*names, "node").distinct()
    named = stored(cells.join(labels(cells.select("node"), cell_links(core, boxes, side, eps, *keys)), "node").select(*names, F.col("label").alias("cluster")))
    found = core.withColumns(cell).join(named, names).select(*columns, "cluster")
    if rest.isEmpty():
        return found
    targets = blocks.packed(_beside(core, rest, eps, *keys), blocks.WIDE * eps, *keys)
    border = stored(blocks.search(blocks.packed(rest, blocks.WIDE * eps, *keys), targets, blocks.Neighbours, eps, *keys, k=1).select("point_id", "target_id"))
    joined = stored(border.join(found.select(F.col("point_id").alias("target_id"), "cluster"), "target_id").select("point_id", "cluster"))
    return found.unionByName(rest.join(joined, "point_id").select(*columns, "cluster"))


def density_clusters(points: DataFrame, eps: float, least: int, *keys: str) -> DataFrame:
    """(point_id, cluster): density clusters within each group of the keys; point_ids are unique over all groups (Ester et al., 1996). A core point has ``least`` points within eps, itself
    included; clusters are named by their least core point; a border point joins its nearest core point (ties by id); noise has -1. See ``clustered``.
    """
    found = clustered(points, eps, least, *keys)
    if found is None:
        return points.select("point_id", F.lit(-1).cast(points.schema["point_id"].dataType).alias("cluster"))
    return points.select("point_id").join(found.select("point_id", "cluster"), "point_id", "left").select("point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
