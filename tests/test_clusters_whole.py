import math

from plumbline.operators import components
from plumbline.plans import queries, scene

SF = "/root/testdata/sf0.001"


def test_every_surface_is_clustered(spark):
    p = [(r.facade_id, r.point_id, r.x, r.y, r.z) for r in scene.points(spark, SF).collect()]
    got = [(r.point_id, r.cluster) for r in queries.dbscan_clusters(spark, SF).collect()]
    assert sorted(x[0] for x in got) == sorted(x[1] for x in p)
    clusters = dict(got)
    for f in range(4):
        own = [x for x in p if x[0] == f]
        core = {a[1]: [b[1] for b in own if math.dist(a[2:], b[2:]) <= 0.3] for a in own}
        core = {k: near for k, near in core.items() if len(near) >= 4}
        todo, label = set(core), {}
        while todo:
            first = min(todo)
            reach, todo = [first], todo - {first}
            for k in reach:
                label[k] = first
                more = todo.intersection(core[k])
                reach += more
                todo -= more
        assert {k: clusters[k] for k in core} == label
        assert all((clusters[a[1]] == -1) == (a[1] not in {n for near in core.values() for n in near}) for a in own)


def test_surfaces_do_not_share_clusters(spark):
    rows = [(f, 10 * f + i, 0.1 * i, 0.0, 0.0) for f in range(2) for i in range(4)]
    points = spark.createDataFrame(rows, "facade_id int, point_id long, x double, y double, z double")
    got = {r.point_id: r.cluster for r in components.density_clusters(points, 0.15, 3, "facade_id").collect()}
    assert got == {10 * f + i: 10 * f + 1 for f in range(2) for i in range(4)}
