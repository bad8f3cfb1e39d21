import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, grid, routing


def cells_of(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "row int, col int, value double")


def table(frame, value="value"):
    return {(r.row, r.col): r[value] for r in frame.collect()}


def test_plane_has_constant_slope(spark):
    plane = cells_of(spark, [[3.0 * c + 4.0 * r for c in range(6)] for r in range(6)])
    assert set(round(v, 9) for v in table(grid.slope_percent(plane, 10.0, 10.0)).values()) == {50.0}
    hole = plane.withColumn("value", F.when(~((F.col("row") == 2) & (F.col("col") == 2)), F.col("value")))
    assert table(grid.slope_percent(hole, 10.0, 10.0))[2, 1] is None


def test_cone_drains_to_its_foot(spark):
    cone = cells_of(spark, [[10.0 - max(abs(r - 3), abs(c - 3)) for c in range(7)] for r in range(7)])
    ways = grid.d8_direction(cone)
    assert table(ways, "direction")[0, 3] == 0 and table(ways, "direction")[2, 3] == 64
    acc = table(grid.flow_accumulation(ways), "acc")
    assert sum(acc[p] for p, d in table(ways, "direction").items() if d == 0) == 49


def flooded(cells):
    level = {p: float("inf") for p in cells}
    queue = []
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for r, c in cells:
        if any((r + a, c + b) not in cells for a, b in around):
            level[r, c] = cells[r, c]
            heapq.heappush(queue, (cells[r, c], r, c))
    while queue:
        at, r, c = heapq.heappop(queue)
        for a, b in around:
            p = (r + a, c + b)
            if p in cells and max(cells[p], at) < level[p]:
                level[p] = max(cells[p], at)
                heapq.heappush(queue, (level[p], *p))
    return level


@pytest.mark.parametrize("block", [64, 5])
def test_depressions_are_filled_to_their_sill(spark, block):
    rng = random.Random(block)
    rows = [[None if rng.random() < 0.03 else float(rng.randrange(9)) for _ in range(16)] for _ in range(14)]
    got = table(grid.fill_depressions(cells_of(spark, rows), block))
    assert got == flooded({(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None})


def test_streams_become_lines(spark):
    valley = cells_of(spark, [[abs(c - 2) * 10.0 - r + 20 for c in range(5)] for r in range(6)])
    ways = grid.d8_direction(valley)
    links = grid.streams(grid.flow_accumulation(ways), ways, 6)
    lines = grid.stream_lines(links)
    assert lines.count() == links.count() and lines.select("line").distinct().count() == links.where("head").count()
    for _, own in itertools.groupby(sorted(lines.collect(), key=lambda r: (r.line, r.seq)), key=lambda r: r.line):
        own = list(own)
        assert [r.seq for r in own] == list(range(len(own))) and own[0].line == f"{own[0].row}_{own[0].col}"
        assert all((a.to_row, a.to_col) == (b.row, b.col) for a, b in zip(own, own[1:], strict=False))


def test_mosaic_mask_sample_and_completeness(spark):
    a, b = cells_of(spark, [[1.0, None]]), cells_of(spark, [[7.0, 8.0]])
    assert table(grid.mosaic([a, b])) == {(0, 0): 1.0, (0, 1): 8.0}
    assert table(grid.masked(cells_of(spark, [[-9999.0, float("nan"), 2.0]]), -9999.0)) == {(0, 0): None, (0, 1): None, (0, 2): 2.0}
    points = spark.createDataFrame([(1, 15.0, 95.0), (2, 500.0, 0.0)], "p int, x double, y double")
    got = {r.p: r.value for r in grid.sampled(points, b, F.col("x"), F.col("y"), 0.0, 100.0, 10.0).collect()}
    assert got == {1: 8.0, 2: None}
    assert grid.complete(b).first().whole and not grid.complete(a).first().whole


def test_reprojection_is_exact_on_a_plane(spark):
    source = cells_of(spark, [[2.0 * c - 3.0 * r for c in range(9)] for r in range(9)])
    target = spark.range(9).selectExpr("int(id / 3) AS row", "int(id % 3) AS col")
    found = table(grid.reprojected(target, source, lambda x, y: (x / 10 + 1, -y / 10 + 1), (0.0, 0.0), 5.0, (0.0, 0.0), (1.0, 1.0)))
    for (r, c), v in found.items():
        assert v == pytest.approx(2.0 * ((c + 0.5) / 2 + 1) - 3.0 * ((r + 0.5) / 2 + 1))
    away = grid.reprojected(target, source, lambda x, y: (x + 100, y), (0.0, 0.0), 5.0, (0.0, 0.0), (1.0, 1.0))
    assert set(table(away).values()) == {None}


LATTICE = [((r, c), (r + a, c + b)) for r in range(3) for c in range(3) for a, b in ((0, 1), (1, 0)) if r + a < 3 and c + b < 3]


def lattice(spark):
    both = [(*x, *y) for a, b in LATTICE for x, y in ((a, b), (b, a))]
    return spark.createDataFrame([(10 * a + b, 10 * c + d, 1.0 + (a + b + c + d) % 2 + 0.25 * (a * d)) for a, b, c, d in both] + [(77, 78, 1.0)], "src int, dst int, w double")


def test_paths_on_a_lattice(spark):
    edges = lattice(spark)
    ways = {}
    for r in edges.collect():
        ways.setdefault(r.src, []).append((r.dst, r.w))
    best, queue = {0: 0.0}, [(0.0, 0)]
    while queue:
        at, n = heapq.heappop(queue)
        for m, w in ways.get(n, []):
            if at + w < best.get(m, 1e9):
                best[m] = at + w
                heapq.heappush(queue, (at + w, m))
    costs = graph.shortest_costs(edges, 0)
    assert {r.node: r.cost for r in costs.collect()} == pytest.approx(best)
    asked = spark.createDataFrame([(0, 0, 2), (1, 2, 22), (2, 0, 78)], "leg int, start long, end long")
    legs = {}
    for r in routing.routed(edges, asked).orderBy("leg", "seq").collect():
        legs.setdefault(r.leg, []).append(r.node)
    assert set(legs) == {0, 1} and legs[0][0] == 0 and legs[0][-1] == 2 and legs[1][0] == 2 and legs[1][-1] == 22
    line = [r.node for r in routing.joined_route(edges, asked.where("leg < 2")).orderBy("leg", "seq").collect()]
    assert line == legs[0] + legs[1][1:] and sum(dict(ways[a])[b] for a, b in zip(line, line[1:], strict=False)) >= best[22]
    with pytest.raises(routing.NoRoute, match="2"):
        routing.joined_route(edges, asked)
    assert {r.node: r.hops for r in graph.reached(edges, 0).collect()}[22] == 4


def test_split_and_closing(spark):
    edges = spark.createDataFrame([("e", 0.0, 0.0, 10.0, 0.0)], "edge string, ax double, ay double, bx double, by double")
    cut = graph.split_at(edges, spark.createDataFrame([("e", 0.5), ("e", 0.2), ("e", 0.2), ("e", 1.0)], "edge string, t double"))
    assert [(r.ax, r.bx) for r in cut.orderBy("t0").collect()] == [(0.0, 2.0), (2.0, 5.0), (5.0, 10.0)]
    near = spark.createDataFrame([(1, 2, 15.0), (2, 1, 15.0), (3, 1, 19.0)], "a int, b int, distance double")
    assert sorted(map(tuple, graph.closing_edges(near, "a", "b").collect())) == [(1, 2, 15.0), (1, 3, 19.0)]


def test_neighbour_graph_invariants(spark):
    segments = spark.range(130).selectExpr("int(id) AS km_inicio", "int(id + 1) AS km_fin")
    found = graph.linear_neighbours(segments)
    edges = found.selectExpr("km_inicio AS src", "neighbor_km_inicio AS dst")
    assert found.count() == 258 and len(found.columns) == 9
    assert {r.rule: r.n for r in graph.violations(edges).collect()} == {"self_loop": 0, "duplicate": 0, "no_reciprocal": 0}
    assert sorted(r.degree for r in graph.degrees(edges).collect()) == [1, 1] + [2] * 128
    assert graph.reached(edges.where("src < 12"), 0).count() == 13
