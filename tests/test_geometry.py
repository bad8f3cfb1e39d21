import random
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import index, joins, linear


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_projection_round_trips(spark):
    x, y = geo.to_plane(F.lit(-69.0), F.lit(-29.2), -29.1)
    assert one(spark, *geo.from_plane(x, y, -29.1)) == pytest.approx((-69.0, -29.2))
    for lon, lat in [(-69.3, -28.9), (-70.9, -31.0), (-67.0, -0.5)]:
        e, n = geo.to_utm(F.lit(lon), F.lit(lat), 19, True)
        assert one(spark, *geo.from_utm(e, n, 19, True)) == pytest.approx((lon, lat), abs=1e-8)


def test_utm_on_the_central_meridian(spark):
    e, n = one(spark, *geo.to_utm(F.lit(-69.0), F.lit(0.0), 19, False))
    assert (e, n) == pytest.approx((500_000.0, 0.0), abs=1e-6)
    # The quarter meridian of WGS84 is 10 001 965.729 m.
    assert one(spark, geo.to_utm(F.lit(-69.0), F.lit(89.9999999), 19, False)[1])[0] / 0.9996 == pytest.approx(10_001_965.729, abs=0.05)


def test_distances(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)))[0] == pytest.approx(geo.EARTH_M * math.pi / 2)
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, geo.point_segment_distance(*lit(3, 4, 0, 0, 0, 0)))[0] == 5
    assert one(spark, geo.point_segment_distance(*lit(1, 2, 0, 0, 4, 0)))[0] == 2
    assert one(spark, geo.segments_distance(lit(0, 0, 2, 2), lit(0, 2, 2, 0)))[0] == 0
    assert one(spark, geo.segments_distance(lit(0, 0, 1, 0), lit(0, 3, 1, 3)))[0] == 3
    assert one(spark, geo.close_to(F.lit(1.0), F.lit(1.000005)), geo.node_key(F.lit(1.23456))) == (True, 1235)


L_SHAPE = [("l", 0, 0.0, 0.0), ("l", 1, 3.0, 0.0), ("l", 2, 3.0, 0.0), ("l", 3, 3.0, 4.0)]


def pieces_of(spark):
    return linear.measured(linear.edges(spark.createDataFrame(L_SHAPE, "line string, seq int, x double, y double")))


def test_along_a_polyline(spark):
    vertices = spark.createDataFrame(L_SHAPE, "line string, seq int, x double, y double")
    assert linear.without_repeats(vertices).count() == 3
    pieces = pieces_of(spark)
    assert sorted((r.seq, r.s0, r.s1) for r in pieces.collect()) == [(0, 0.0, 3.0), (2, 3.0, 7.0)]
    wanted = spark.createDataFrame([("l", s) for s in (-1.0, 0.0, 3.0, 5.0, 9.0)], "line string, s double")
    assert {r.s: (r.x, r.y) for r in linear.points_at(pieces, wanted).collect()} == {-1.0: (0, 0), 0.0: (0, 0), 3.0: (3, 0), 5.0: (3, 2), 9.0: (3, 4)}
    middle = linear.midpoints(pieces).first()
    assert (middle.x, middle.y) == (3.0, 0.5)
    spans = spark.createDataFrame([("a", "l", 2.0, 4.5)], 'span string, line string, `from` double, `to` double')
    assert [(r.seq, r.s) for r in linear.cut(pieces, spans, 1.0).orderBy("seq").collect()] == [(0, 2.0), (1, 3.0), (2, 4.0), (3, 4.5)]


def test_slopes_and_anchor_order(spark):
    samples = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, None), ("a", 100.0, 15.0), ("a", 110.0, 99.0), ("a", 200.0, 5.0)], "seg string, s double, z double")
    r = linear.slope_summary(samples, "seg", "s", "z", 20.0).first()
    assert (r.first, r.last, r.net_pct, r.n) == (10.0, 5.0, -2.5, 4)
    assert r.max_abs_pct == pytest.approx(100 * 94 / 90) and r.mean_abs_pct == pytest.approx((5 + 100 * 94 / 90) / 2)
    anchors = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 1.5)], "km double, s double")
    assert linear.broken_order(anchors, "km", "s").count() == 1


def test_joins_guard_their_keys(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    with pytest.raises(joins.KeyViolation, match="repeats"):
        joins.one_to_one(a, a.selectExpr("1 AS k", "v AS w"), ["k"])
    with pytest.raises(joins.KeyViolation, match="both sides"):
        joins.one_to_one(a, a, ["k"])
    assert joins.star(a, [a.selectExpr("k", "v AS w"), a.selectExpr("k + 1 AS k", "v AS u")], ["k"]).count() == 2


def test_nearest_on_earth_against_all_pairs(spark):
    """Clusters, far points, both sides of 180 degrees and the poles."""
    rng = random.Random(3)
    at = lambda: (rng.choice([rng.uniform(-180, 180), rng.gauss(10, 0.1), 179.99, -179.99]), rng.choice([rng.uniform(-90, 90), rng.gauss(50, 0.1), 89.9]))
    points, targets = [(i, *at()) for i in range(150)], [(i, *at()) for i in range(80)]
    a, b = spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(targets, "t int, tx double, ty double")
    way = F.round(geo.haversine(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")), 4)
    want = {r.k: (r.d.d, r.d.t) for r in a.crossJoin(b).groupBy("k").agg(F.min(F.struct(way.alias("d"), "t")).alias("d")).collect()}
    got = {r.k: (r.distance, r.t) for r in joins.nearest_on_earth(a, b, way, "k", "t", ("x", "y"), ("tx", "ty")).collect()}
    assert got == want
    assert joins.nearest_on_earth(a, b.limit(0), way, "k", "t", ("x", "y"), ("tx", "ty")).collect() == []


@pytest.mark.parametrize("width", [1, 3, 50])
def test_overlap_is_half_open_whatever_the_bins(spark, width):
    a = spark.createDataFrame([(0, 1), (1, 4), (4, 4), (3, 9)], "a int, b int")
    h = spark.createDataFrame([(1, 2), (4, 9), (8, 30), (5, 5), (0, 40)], "c int, d int")
    binned = joins.overlap_binned(a, h, ("a", "b"), ("c", "d"), width).collect()
    want = [(x.a, x.b, y.c, y.d) for x in a.collect() for y in h.collect() if y.c < x.b and y.d > x.a and x.a < x.b and y.c < y.d]
    assert sorted(map(tuple, binned)) == sorted(want)


@pytest.mark.parametrize("width", [1, 3, 50])
def test_empty_intervals_meet_those_around_them(spark, width):
    a = spark.createDataFrame([(0, 1), (1, 4), (4, 4), (3, 9), (6, 5), (None, 2)], "a int, b int")
    h = a.toDF("c", "d")
    binned = joins.overlap_binned(a, h, ("a", "b"), ("c", "d"), width, empty=True).collect()
    plain = joins.overlap_theta(a, h, ("a", "b"), ("c", "d")).collect()
    assert (4, 4, 3, 9) in map(tuple, plain) and sorted(map(tuple, binned)) == sorted(map(tuple, plain))


def test_lines_and_points_within(spark):
    edges = spark.createDataFrame([("x", 0.0, 0.0, 10.0, 0.0), ("y", 0.0, 5.0, 10.0, 5.0)], "line string, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 2.5), (3, 20.0, 0.0)], "p int, px double, py double")
    assert sorted(map(tuple, joins.within_of_lines(points, edges, 2.5, "p", "line").collect())) == [(1, "x", 1.0), (2, "x", 2.5), (2, "y", 2.5)]
    other = edges.withColumnRenamed("line", "other")
    assert joins.lines_within(edges, other, 4.9, "line", "other").count() == 2
    assert joins.lines_within(edges, other, 5.0, "line", "other").count() == 4


def test_a_point_off_the_line_stops_the_run(spark):
    edges = spark.createDataFrame([("e", 0.0, 0.0, 10.0, 0.0), ("f", 0.0, 5.0, 10.0, 5.0)], "edge string, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 3.0, 1.0), (2, 4.0, 2.5), (3, 4.0, 90.0)], "k int, px double, py double")
    told = {r.k: (r.edge, r.distance, r.too_far) for r in joins.nearest_edge(points, edges, 3.0, "k", "edge").collect()}
    assert told == {1: ("e", 1.0, False), 2: ("e", 2.5, False), 3: (None, None, True)}
    assert {r.k: r.edge for r in joins.snapped(points.where("k < 3"), edges, 3.0, "k", "edge").collect()} == {1: "e", 2: "e"}
    with pytest.raises(joins.TooFar, match="3"):
        joins.snapped(points, edges, 3.0, "k", "edge")


def test_segment_names_refuse_other_spans(spark):
    rows = spark.createDataFrame([(0, 1), (129, 130), (1000, 1001), (None, 3)], "a int, b int").select(text.segment_id(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in rows.collect()] == ["seg_000_001", "seg_129_130", "seg_1000_1001", None]
    for a, b in ((-1, 0), (3, 5), (4, 4)):
        with pytest.raises(Exception, match="not one kilometre"):
            spark.createDataFrame([(a, b)], "a int, b int").select(text.segment_id(F.col("a"), F.col("b"))).collect()


def test_unknown_percentiles_are_no_drivers(spark):
    rows = [(1, 3.0, 9.0, 5.0), (2, None, 4.0, None), (3, None, None, None), (4, float("nan"), 1.0, 1.0)]
    found = spark.createDataFrame(rows, "k int, a double, b double, c double").select("k", index.top_drivers(["a", "b", "c"]).alias("d")).collect()
    assert {r.k: [(d.name, d.value) for d in r.d] for r in found} == {1: [("b", 9.0), ("c", 5.0)], 2: [("b", 4.0)], 3: [], 4: [("c", 1.0), ("b", 1.0)]}


def test_long_edges_meet_what_they_pass(spark):
    """Edges of many cells, at every slope, against all pairs: points and other edges within the reach."""
    rng = random.Random(12)
    edge = lambda k, size: (k, *(rng.uniform(-size, size) for _ in range(2)), *(rng.choice([0.0, rng.uniform(-size, size)]) for _ in range(2)))
    edges = [edge(k, 50) for k in range(40)] + [(90, -40.0, 3.0, 40.0, 3.0), (91, 7.0, -30.0, 7.0, 30.0), (92, 1.0, 1.0, 1.0, 1.0)]
    points = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(150)]

    def distance(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = min(1, max(0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    there = spark.createDataFrame(edges, "line int, ax double, ay double, bx double, by double")
    found = joins.within_of_lines(spark.createDataFrame(points, "k int, px double, py double"), there, 1.5, "k", "line")
    assert {(r.k, r.line) for r in found.collect()} == {(k, e[0]) for k, x, y in points for e in edges if distance(x, y, *e[1:]) <= 1.5}

    def apart(a, b):
        cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        p, q, r, s = a[:2], a[2:], b[:2], b[2:]
        if cross(p, q, r) * cross(p, q, s) < 0 and cross(r, s, p) * cross(r, s, q) < 0:
            return 0.0
        return min(distance(*p, *b), distance(*q, *b), distance(*r, *a), distance(*s, *a))

    pairs = joins.lines_within(there, there.withColumnRenamed("line", "other"), 0.7, "line", "other", 2.0)
    assert {(r.line, r.other) for r in pairs.collect()} == {(a[0], b[0]) for a in edges for b in edges if apart(a[1:], b[1:]) <= 0.7}
    cells = joins._along(there.where("line = 90"), 0.5, 1.0)
    assert cells.count() < 2 * 3 * 85


def test_intervals_in_a_fine_unit_take_few_bins(spark):
    wide = spark.createDataFrame([(k, k * 10**9, k * 10**9 + 5 * 10**8) for k in range(20)], "k int, a long, b long")
    other = wide.select(F.col("k").alias("m"), (F.col("a") + 10**8).alias("c"), (F.col("b") + 10**9).alias("d"))
    assert joins.overlap_binned(wide, other, ("a", "b"), ("c", "d")).count() == 39


def test_lines_that_only_touch_do_not_cross(spark):
    """Lines that meet in an end or run in one another are none; copies of a line cross what it crosses, and each other where it crosses itself."""
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 4.0, 4.0, 0.0), (3, 4.0, 4.0, 8.0, 4.0), (4, 1.0, 1.0, 3.0, 3.0), (5, 0.0, 4.0, 4.0, 0.0)]
    loop = [(0.0, 9.0, 4.0, 9.0), (4.0, 9.0, 4.0, 11.0), (4.0, 11.0, 2.0, 8.0)]
    edges = spark.createDataFrame([*rows, *((k, *e) for k in (7, 8) for e in loop)], "line int, ax double, ay double, bx double, by double")
    assert sorted(map(tuple, joins.lines_crossing(edges, "line", 1.0).collect())) == [(1, 2), (1, 5), (2, 4), (4, 5), (7, 8)]


def test_lines_that_are_alike_meet_points_once(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("line"), F.lit(0.0).alias("ax"), (F.col("id") % 2 * 1.0).alias("ay"), F.lit(9.0).alias("bx"), (F.col("id") % 2 * 1.0).alias("by"))
    firsts, lines = joins.alike_lines(edges.union(edges), "line")
    assert sorted(r.line for r in firsts.collect()) == [1, 2]
    assert {(r.line, r["__like"]) for r in lines.collect()} == {(k, 2 - k % 2) for k in range(1, 201)}
    points = spark.createDataFrame([(1, 3.0, 0.25), (2, 5.0, 7.0)], "p int, px double, py double")
    near = joins.within_of_lines(points, edges, 0.5, "p", "line").collect()
    assert sorted(map(tuple, near)) == [(1, k, 0.25) for k in range(1, 201, 2)]
    assert joins.nearest_edge(points, edges, 0.5, "p", "line").where("p = 1").first().line == 1


def test_targets_at_one_place_are_no_hot_cell(spark):
    there = spark.range(300).select(F.col("id").alias("t"), (F.col("id") % 3 * 1.0).alias("tx"), F.lit(0.0).alias("ty"))
    assert sorted(map(tuple, joins._least_alike(there.union(there), "t", 2).select("t").collect())) == [(0,), (1,), (2,), (3,), (4,), (5,)]
    points = there.toDF("p", "x", "y")
    way = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    asked = (points, there, 1.0, way, "p", "t")
    at = ((F.col("x"), F.col("y")), (F.col("tx"), F.col("ty")))
    assert {r.p: r.t for r in joins.nearest_within(*asked, F.col("p") == F.col("t"), *at).collect()} == {p: p % 3 if p > 2 else p + 3 for p in range(300)}
    strict = {r.p: (r.t, r.distance) for r in joins.nearest_within(*asked, F.col("p") == F.col("t"), *at, strict=True).collect()}
    assert strict == {p: ((1, 0, 1)[p % 3], 1.0) for p in range(300)}
