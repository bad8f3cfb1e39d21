"""Order along lines that are cut into many slices, against one machine."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import joins, linear, ordered


@pytest.fixture
def many_slices(spark):
    """Thirteen slices, however small the table is."""
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def vertices(spark, sizes, seed=1):
    rng, rows = random.Random(seed), []
    for name, n in sizes.items():
        x = y = 0.0
        for k in range(n):
            rows.append((name, 3 * k, x, y))
            if rng.random() > 0.1:  # else a repeated vertex
                x, y = x + rng.choice([0.001, 1.0, 30.0]), y + rng.uniform(-1, 1)
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "line string, seq int, x double, y double")


def chains(rows):
    out = {}
    for line, seq, x, y in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(line, []).append((seq, x, y))
    return out


SIZES = {"long": 1500, "a": 1, "b": 2, "c": 40, None: 3}


def test_edges_and_chainage(spark, many_slices):
    rows, frame = vertices(spark, SIZES)
    found = {}
    for r in linear.measured(linear.edges(frame)).collect():
        found.setdefault(r.line, {})[r.seq] = r
    for line, own in chains(rows).items():
        s = 0.0
        for (seq, ax, ay), (_, bx, by) in zip(own, own[1:], strict=False):
            if (ax, ay) == (bx, by):
                assert seq not in found.get(line, {})
                continue
            r, length = found[line][seq], np.hypot(bx - ax, by - ay)
            assert (r.ax, r.ay, r.bx, r.by) == (ax, ay, bx, by) and (r.s0, r.s1) == pytest.approx((s, s + length))
            s += length
    kept = chains(map(tuple, linear.without_repeats(frame).collect()))
    assert kept == {line: [p for k, p in enumerate(own) if not k or p[1:] != own[k - 1][1:]] for line, own in chains(rows).items()}


def test_points_along_lines(spark, many_slices):
    rows, frame = vertices(spark, {"long": 1500, "c": 40, "b": 2})
    pieces = linear.measured(linear.edges(frame))
    told = {}
    for r in pieces.orderBy("line", "s1").collect():
        told.setdefault(r.line, []).append(r)
    rng = random.Random(2)
    asked = [(line, rng.choice([-1.0, 0.0, 1e9, rng.uniform(0, own[-1].s1), rng.choice(own).s1])) for line, own in told.items() for _ in range(60)] + [("gone", 1.0)]
    found = linear.points_at(pieces, spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "k int, line string, s double")).collect()
    assert len(found) == len(asked) - 1
    for r in found:
        own = told[r.line]
        s = min(max(r.s, 0.0), own[-1].s1)
        e = own[bisect.bisect_left([x.s1 for x in own], s)]
        t = (s - e.s0) / (e.s1 - e.s0)
        assert (r.x, r.y) == pytest.approx((e.ax + t * (e.bx - e.ax), e.ay + t * (e.by - e.ay)))


def test_no_task_holds_a_long_line(spark):
    """One line of 2 million vertices: every slice has its share of the rows, and all orders follow the slices."""
    n, parts = 2_000_000, 40
    frame = spark.range(n).select(F.lit("one").alias("line"), F.col("id").alias("seq"), F.lit(1.0).alias("length"))
    rows = ordered.sliced(frame, "line", "seq", parts=parts)
    sizes = [r["count"] for r in rows.groupBy(ordered.SLICE).count().collect()]
    assert sum(sizes) == n and max(sizes) < 2 * n / parts
    summed = ordered.with_running_sum(rows, "line", "seq", "length", "s")
    assert summed.where("s <> seq + 1").isEmpty()
    assert ordered.with_next(rows, "line", "seq", ["seq"], "n").where("n.seq <> seq + 1 OR (n IS NULL AND seq < 1999999)").isEmpty()


def test_interpolation_over_many_anchors(spark, many_slices):
    rng = random.Random(3)
    xs = sorted(rng.sample(range(10_000), 300))
    anchors = [(float(x), rng.uniform(-5, 5)) for x in xs]
    points = [(float(rng.choice([xs[0], xs[-1], xs[7], rng.uniform(xs[0], xs[-1])])),) for _ in range(200)]
    asked = spark.createDataFrame([*points, (-1.0,), (20_000.0,), (None,)], "at double")
    there = spark.createDataFrame([*anchors, (None, 1.0)], "k double, v double")
    found = joins.interpolate(asked, there, "at", "k", "v", "out").collect()
    assert len(found) == len(points)
    assert [r.out for r in found] == pytest.approx(np.interp([r["at"] for r in found], *zip(*anchors, strict=True)).tolist())
    with pytest.raises(joins.OutOfBounds, match="20000"):
        joins.interpolate(asked.where("at > 0"), there, "at", "k", "v", "out", outside="fail")
    assert joins.interpolate(asked, there.limit(0), "at", "k", "v", "out").collect() == []


def test_no_frame_runs_to_the_end_of_a_slice(spark):
    """Spark goes over such a frame again for each row: a slice would cost the square of its rows."""
    asked = spark.range(50).select(F.lit(0).alias("line"), F.col("id").alias("k"))
    there = spark.range(0, 50, 5).select(F.lit(0).alias("line"), F.col("id").alias("m"))
    met = ordered.next_match(asked, there, "line", F.col("k"), F.col("m"), "e")
    assert "unboundedfollowing" not in met._jdf.queryExecution().analyzed().toString().lower()
    assert {r.k: r.e.m if r.e else None for r in met.collect()} == {k: -(-k // 5) * 5 if k <= 45 else None for k in range(50)}
