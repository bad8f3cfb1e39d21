"""Flats by blocks against one queue over the whole grid."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from waymark.operators import flats, grid
from waymark.operators.graph import components

STEPS = list(grid.DIRECTIONS.values())


def surface(seed, h, w):
    """Terraces, a wide basin and an odd hole: most cells are level with a neighbour."""
    rng = random.Random(seed)
    cells = {(r, c): float(rng.choice([3, 3, 3, 4, 6]) + (r // 6) + (c // 9)) for r in range(h) for c in range(w)}
    cells |= {(r, c): 1.0 for r in range(h // 4, h // 2) for c in range(w // 4, 3 * w // 4)}
    del cells[h - 4, w - 4]
    return cells


def rows(cells):
    return [(r, c, v) for (r, c), v in cells.items()]


def brute_fill(cells):
    level = {p: v if any((p[0] + a, p[1] + b) not in cells for a, b in STEPS) else float("inf") for p, v in cells.items()}
    queue = deque(p for p, v in level.items() if v < float("inf"))
    while queue:
        p = queue.popleft()
        for a, b in STEPS:
            q = (p[0] + a, p[1] + b)
            if q in cells and max(cells[q], level[p]) < level[q]:
                level[q] = max(cells[q], level[p])
                queue.append(q)
    return level


def brute_lifts(level):
    around = {p: [q for a, b in STEPS if (q := (p[0] + a, p[1] + b)) in level] for p in level}
    flat = {p for p in level if any(level[q] == level[p] for q in around[p])}
    drains = {p for p in flat if len(around[p]) < 8 or any(level[q] < level[p] for q in around[p])}

    def ways(starts):
        found, queue = dict.fromkeys(starts, 0), deque(starts)
        while queue:
            p = queue.popleft()
            for q in around[p]:
                if q in flat and level[q] == level[p] and q not in found:
                    found[q] = found[p] + 1
                    queue.append(q)
        return found

    low, away = ways(sorted(drains)), ways(sorted(p for p in flat - drains if any(level[q] > level[p] for q in around[p])))
    area: dict = {}
    for p in sorted(flat):
        if p not in area:
            area[p], queue = p, deque([p])
            while queue:
                x = queue.popleft()
                for q in around[x]:
                    if level[q] == level[x] and q not in area:
                        area[q] = p
                        queue.append(q)
    most: dict = {}
    for p in flat & set(away):
        most[area[p]] = max(most.get(area[p], 0), away[p])
    return {p: 2 * low[p] + (most[area[p]] - away[p] if p in away else 0) for p in flat}


@pytest.mark.parametrize("block", [5, 64])
def test_lifts_and_ways(spark, block):
    level = brute_fill(surface(2, 26, 33))
    filled = spark.createDataFrame(rows(level), "row int, col int, value double").repartition(3)
    lifts = {(r.row, r.col): r.lift for r in flats.flat_lifts(filled, block).collect()}
    assert lifts == brute_lifts(level)
    ways = {(r.row, r.col): r for r in flats.drained(filled, block=block).collect()}
    assert set(ways) == set(level)
    for p, r in ways.items():
        seen = {p}
        while r.direction:
            q = (r.to_row, r.to_col)
            assert q not in seen and level[q] <= level[p]
            seen.add(q)
            r = ways[q]
        assert any((r.row + a, r.col + b) not in level for a, b in STEPS)  # it ends at the edge, never inside
    acc = grid.flow_accumulation(flats.drained(filled, block=block))
    assert acc.join(spark.createDataFrame([(r.row, r.col) for r in ways.values() if not r.direction], "row int, col int"), ["row", "col"]).agg(F.sum("acc")).first()[0] == len(level)


def test_raised_surface_has_no_flat_inside(spark):
    level = brute_fill(surface(7, 18, 20))
    filled = spark.createDataFrame(rows(level), "row int, col int, value double")
    raised = {(r.row, r.col): r.value for r in flats.resolved(filled, block=7).collect()}
    assert all(v - level[p] < 0.01 for p, v in raised.items())
    for p, v in raised.items():
        around = [(p[0] + a, p[1] + b) for a, b in STEPS]
        assert any(q not in raised for q in around) or any(raised[q] < v for q in around)


def test_nothing_flat_and_no_outlet(spark):
    slope = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    assert flats.flat_lifts(slope).collect() == [] and flats.drained(slope).count() == 16
    assert flats.flat_lifts(slope.limit(0)).collect() == []
    pit = spark.createDataFrame([(r, c, 1.0 if 2 <= r <= 4 and 2 <= c <= 4 else 5.0) for r in range(7) for c in range(7)] , "row int, col int, value double")
    assert {r.lift for r in flats.flat_lifts(pit).where("value = 1").collect()} == {None}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    root: dict = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1] or x in got}


def test_filling_joins_no_cells(spark, monkeypatch):
    """Blocks see their edge cells themselves: joins of cells were sent from the driver. Holes and several blocks, against the edge by hand."""
    monkeypatch.setattr(grid, "_neighbours", None)
    value = {(r, c): float((r * 7 + c * 11) % 10) for r in range(9) for c in range(9) if (r, c) != (4, 4)}
    rows = [(r, c, v) for (r, c), v in value.items()] + [(4, 4, None)]
    level = {p: v if any((p[0] + a, p[1] + b) not in value for a in (-1, 0, 1) for b in (-1, 0, 1)) else float("inf") for p, v in value.items()}
    for _ in range(100):
        level = {p: min(level[p], *(max(value[p], level[q]) for a in (-1, 0, 1) for b in (-1, 0, 1) if (q := (p[0] + a, p[1] + b)) in level)) for p in level}
    for block in (3, 256):
        found = grid.fill_depressions(spark.createDataFrame(rows, "row int, col int, value double"), block)
        assert {(r.row, r.col): r.value for r in found.collect()} == level


def test_flats_send_no_table_of_areas_from_the_driver(spark, monkeypatch):
    """No join of areas is one that the driver broadcasts, however small Spark thinks the side is."""
    plans, cut = [], flats.cut_lineage

    def watched(frame):
        done = cut(frame)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())  # as it was run, not as it was begun
        return done

    monkeypatch.setattr(flats, "cut_lineage", watched)
    cells = spark.range(400).selectExpr("int(id div 20) AS row", "int(id % 20) AS col", "double(id div 100) AS value")
    assert flats.flat_lifts(cells, 5).count() == 400
    assert not any("BroadcastHashJoin" in p for p in plans)
