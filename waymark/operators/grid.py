"""Raster cells as rows (row, col, value); no data is null.

Neighbourhoods are equi joins on shifted indices or windows along rows and columns, so a grid of any
size is dealt by cell. Accumulation doubles pointers and depression filling floods blocks, in written rounds.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import close_to
from waymark.operators.joins import bilinear
from waymark.operators.quantiles import summarised
from waymark.session import cut_lineage

#: Codes of the eight directions, clockwise from north, with their steps in rows and columns.
DIRECTIONS = {64: (-1, 0), 128: (-1, 1), 1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1)}


def masked(cells: DataFrame, nodata: float) -> DataFrame:
    """Values close to ``nodata``, and NaN, as null."""
    v = F.col("value")
    return cells.withColumn("value", F.when(~(F.isnan(v) | close_to(v, F.lit(nodata))), v))


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """The first tile that has a value for a cell gives it."""
    named = [t.select("row", "col", "value", F.lit(k).alias("__tile")) for k, t in enumerate(tiles)]
    whole = reduce(DataFrame.unionByName, named).where("value IS NOT NULL")
    return whole.groupBy("row", "col").agg(F.min_by("value", "__tile").alias("value"))


def slope_percent(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Slope from central differences inside and one-sided ones at the edges; null where a value that it takes is null."""

    def difference(along: str, across: str, size: float) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        low, high = F.lag("value").over(w), F.lead("value").over(w)
        first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
        return F.when(first, (high - F.col("value")) / size).when(last, (F.col("value") - low) / size).otherwise((high - low) / (2 * size))

    both = cells.withColumns({"__x": difference("col", "row", dx), "__y": difference("row", "col", dy)})
    return both.select("row", "col", (F.hypot("__x", "__y") * 100).alias("value"))


def _neighbours(cells: DataFrame) -> DataFrame:
    """row, col, code and n_value of each cell's neighbours that have a value."""
    steps = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(r).alias("r"), F.lit(c).alias("c")) for code, (r, c) in DIRECTIONS.items()))
    asked = cells.withColumn("__s", F.explode(steps)).select("row", "col", "value", F.col("__s.code").alias("code"), (F.col("row") + F.col("__s.r")).alias("n_row"), (F.col("col") + F.col("__s.c")).alias("n_col"))
    there = cells.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("value").alias("n_value")).where("n_value IS NOT NULL")
    return asked.where("value IS NOT NULL").join(there, ["n_row", "n_col"])


def d8_direction(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """row, col, direction and the cell downstream: the steepest way down, ties to the smaller code; 0 and nulls where no neighbour is lower."""
    way = F.when(F.col("code").isin(64, 4), dy).when(F.col("code").isin(1, 16), dx).otherwise(float((dx * dx + dy * dy) ** 0.5))
    drops = _neighbours(cells).withColumn("drop", (F.col("value") - F.col("n_value")) / way).where("drop > 0")
    best = drops.groupBy("row", "col").agg(F.min(F.struct((-F.col("drop")).alias("d"), "code", "n_row", "n_col")).alias("b"))
    found = cells.where("value IS NOT NULL").select("row", "col").join(best, ["row", "col"], "left")
    return found.select("row", "col", F.coalesce("b.code", F.lit(0)).cast("int").alias("direction"), F.col("b.n_row").alias("to_row"), F.col("b.n_col").alias("to_col"))


def flow_accumulation(directions: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """row, col and acc: the cells that drain through a cell, itself included.

    Pointer doubling: in each round a cell hands what it has gathered to the cell as far downstream as it has come,
    and doubles its reach, so the rounds grow with the logarithm of the longest way.
    """
    now = directions.select("row", "col", "to_row", "to_col", F.lit(1).cast("long").alias("acc"))
    for _ in range(most_rounds):
        given = now.where("to_row IS NOT NULL").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("__more"))
        further = now.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("__r"), F.col("to_col").alias("__c"))
        moved = now.join(further, ["to_row", "to_col"], "left").join(given, ["row", "col"], "left")
        now = cut_lineage(moved.select("row", "col", F.col("__r").alias("to_row"), F.col("__c").alias("to_col"), (F.col("acc") + F.coalesce("__more", F.lit(0))).alias("acc")))
        if now.where("to_row IS NOT NULL").isEmpty():
            return now.select("row", "col", "acc")
    raise RuntimeError("the accumulation did not end: the directions have a cycle")


def _edged(group: pd.DataFrame) -> pd.DataFrame:
    """One block's cells with their first level: their value beside no data, else the greatest."""
    r, c = (group["row"] - group["row"].min() + 1).to_numpy(), (group["col"] - group["col"].min() + 1).to_numpy()
    there = np.zeros((r.max() + 2, c.max() + 2), bool)
    there[r, c] = True
    inner = np.all([there[r + dr, c + dc] for dr, dc in DIRECTIONS.values()], axis=0)
    return group.assign(level=np.where(inner, np.inf, group["value"]))[group["mine"]][["row", "col", "value", "level"]]


def _flooded(group: pd.DataFrame) -> pd.DataFrame:
    """One block: the lowest levels that its edge cells and the cells around it allow, by a priority flood."""
    rows, cols = group["row"].to_numpy(), group["col"].to_numpy()
    r0, c0 = rows.min(), cols.min()
    shape = (rows.max() - r0 + 1, cols.max() - c0 + 1)
    value, level = np.full(shape, np.nan), np.full(shape, np.inf)
    value[rows - r0, cols - c0], level[rows - r0, cols - c0] = group["value"], group["level"]
    queue = [(x, int(r), int(c)) for x, r, c in zip(group["level"], rows - r0, cols - c0, strict=True) if x < np.inf]
    heapq.heapify(queue)
    while queue:
        at, r, c = heapq.heappop(queue)
        if at > level[r, c]:
            continue
        for dr, dc in DIRECTIONS.values():
            y, x = r + dr, c + dc
            if 0 <= y < shape[0] and 0 <= x < shape[1] and (reach := max(value[y, x], at)) < level[y, x]:
                level[y, x] = reach
                heapq.heappush(queue, (reach, y, x))
    mine = group[group["mine"]]
    new = level[mine["row"] - r0, mine["col"] - c0]
    return pd.DataFrame({"row": mine["row"], "col": mine["col"], "value": mine["value"], "level": new, "moved": new != mine["level"]})


def fill_depressions(cells: DataFrame, block: int = 256, most_rounds: int = 10_000) -> DataFrame:
    """The lowest surface, nowhere below the given one, from which every cell drains to the edge (cells beside no data are edge).

    Blocks of cells, each with the cells around it, are flooded on their own, again until no level moves: a task holds one
    block, and the rounds follow the number of blocks that water crosses, not that of cells. Blocks see by themselves which cells are
    edge, so no table of cells is joined, or sent from the driver to the tasks.
    """
    valid = cells.where("value IS NOT NULL").select("row", "col", F.col("value").cast("double").alias("value"))
    spots = F.array_distinct(F.array(*(F.struct(F.floor((F.col("row") + r) / block).alias("r"), F.floor((F.col("col") + c) / block).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    own = (F.col("b.r") == F.floor(F.col("row") / block)) & (F.col("b.c") == F.floor(F.col("col") / block))
    dealt = lambda frame: frame.withColumn("b", F.explode(spots)).withColumn("mine", own).groupBy("b")
    now = cut_lineage(dealt(valid).applyInPandas(_edged, "row int, col int, value double, level double"))
    for _ in range(most_rounds):
        after = cut_lineage(dealt(now).applyInPandas(_flooded, "row int, col int, value double, level double, moved boolean"))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now.select("row", "col", F.col("level").alias("value"))
    raise RuntimeError("the levels did not settle")


def streams(accumulation: DataFrame, directions: DataFrame, least: int) -> DataFrame:
    """Stream links inside the mask ``acc`` >= ``least``: from cell, to cell, and head (no or several links arrive)."""
    inside = accumulation.where(F.col("acc") >= least).select("row", "col")
    links = directions.join(inside, ["row", "col"]).where("to_row IS NOT NULL")
    links = links.join(inside.select(F.col("row").alias("to_row"), F.col("col").alias("to_col")), ["to_row", "to_col"])
    arrive = links.groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).count()
    return links.join(arrive, ["row", "col"], "left").select("row", "col", "to_row", "to_col", (F.coalesce("count", F.lit(0)) != 1).alias("head"))


def stream_lines(links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """line (its head's cell as text), seq, row, col, to_row and to_col: the links from each head on, by pointer doubling."""
    above = links.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("row").alias("u_row"), F.col("col").alias("u_col"))
    heads = links.where("head").withColumns({"p_row": F.col("row"), "p_col": F.col("col"), "seq": F.lit(0)})
    others = links.where("NOT head").join(above, ["row", "col"]).withColumnsRenamed({"u_row": "p_row", "u_col": "p_col"}).withColumn("seq", F.lit(1))
    now = cut_lineage(heads.unionByName(others))
    for _ in range(most_rounds):
        up = now.select(F.col("row").alias("p_row"), F.col("col").alias("p_col"), F.col("p_row").alias("u_row"), F.col("p_col").alias("u_col"), F.col("seq").alias("u_seq"))
        step = now.join(up, ["p_row", "p_col"])
        moved = (F.col("p_row") != F.col("u_row")) | (F.col("p_col") != F.col("u_col"))
        after = cut_lineage(step.select("row", "col", "to_row", "to_col", "head", F.col("u_row").alias("p_row"), F.col("u_col").alias("p_col"), (F.col("seq") + F.col("u_seq")).alias("seq"), moved.alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now.select(F.concat_ws("_", "p_row", "p_col").alias("line"), "seq", "row", "col", "to_row", "to_col")
    raise RuntimeError("the lines did not end")


def sampled(points: DataFrame, cells: DataFrame, x: Column, y: Column, x0: float, y0: float, size: float) -> DataFrame:
    """Points with the value of the cell that they lie in; rows go down from ``y0``."""
    at = points.withColumns({"row": F.floor((F.lit(y0) - y) / size).cast("int"), "col": F.floor((x - F.lit(x0)) / size).cast("int")})
    return at.join(cells.select("row", "col", "value"), ["row", "col"], "left")


def reprojected(target: DataFrame, source: DataFrame, back, origin: tuple[float, float], size: float, source_origin: tuple[float, float], steps: tuple[float, float]) -> DataFrame:
    """``source`` resampled to the centres of ``target``'s cells (row, col), bilinear; null outside.

    ``back``: (x, y) columns in the target's frame to the source's, such as ``geo.from_utm``. ``origin``: the target's upper left corner;
    ``source_origin`` and ``steps``: the centre of the source's cell (0, 0), and its steps down and right.
    """
    x, y = F.lit(origin[0]) + (F.col("col") + 0.5) * size, F.lit(origin[1]) - (F.col("row") + 0.5) * size
    u, v = back(x, y)
    asked = target.select(F.struct("row", "col").alias("cell"), ((v - source_origin[1]) / steps[0]).alias("i"), ((u - source_origin[0]) / steps[1]).alias("j"))
    return bilinear(asked, source, F.col("i"), F.col("j"), "cell", "value", "value").select("cell.row", "cell.col", "value")


def zonal(pairs: DataFrame, zone: str, value: str) -> DataFrame:
    """n, least, mean, most, range and exact 90th percentile of each zone's cells that have a value."""
    v = F.col(value)
    plain = [F.count(v).alias("n"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"), (F.max(v) - F.min(v)).alias("relief")]
    return summarised(pairs, [zone], plain, [(v, {"p90": 0.9})])


def complete(cells: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, and whether every cell is there with a value."""
    return cells.agg(F.countDistinct("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"), F.count("value").alias("n")).withColumn("whole", F.col("n") == F.col("n_rows") * F.col("n_cols"))
