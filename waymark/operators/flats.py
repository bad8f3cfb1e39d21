"""Flats of a filled surface: areas of equal height get a lift that falls towards their outlets and away from higher ground.

Cells are dealt to square blocks, each with the ring of cells around it, so a cell is copied only where it lies on a block's rim.
Blocks label their own areas; areas that meet across a rim are joined as components of a graph of labels. Both distance fields (steps to the
nearest outlet, steps from the nearest cell below higher ground) are relaxed block by block with exchanged rims until no distance falls,
over the cells of flats alone. The lift is twice the way to the outlet plus what the way from higher ground lacks of its area's most:
a step towards the outlet lowers the first part by two and raises the second by one at most, so every flat drains.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.graph import components
from waymark.operators.grid import DIRECTIONS, d8_direction
from waymark.session import cut_lineage

_STEPS = list(DIRECTIONS.values())


def _dealt(cells: DataFrame, block: int) -> DataFrame:
    """``cells`` with the block b that each serves, its own (``mine``) or one beside it."""
    spots = F.array_distinct(F.array(*(F.struct(F.floor((F.col("row") + r) / block).alias("r"), F.floor((F.col("col") + c) / block).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    own = (F.col("b.r") == F.floor(F.col("row") / block)) & (F.col("b.c") == F.floor(F.col("col") / block))
    return cells.withColumn("b", F.explode(spots)).withColumn("mine", own)


def _laid(group: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places of the rows in arrays with a margin of one, and the columns as such arrays; NaN where there is no cell."""
    r, c = (group["row"] - group["row"].min() + 1).to_numpy(), (group["col"] - group["col"].min() + 1).to_numpy()
    out = []
    for name in columns:
        laid = np.full((r.max() + 2, c.max() + 2), np.nan)
        laid[r, c] = group[name]
        out.append(laid)
    return r, c, out


def _shifted(laid: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    return np.roll(laid, (-step[0], -step[1]), (0, 1))


def _kinds(group: pd.DataFrame) -> pd.DataFrame:
    """Cells with a neighbour of their height: whether they drain (to a lower cell or off the grid), and whether higher ground is beside them."""
    r, c, (value,) = _laid(group, ["value"])
    around = [_shifted(value, s) for s in _STEPS]
    drains = np.any([(x < value) | np.isnan(x) for x in around], axis=0)[r, c]
    level, high = (np.any([f(x, value) for x in around], axis=0)[r, c] for f in (np.equal, np.greater))
    kept = group["mine"].to_numpy() & level
    return pd.DataFrame({"row": group["row"], "col": group["col"], "value": group["value"], "drains": drains, "high": high})[kept]


def _labelled(group: pd.DataFrame) -> pd.DataFrame:
    """A block's own areas of equal height, named by their first cell."""
    mine = group[group["mine"]].sort_values(["row", "col"])
    at = {(r, c): (v, i) for i, (r, c, v) in enumerate(zip(mine["row"], mine["col"], mine["value"], strict=True))}
    label = [-1] * len(mine)
    names = (mine["row"].astype("int64") * (1 << 32) + mine["col"]).tolist()
    for start, (v, i) in at.items():
        if label[i] != -1:
            continue
        label[i], queue = names[i], deque([start])
        while queue:
            r, c = queue.popleft()
            for dr, dc in _STEPS:
                there = at.get((r + dr, c + dc))
                if there and there[0] == v and label[there[1]] == -1:
                    label[there[1]] = names[i]
                    queue.append((r + dr, c + dc))
    return mine.assign(label=label)[["row", "col", "value", "drains", "high", "label"]]


def _relaxed(group: pd.DataFrame) -> pd.DataFrame:
    """One block: distances as low as its own cells and the ring around it allow."""
    at = {(r, c): i for i, (r, c) in enumerate(zip(group["row"], group["col"], strict=True))}
    places, labels, new = list(at), group["label"].tolist(), {}
    for name in ("low", "away"):
        best = group[name].to_numpy(copy=True)
        levels: dict[float, list[int]] = {}
        for i in np.flatnonzero(np.isfinite(best)).tolist():
            levels.setdefault(best[i], []).append(i)
        d = min(levels, default=0.0)
        while levels:  # unit steps: all cells at d, then those at d + 1
            for i in levels.pop(d, ()):
                if best[i] < d:
                    continue
                r, c = places[i]
                for dr, dc in _STEPS:
                    j = at.get((r + dr, c + dc))
                    if j is not None and labels[j] == labels[i] and best[j] > d + 1:
                        best[j] = d + 1
                        levels.setdefault(d + 1, []).append(j)
            d += 1
        new[name] = best
    moved = (new["low"] != group["low"]) | (new["away"] != group["away"])
    return group.assign(**new, moved=moved)[group["mine"]][["row", "col", "value", "drains", "label", "low", "away", "moved"]]


def flat_lifts(filled: DataFrame, block: int = 256, most_rounds: int = 10_000) -> DataFrame:
    """row, col, value, drains, label and lift of the cells of ``filled`` (row, col, value) that have a neighbour of their height.

    An area without an outlet, as a surface has that was not filled, keeps null lifts.
    """
    valid = filled.where("value IS NOT NULL").select("row", "col", F.col("value").cast("double").alias("value"))
    kinds = cut_lineage(_dealt(valid, block).groupBy("b").applyInPandas(_kinds, "row int, col int, value double, drains boolean, high boolean"))
    flat = "row int, col int, value double, drains boolean, high boolean, label long"
    own = cut_lineage(_dealt(kinds, block).groupBy("b").applyInPandas(_labelled, flat))

    # areas meet across rims: only cells on a rim are asked. Tables of areas grow with the grid, so no join may send one from the driver.
    place = lambda c: F.col(c) - F.floor(F.col(c) / block) * block
    rim = own.where(place("row").isin(0, block - 1) | place("col").isin(0, block - 1)).select("row", "col", "value", "label")
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _STEPS[:4]))  # the other four are the same pairs
    asked = rim.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "value", F.col("label").alias("src"))
    edges = asked.join(rim.withColumnRenamed("label", "dst").hint("merge"), ["row", "col", "value"]).where("src <> dst").select("src", "dst").distinct()
    roots = components(edges)
    named = own.join(roots.withColumnRenamed("node", "label").hint("merge"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")

    far = F.lit(float("inf"))
    now = cut_lineage(named.select("row", "col", "value", "drains", "label", F.when(F.col("drains"), 0.0).otherwise(far).alias("low"), F.when(F.col("high") & ~F.col("drains"), 0.0).otherwise(far).alias("away")))
    for _ in range(most_rounds):
        after = cut_lineage(_dealt(now, block).groupBy("b").applyInPandas(_relaxed, "row int, col int, value double, drains boolean, label long, low double, away double, moved boolean"))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("the distances did not settle")
    finite = lambda c: F.when(F.col(c) < far, F.col(c))
    most = now.groupBy("label").agg(F.max(finite("away")).alias("most"))
    lift = 2 * finite("low") + F.coalesce(F.col("most") - finite("away"), F.lit(0.0))
    return cut_lineage(now.join(most.hint("merge"), "label").select("row", "col", "value", "drains", "label", lift.cast("long").alias("lift")))


def resolved(filled: DataFrame, step: float = 1e-5, block: int = 256) -> DataFrame:
    """``filled`` with its flats raised by ``step`` for each lift: no cell inside is level with its way out. No data stays."""
    lifts = flat_lifts(filled, block).select("row", "col", "lift")
    return filled.join(lifts, ["row", "col"], "left").select("row", "col", (F.col("value") + F.coalesce("lift", F.lit(0)) * step).alias("value"))


def drained(filled: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = 256) -> DataFrame:
    """D8 directions as ``d8_direction`` gives them, and in flats towards the least lift beside a cell (ties to the smaller code), whatever a raised height would round to."""
    lifts = flat_lifts(filled, block)
    steps = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(r).alias("r"), F.lit(c).alias("c")) for code, (r, c) in DIRECTIONS.items()))
    asked = lifts.where("NOT drains").withColumn("s", F.explode(steps))
    asked = asked.select("row", "col", "label", "lift", F.col("s.code").alias("code"), (F.col("row") + F.col("s.r")).alias("to_row"), (F.col("col") + F.col("s.c")).alias("to_col"))
    there = lifts.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), "label", F.col("lift").alias("n_lift"))
    down = asked.join(there, ["to_row", "to_col", "label"]).where("n_lift < lift")
    best = down.groupBy("row", "col").agg(F.min(F.struct("n_lift", "code", "to_row", "to_col")).alias("f"))
    steep = d8_direction(filled, dx, dy).join(best, ["row", "col"], "left")
    pick = lambda c, f: F.when(F.col("direction") > 0, F.col(c)).otherwise(F.coalesce(F.col(f"f.{f}"), F.col(c))).alias(c)
    return steep.select("row", "col", pick("direction", "code"), pick("to_row", "to_row"), pick("to_col", "to_col"))
