"""Exact quantiles by group, where one group may be as large as the table.

Groups of few values take Spark's own exact aggregate, whose buffer holds a group's unlike values. For a group of
more than ``held`` values each wanted order statistic is bracketed: a sketch of the group (of bounded size, with map-side
combine) gives a narrow interval around the wanted rank, one pass counts the rows below each interval, and only the rows inside
stay for the next round, until an interval holds at most ``held`` unlike values or is a single one. A round keeps less than one
row in a hundred of a group for each rank, so a trillion rows take four rounds. No task holds more than a sketch or ``held`` values of a group at once.
A large group that a sketch gives at most half of ``held`` unlike values is counted by value first, with map-side combine, and its ranks are read off the counts.

Tables with a row for each large group are sent to the tasks: a join by so few keys would bring all rows of a group to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage

#: Values of a group that one buffer or window may hold.
HELD = 200_000
#: Sketched quantiles of a group, the sketch's accuracy (its error is a tenth of a step of the grid), and the steps kept on either side.
STEPS, ACCURACY, MARGIN = 1_000, 10_000, 2


def _same(a: str, b: str, names: list[str]) -> Column:
    met = F.lit(True)
    for n in names:
        met = met & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return met


def _bracketed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (key, slot, rank, r) of each (key, slot) in one list b, with the interval lo..hi that holds the value of that rank."""
    grid = rows.groupBy("key", "slot").agg(F.percentile_approx("v", [k / STEPS for k in range(STEPS + 1)], ACCURACY).alias("q"), F.count("*").alias("n"))
    at = F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1)) * STEPS
    low, high = (F.floor(at) - MARGIN).cast("int"), (F.ceil(at) + MARGIN).cast("int")
    lo = F.when(low > 0, F.get("q", low)).otherwise(float("-inf"))
    hi = F.when(high < STEPS, F.get("q", high)).otherwise(float("nan"))  # NaN is the greatest value
    met = targets.alias("t").join(F.broadcast(grid.alias("g")), _same("t", "g", ["key", "slot"]))
    found = met.select("t.key", "t.slot", F.struct(lo.alias("lo"), hi.alias("hi"), "rank", "r").alias("x"))
    return cut_lineage(found.groupBy("key", "slot").agg(F.sort_array(F.collect_list("x")).alias("b")))


def _ranked(rows: DataFrame, targets: DataFrame, held: int) -> DataFrame:
    """key, r and v: the ``rank``-th value (from 0) of the rows (key, slot, v) of each target (key, slot, rank, r)."""
    done = []
    while True:
        brackets = _bracketed(rows, targets)
        met = rows.alias("t").join(F.broadcast(brackets.alias("g")), _same("t", "g", ["key", "slot"])).select("t.key", "t.slot", "v", "b")
        # intervals are in order of lo: a row is below those at the end of the list
        above = F.size(F.filter("b", lambda x: x["lo"] > F.col("v")))
        passed = met.groupBy("key", "slot", above.alias("above")).count()
        sides = passed.alias("t").join(brackets.alias("g"), _same("t", "g", ["key", "slot"]))
        sides = sides.select("t.key", "t.slot", "above", "count", F.posexplode("b").alias("i", "x"), F.size("b").alias("size"))
        below = sides.groupBy("key", "slot", F.col("x.r").alias("r")).agg(F.coalesce(F.sum(F.when(F.col("above") >= F.col("size") - F.col("i"), F.col("count"))), F.lit(0)).alias("below"), F.first("x").alias("x"))
        below = cut_lineage(below.select("key", F.col("r").alias("slot"), F.col("x.rank").alias("rank"), "below", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")))
        inside = met.withColumn("x", F.explode(F.filter("b", lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"]))))
        rows = cut_lineage(inside.select("key", F.col("x.r").alias("slot"), "v"))
        sizes = rows.groupBy("key", "slot", "v").agg(F.count("*").alias("n"))
        held_by = sizes.groupBy("key", "slot").agg(F.count("*").alias("unlike"), F.sum("n").alias("n"))
        told = cut_lineage(below.alias("t").join(held_by.alias("g"), _same("t", "g", ["key", "slot"]), "left").select("t.*", F.col("rank") - F.col("below"), "unlike", "n").toDF("key", "slot", "old", "below", "lo", "hi", "rank", "unlike", "n"))
        if not told.where("unlike IS NULL OR rank < 0 OR rank >= n").isEmpty():
            raise RuntimeError("a sketch missed a rank: raise MARGIN or ACCURACY")
        few = told.where(F.col("unlike") <= held).select("key", "slot", "rank")
        small = sizes.alias("t").join(F.broadcast(few.alias("g")), _same("t", "g", ["key", "slot"])).select("t.*", "rank")
        upto = F.sum("n").over(Window.partitionBy("key", "slot").orderBy("v"))
        done.append(small.withColumn("upto", upto).where("upto > rank AND upto - n <= rank").select("key", F.col("slot").alias("r"), "v"))
        more = told.where(F.col("unlike") > held)
        if more.isEmpty():
            whole = done[0]
            for part in done[1:]:
                whole = whole.union(part)
            return whole
        targets = more.select("key", "slot", "rank", F.col("slot").alias("r"))
        rows = rows.alias("t").join(F.broadcast(targets.alias("g")), _same("t", "g", ["key", "slot"]), "left_semi")


def _counted(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``_ranked``, for rows (key, v) of groups of few unlike values and targets (key, rank, r): the values are counted, and only the counts are sorted."""
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("v"))
    sizes = rows.groupBy("key", "v").agg(F.count("*").alias("n")).withColumn("upto", upto)
    met = sizes.alias("t").join(F.broadcast(targets.alias("g")), _same("t", "g", ["key"]))
    return met.where("upto > rank AND upto - n <= rank").select("t.key", "r", "v")


def _spread(share: list[float], row: DataFrame) -> DataFrame:
    """``row`` (key, n) with a row for each rank that the quantiles ``share`` need."""
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in share))))
    return row.select("key", F.lit(-1).cast("long").alias("slot"), F.explode(ranks).alias("rank")).withColumn("r", F.col("rank"))


def grouped_quantiles(frame: DataFrame, by: list[str], wanted: list[tuple[Column, dict[str, float]]], held: int = HELD) -> DataFrame:
    """``by`` and the linear-interpolated quantiles of ``wanted``, (values, {name: share}) each, over the values that are not null.

    Null levels are levels; a group without values has no row, and a column without values in a group is null there.
    """
    shares = sorted({p for _, own in wanted for p in own.values()})
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("c"), column.cast("double").alias("v")) for i, (column, _) in enumerate(wanted))))
    group = F.struct(*(F.col(f"`{c}`").alias(f"g{k}") for k, c in enumerate(by)), F.lit(0).alias("g"))
    values = frame.select(group.alias("group"), cells).where("v IS NOT NULL").select(F.struct("group", "c").alias("key"), "v")
    counts = cut_lineage(values.groupBy("key").agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("unlike")))
    large = counts.where(F.col("n") > held)
    if large.isEmpty():
        found = values.groupBy("key").agg(F.percentile("v", shares).alias("q"))
    else:
        of = lambda groups, how: values.alias("t").join(F.broadcast(groups.alias("g")), _same("t", "g", ["key"]), how)
        met, few, many = of(large, "left_anti"), large.where(F.col("unlike") * 2 <= held), large.where(F.col("unlike") * 2 > held)
        ranked = _counted(of(few, "left_semi"), _spread(shares, few))
        if not many.isEmpty():
            ranked = ranked.union(_ranked(of(many, "left_semi").withColumn("slot", F.lit(-1).cast("long")), _spread(shares, many), held))
        ranked = ranked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))
        whole = ranked.alias("t").join(F.broadcast(large.alias("g")), _same("t", "g", ["key"])).select("t.key", "m", "n")

        def between(p: float) -> Column:
            at = (F.col("n") - 1) * p
            low, high = F.element_at("m", F.floor(at)), F.element_at("m", F.ceil(at))
            return low + (high - low) * (at - F.floor(at))

        found = met.groupBy("key").agg(F.percentile("v", shares).alias("q")).union(whole.select("key", F.array(*map(between, shares))))
    out = [F.max(F.when(F.col("key.c") == i, F.get("q", F.lit(shares.index(p))))).alias(name) for i, (_, own) in enumerate(wanted) for name, p in own.items()]
    rows = found.groupBy("key.group").agg(*out)
    return rows.select(*(F.col(f"group.g{k}").alias(c) for k, c in enumerate(by)), *(F.col(name) for _, own in wanted for name in own))


def summarised(frame: DataFrame, by: list[str], plain: list[Column], wanted: list[tuple[Column, dict[str, float]]], held: int = HELD) -> DataFrame:
    """``by``, the aggregates ``plain`` and the quantiles of ``wanted``; groups without values are there, with null quantiles."""
    rows = frame.groupBy(*by).agg(*plain)
    exact = grouped_quantiles(frame, by, wanted, held)
    names = [name for _, own in wanted for name in own]
    met = rows.alias("t").join(exact.alias("g"), _same("t", "g", by), "left")
    return met.select("t.*", *(F.col(f"g.{n}") for n in names))
