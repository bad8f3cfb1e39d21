"""Validated key joins, interval overlap, nearest neighbours and interpolation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.ordered import next_match, sliced, with_next
from waymark.session import cut_lineage


class KeyViolation(ValueError):
    """A join's key is not unique, or columns clash."""


def unique_key(frame: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``frame``, if no key is there twice."""
    twice = frame.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise KeyViolation(f"{name} repeats keys: {[tuple(r)[:-1] for r in twice]}")
    return frame


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join with unique keys on both sides and no clashing columns, so a left join keeps its row count."""
    if clash := (set(left.columns) & set(right.columns)) - set(keys):
        raise KeyViolation(f"columns on both sides: {sorted(clash)}")
    return unique_key(left, keys, "left").join(unique_key(right, keys, "right"), keys, how)


def star(base: DataFrame, features: list[DataFrame], keys: list[str]) -> DataFrame:
    """All feature tables onto the base; each must have at most one row a key."""
    return reduce(lambda a, b: one_to_one(a, b, keys), features, base)


def join_with_suffix(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, how: str = "left") -> DataFrame:
    """Join where the right side's clashing columns get ``suffix``."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), keys, how)


def overlap_theta(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Half-open intervals that overlap, by the plain condition. For a right side that is known to be small."""
    return left.join(right, (F.col(b[0]) < F.col(a[1])) & (F.col(b[1]) > F.col(a[0])))


def overlap_binned(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float | None = None, empty: bool = False) -> DataFrame:
    """The same pairs through an equi join on bins of ``width``: each pair is kept in the first bin that both share.

    Intervals without length have no pairs, or with ``empty`` those that the plain condition gives them: with the intervals that hold their place inside.
    Without ``width`` it is the longer side's mean span, so intervals take two bins on average, whatever their unit.
    """
    if width is None:
        spans = (f.agg(F.avg(F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)))).first()[0] for f, (lo, hi) in ((left, a), (right, b)))
        width = float(max((x for x in spans if x), default=1.0))

    def bins(lo: str, hi: str) -> Column:
        long = F.when(F.col(hi) > F.col(lo), F.sequence(F.floor(F.col(lo) / width), F.ceil(F.col(hi) / width) - 1))
        return long.otherwise(F.array(F.floor(F.col(lo) / width))) if empty else long

    ours, theirs = left.withColumn("__bin", F.explode(bins(*a))), right.withColumn("__bin", F.explode(bins(*b)))
    both = ours.join(theirs, "__bin").where((F.col(b[0]) < F.col(a[1])) & (F.col(b[1]) > F.col(a[0])))
    return both.where(F.col("__bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)).drop("__bin")


def _least_alike(targets: DataFrame, key: str, kept: int = 1) -> DataFrame:
    """Of targets that are alike in all but their key, those with the ``kept`` least keys: none of the others is ever the nearest of a point."""
    alike = Window.partitionBy(*(f"`{c}`" for c in targets.columns if c != key)).orderBy(key)
    return targets.where(F.col(key).isNotNull()).distinct().withColumn("__k", F.row_number().over(alike)).where(F.col("__k") <= kept).drop("__k")


def _nine_cells(targets: DataFrame, size: float, at: tuple[Column, Column]) -> DataFrame:
    """``targets`` in their own and the eight neighbouring cells (__cx, __cy) of ``size``."""
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = targets.withColumns({"__x": F.floor(at[0] / size), "__y": F.floor(at[1] / size), "__n": F.explode(F.array(*around))})
    return spread.withColumns({"__cx": F.col("__x") + F.col("__n.i"), "__cy": F.col("__y") + F.col("__n.j")}).drop("__n", "__x", "__y")


def nearest_within(points: DataFrame, targets: DataFrame, reach: float, distance: Column, point_key: str, target_key: str, own: Column, cells: tuple[Column, Column], others: tuple[Column, Column], strict: bool = False) -> DataFrame:
    """Each point's nearest target within ``reach``: point_key, target_key and distance, ties to the smaller target.

    ``cells`` and ``others`` are both sides' planar coordinates; points meet the targets of their
    own and the eight neighbouring cells of size ``reach`` in an equi join. ``own``: pairs to leave out, for each point those with one target key at most.
    Of targets that are alike in all but their key only the two least take part, so a place with many targets is no hot cell.
    """
    there = _nine_cells(_least_alike(targets, target_key, 2), reach, others)
    asked = points.withColumns({"__cx": F.floor(cells[0] / reach), "__cy": F.floor(cells[1] / reach)})
    near = asked.join(there, ["__cx", "__cy"]).where(~own).withColumn("distance", distance)
    near = near.where(F.col("distance") <= reach if not strict else (F.col("distance") > 0) & (F.col("distance") <= reach))
    best = near.groupBy(point_key).agg(F.min(F.struct("distance", target_key)).alias("best"))
    return best.select(point_key, F.col(f"best.{target_key}").alias(target_key), F.col("best.distance").alias("distance"))


def nearest_on_earth(points: DataFrame, targets: DataFrame, distance: Column, point_key: str, target_key: str, here: tuple[str, str], there: tuple[str, str], most_rounds: int = 40) -> DataFrame:
    """Each point's nearest target at whatever great-circle distance (metres), ties to the smaller target; any number of either.

    ``here`` and ``there``: longitude and latitude in degrees. Points meet the targets of their own and the eight neighbouring
    cells in an equi join. A best distance within the reach that these nine cells surely cover is final; the other points go on
    with cells of twice the size, until the cells are wider than the earth. Cells don't go round at 180 degrees, so points whose
    cells come near it are final in the last round only. Targets alike in all but their key meet as the one with the least key.
    """
    targets = cut_lineage(_least_alike(targets, target_key))
    span = targets.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{k}") for k, c in enumerate(there) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not span.n:
        return points.where(F.lit(False)).select(point_key, F.lit(None).cast(targets.schema[target_key].dataType).alias(target_key), F.lit(0.0).alias("distance"))
    size = max(1e-6, (max(span.hi0 - span.lo0, 1e-6) * max(span.hi1 - span.lo1, 1e-6) / span.n) ** 0.5)
    open_, done = points, None
    for _ in range(most_rounds):
        asked = open_.withColumns({"__cx": F.floor(F.col(here[0]) / size), "__cy": F.floor(F.col(here[1]) / size)})
        met = asked.join(_nine_cells(targets, size, (F.col(there[0]), F.col(there[1]))), ["__cx", "__cy"]).withColumn("distance", distance)
        best = met.groupBy(point_key).agg(F.min(F.struct("distance", target_key)).alias("best"))
        # Beyond the cells a target is a cell's height away in latitude, or a cell's width in longitude: at least the way to that meridian.
        wide = F.when(F.lit(size) < 90, F.asin(F.cos(F.radians(here[1])) * F.sin(F.radians(F.lit(min(size, 90.0)))))).otherwise(F.radians(F.lit(min(size, 90.0))) * 0)
        reach = F.lit(geo.EARTH_M) * F.least(F.radians(F.lit(size)), wide)
        tried = cut_lineage(open_.join(best, point_key, "left").withColumn("__final", F.lit(size > 720) | F.coalesce((F.col("best.distance") < reach - 0.001) & (F.abs(here[0]) + 2 * size < 180), F.lit(False))))
        found = tried.where("__final AND best IS NOT NULL").select(point_key, F.col(f"best.{target_key}").alias(target_key), F.col("best.distance").alias("distance"))
        done = found if done is None else done.union(found)
        open_ = tried.where("NOT __final").drop("best", "__final")
        if size > 720 or open_.isEmpty():
            return done
        size *= 2
    raise RuntimeError("the cells did not grow wide enough")


class TooFar(ValueError):
    """Points have no edge within the reach."""


def nearest_edge(points: DataFrame, edges: DataFrame, reach: float, point_key: str, edge_key: str, places: int | None = None) -> DataFrame:
    """Each point (px, py) with its nearest edge (ax, ay, bx, by) within ``reach``, the first of equally near ones, and its distance; null where none is: ``too_far`` says so.

    ``places``: distances are rounded to so many decimals before they are compared.
    """
    firsts, _ = alike_lines(edges, edge_key)  # of edges that are alike the first one wins
    near = _near_lines(points, firsts, reach + (10.0**-places if places is not None else 0.0), point_key, edge_key)
    if places is not None:
        near = near.withColumn("distance", F.round("distance", places)).where(F.col("distance") <= reach)
    best = near.groupBy(point_key).agg(F.min(F.struct("distance", edge_key)).alias("b"))
    return points.select(point_key).join(best, point_key, "left").select(point_key, F.col(f"b.{edge_key}").alias(edge_key), F.col("b.distance").alias("distance"), F.col("b").isNull().alias("too_far"))


def snapped(points: DataFrame, edges: DataFrame, reach: float, point_key: str, edge_key: str, shown: int = 5) -> DataFrame:
    """As ``nearest_edge``, for runs that may not go on with a point off the line: fails and names the first such points."""
    found = cut_lineage(nearest_edge(points, edges, reach, point_key, edge_key))
    if rows := found.where("too_far").select(point_key).orderBy(point_key).limit(shown).collect():
        raise TooFar(f"no edge within {reach}: {[r[0] for r in rows]}")
    return found.drop("too_far")


def _along(edges: DataFrame, reach: float, size: float) -> DataFrame:
    """``edges`` (ax, ay, bx, by) with the cells of ``size`` (__cx, __cy) that a strip of ``reach`` around each passes: in each row of cells, only those beside its part in that row."""
    reach = reach + size * 1e-9
    cell = lambda c: F.floor(c / size)
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    rows = edges.withColumn("__cy", F.explode(F.sequence(cell(F.least(ay, by) - reach), cell(F.greatest(ay, by) + reach))))
    ends = [(y - ay) / F.nullif(by - ay, F.lit(0.0)) for y in (F.col("__cy") * size - reach, (F.col("__cy") + 1) * size + reach)]
    inside = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    first, last = inside(F.coalesce(F.least(*ends), F.lit(0.0))), inside(F.coalesce(F.greatest(*ends), F.lit(1.0)))
    x0, x1 = ax + first * (bx - ax), ax + last * (bx - ax)
    return rows.withColumn("__cx", F.explode(F.sequence(cell(F.least(x0, x1) - reach), cell(F.greatest(x0, x1) + reach))))


def alike_lines(edges: DataFrame, line_key: str) -> tuple[DataFrame, DataFrame]:
    """The unlike edges (ax, ay, bx, by) of the first line of all that have the same edges, and all lines with that one: line_key and __like.

    Lines are told apart by the number of their unlike edges and two sums of 64-bit hashes of them, so no task holds a line.
    """
    ends = ["ax", "ay", "bx", "by"]
    unlike = cut_lineage(edges.select(line_key, *ends).distinct())
    sums = [F.sum(F.xxhash64(F.lit(k), *ends).cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)]
    shape = unlike.groupBy(line_key).agg(F.count("*").alias("n"), *sums)
    firsts = shape.groupBy("n", "h0", "h1").agg(F.min(line_key).alias("__like"))
    lines = cut_lineage(shape.join(firsts, ["n", "h0", "h1"]).select(line_key, "__like"))
    return unlike.join(lines.where(F.col(line_key).eqNullSafe(F.col("__like"))).select(line_key), line_key, "left_semi"), lines


def _members(pairs: DataFrame, lines: DataFrame, line_key: str) -> DataFrame:
    """``pairs`` of a first line with all lines that are like it."""
    named = lines.withColumnsRenamed({line_key: "__one", "__like": "__first"})
    met = pairs.join(named, F.col(line_key) == F.col("__first"))
    return met.select(*(F.col("__one").alias(c) if c == line_key else F.col(f"`{c}`") for c in pairs.columns))


def within_of_lines(points: DataFrame, edges: DataFrame, reach: float, point_key: str, line_key: str) -> DataFrame:
    """Pairs of points (px, py) and lines with an edge (ax, ay, bx, by) within ``reach``, with the least distance.

    An edge goes to the cells of size ``reach`` that it passes within ``reach``, a point to its own. Of lines that have the same edges the first
    one meets the points, and the others get its pairs.
    """
    firsts, lines = alike_lines(edges, line_key)
    return _members(_near_lines(points, firsts, reach, point_key, line_key), lines, line_key)


def _near_lines(points: DataFrame, edges: DataFrame, reach: float, point_key: str, line_key: str) -> DataFrame:
    cell = lambda c: F.floor(c / reach)
    near = points.withColumns({"__cx": cell(F.col("px")), "__cy": cell(F.col("py"))}).join(_along(edges, reach, reach), ["__cx", "__cy"])
    near = near.withColumn("distance", geo.point_segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))).where(F.col("distance") <= reach)
    return near.groupBy(point_key, line_key).agg(F.min("distance").alias("distance"))


def lines_within(left: DataFrame, right: DataFrame, reach: float, left_key: str, right_key: str, size: float | None = None) -> DataFrame:
    """Pairs of lines whose edges (ax, ay, bx, by) come within ``reach``: the buffered intersects join. ``size``: of the cells that edges meet in, ``reach`` unless given."""
    size = size or reach
    ours = _along(left, reach, size).select(left_key, "__cx", "__cy", F.struct("ax", "ay", "bx", "by").alias("__a"))
    theirs = _along(right, 0.0, size).select(right_key, "__cx", "__cy", F.struct("ax", "ay", "bx", "by").alias("__b"))
    sides = [tuple(F.col(f"{s}.{c}") for c in ("ax", "ay", "bx", "by")) for s in ("__a", "__b")]
    return ours.join(theirs, ["__cx", "__cy"]).where(geo.segments_distance(*sides) <= reach).select(left_key, right_key).distinct()


def lines_crossing(edges: DataFrame, line_key: str, size: float) -> DataFrame:
    """low and high: pairs of lines with edges (ax, ay, bx, by) that cross inside both; edges that only touch do not. ``size``: of the cells that edges meet in."""
    firsts, lines = alike_lines(edges, line_key)
    there = _along(firsts, 0.0, size)
    side = lambda name, e: there.select("__cx", "__cy", F.col(line_key).alias(name), F.struct("ax", "ay", "bx", "by").alias(e))
    met = side("low", "a").join(side("high", "b"), ["__cx", "__cy"])
    pairs = met.where(geo.segments_cross(*(tuple(F.col(f"{e}.{c}") for c in ("ax", "ay", "bx", "by")) for e in ("a", "b")))).select("low", "high").distinct()
    named = lambda name: lines.select(F.col(line_key).alias(name), "__like")
    whole = _members(_members(pairs, named("low"), "low"), named("high"), "high")
    return whole.where("low < high")


class OutOfBounds(ValueError):
    """A point lies outside of the anchors."""


def interpolate(points: DataFrame, anchors: DataFrame, at: str, x: str, y: str, out: str, outside: str = "drop") -> DataFrame:
    """Piecewise linear y at ``at`` between consecutive anchors; in a shared end the first bracket holds.

    Points outside are left out, or fail with ``outside="fail"``. Anchors of any number: brackets and points meet in the order of the line.
    """
    own = anchors.where(F.col(x).isNotNull()).select(F.lit(0).alias("__one"), F.col(x).cast("double").alias("x0"), F.col(y).alias("y0"))
    brackets = with_next(sliced(own, "__one", "x0"), "__one", "x0", ["x0", "y0"], "__n").where("__n.x0 > x0")
    brackets = brackets.select("__one", "x0", "y0", F.col("__n.x0").alias("x1"), F.col("__n.y0").alias("y1"))
    met = next_match(points.withColumn("__one", F.lit(0)), brackets, "__one", F.col(at), F.col("x1"), "__b").drop("__one")
    inside = F.coalesce(F.col(at) >= F.col("__b.x0"), F.lit(False))
    if outside == "fail" and (rows := met.where(~inside).select(at).limit(3).collect()):
        raise OutOfBounds(f"outside of the anchors: {[r[0] for r in rows]}")
    value = F.col("__b.y0") + (F.col(at) - F.col("__b.x0")) * (F.col("__b.y1") - F.col("__b.y0")) / (F.col("__b.x1") - F.col("__b.x0"))
    return met.where(inside).withColumn(out, value).drop("__b")


def bilinear(points: DataFrame, grid: DataFrame, i: Column, j: Column, key: str, value: str, out: str) -> DataFrame:
    """``value`` of the grid (row, col) at fractional indices ``i``, ``j``: four weighted cells in one join. Null where a cell with weight is missing."""
    i0, j0 = F.floor(i), F.floor(j)
    corners = [F.struct((i0 + a).cast("int").alias("row"), (j0 + b).cast("int").alias("col"), ((i - i0 if a else 1 - (i - i0)) * (j - j0 if b else 1 - (j - j0))).alias("w")) for a in (0, 1) for b in (0, 1)]
    asked = points.select(key, F.inline(F.array(*corners))).where("w > 0")
    met = asked.join(grid.select("row", "col", value), ["row", "col"], "left")
    return met.groupBy(key).agg(F.when(F.count(value) == F.count("*"), F.sum(F.col("w") * F.col(value))).alias(out))


