"""Polylines as vertex rows (line, seq, x, y): edges, chainage, cuts and gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ordered import next_match, sliced, with_next, with_previous, with_running_sum


def without_repeats(vertices: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """Vertices equal to the one before them go."""
    rows = with_previous(sliced(vertices, line, seq), line, seq, ["x", "y"], "__p")
    same = F.col("__p").isNotNull() & F.col("__p.x").eqNullSafe(F.col("x")) & F.col("__p.y").eqNullSafe(F.col("y"))
    return rows.where(~same).select(*vertices.columns)


def edges(vertices: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """line, seq, ax, ay, bx, by and length of consecutive vertices; edges without length go."""
    rows = with_next(sliced(vertices.select(line, seq, "x", "y"), line, seq), line, seq, ["x", "y"], "__n")
    pairs = rows.select(line, seq, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("__n.x").alias("bx"), F.col("__n.y").alias("by"))
    return pairs.where("bx IS NOT NULL AND NOT (ax = bx AND ay = by)").withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))


def measured(pieces: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """Edges with s0 and s1, the way along the line to their ends."""
    rows = with_running_sum(sliced(pieces, line, seq), line, seq, "length", "s1")
    return rows.select(*pieces.columns, "s1", (F.col("s1") - F.col("length")).alias("s0"))


def points_at(pieces: DataFrame, wanted: DataFrame, line: str = "line", s: str = "s") -> DataFrame:
    """``wanted`` (line, s, ...) with x, y at that way along the line, clamped to its ends; lines without edges have no rows.

    Each place meets the one edge that ends at it or behind it, found in the order of the line: no pairs of places and edges.
    """
    ends = pieces.groupBy(line).agg(F.max("s1").alias("__whole"))
    asked = wanted.drop("x", "y").join(ends, line).withColumn("__s", F.least(F.greatest(F.col(s), F.lit(0.0)), F.col("__whole")))
    there = pieces.select(line, "ax", "ay", "bx", "by", "s0", "s1")
    met = next_match(asked, there, line, F.col("__s"), F.col("s1"), "__e")
    t = (F.col("__s") - F.col("__e.s0")) / (F.col("__e.s1") - F.col("__e.s0"))
    put = {c: F.col(f"__e.a{c}") + t * (F.col(f"__e.b{c}") - F.col(f"__e.a{c}")) for c in ("x", "y")}
    return met.where("__e IS NOT NULL").withColumns(put).drop("__e", "__s", "__whole")


def midpoints(pieces: DataFrame, line: str = "line") -> DataFrame:
    return points_at(pieces, pieces.groupBy(line).agg((F.max("s1") / 2).alias("s")), line)


def cut(pieces: DataFrame, spans: DataFrame, step: float, line: str = "line") -> DataFrame:
    """Vertices of sub-lines: each span (span, line, from, to) sampled every ``step``, both ends included."""
    n = F.greatest(F.lit(1), F.ceil((F.col("to") - F.col("from")) / step))
    at = spans.withColumn("seq", F.explode(F.sequence(F.lit(0), n.cast("int")))).withColumn("s", F.least(F.col("from") + F.col("seq") * step, F.col("to")))
    return points_at(pieces, at, line).select("span", "seq", "s", "x", "y")


def gradients(samples: DataFrame, by: list[str], at: str, value: str, least_step: float = 0.0) -> DataFrame:
    """Steps between consecutive samples that have a value: d_at, d_value and their ratio; steps of ``least_step`` or less go."""
    w = Window.partitionBy(*by).orderBy(at)
    whole = samples.where(F.col(value).isNotNull())
    steps = whole.withColumns({"d_at": F.col(at) - F.lag(at).over(w), "d_value": F.col(value) - F.lag(value).over(w)})
    return steps.where(F.col("d_at") > least_step).withColumn("gradient", F.col("d_value") / F.col("d_at"))


def slope_summary(samples: DataFrame, segment: str, at: str, value: str, least_step: float) -> DataFrame:
    """For each segment: elevations at both ends, net change and slope, mean and most absolute slope in percent, and samples."""
    whole = samples.where(F.col(value).isNotNull())
    ends = whole.groupBy(segment).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), (F.max(at) - F.min(at)).alias("way"), F.count("*").alias("n"))
    steep = gradients(samples, [segment], at, value, least_step).groupBy(segment).agg((100 * F.avg(F.abs("gradient"))).alias("mean_abs_pct"), (100 * F.max(F.abs("gradient"))).alias("max_abs_pct"))
    net = F.col("last") - F.col("first")
    return ends.join(steep, segment, "left").select(segment, "first", "last", net.alias("net"), F.when(F.col("way") > 0, 100 * net / F.col("way")).alias("net_pct"), "mean_abs_pct", "max_abs_pct", "n")


def broken_order(anchors: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Anchors that do not rise in both x and y above the one before them, in each group of ``by``; without groups, for a line's few anchors."""
    w = Window.partitionBy(*(by or [])).orderBy(x)
    steps = anchors.withColumns({"__dx": F.col(x) - F.lag(x).over(w), "__dy": F.col(y) - F.lag(y).over(w)})
    return steps.where("__dx <= 0 OR __dy <= 0").drop("__dx", "__dy")


def local_context(frame: DataFrame, km: str, value: str, reach: int, by: list[str], out: str) -> DataFrame:
    """Mean of ``value`` within ``reach`` before and behind along ``km``, in each group."""
    w = Window.partitionBy(*by).orderBy(km).rangeBetween(-reach, reach)
    return frame.withColumn(out, F.avg(value).over(w))
