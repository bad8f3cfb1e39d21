"""Segment graphs: neighbours, invariants, connectivity and shortest paths over edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import segment_id
from waymark.operators import routing
from waymark.session import cut_lineage


def linear_neighbours(segments: DataFrame, source: str = "derived:v1_segment_order") -> DataFrame:
    """Both directions between segments that meet: nine columns, an equi join on the shared bound."""
    a = segments.select("km_inicio", "km_fin").distinct()
    b = a.select(F.col("km_inicio").alias("neighbor_km_inicio"), F.col("km_fin").alias("neighbor_km_fin"))
    up = a.join(b, F.col("km_fin") == F.col("neighbor_km_inicio"))
    down = a.join(b, F.col("km_inicio") == F.col("neighbor_km_fin"))
    return up.union(down).select(
        segment_id(F.col("km_inicio"), F.col("km_fin")).alias("segment_id"), "km_inicio", "km_fin",
        segment_id(F.col("neighbor_km_inicio"), F.col("neighbor_km_fin")).alias("neighbor_segment_id"), "neighbor_km_inicio", "neighbor_km_fin",
        F.lit(1).alias("distance_order"), F.lit(1.0).alias("weight"), F.lit(source).alias("fuente"),
    )


def degrees(edges: DataFrame, src: str = "src") -> DataFrame:
    return edges.groupBy(src).agg(F.count("*").alias("degree"))


def missing_reciprocals(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose reverse is not there."""
    return edges.select(src, dst).join(edges.select(F.col(dst).alias(src), F.col(src).alias(dst)), [src, dst], "left_anti")


def violations(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """rule and n for self loops, duplicates and missing reciprocals."""
    loops = edges.where(F.col(src) == F.col(dst)).agg(F.lit("self_loop").alias("rule"), F.count("*").alias("n"))
    twice = edges.groupBy(src, dst).count().where("count > 1").agg(F.lit("duplicate").alias("rule"), F.count("*").alias("n"))
    alone = missing_reciprocals(edges, src, dst).agg(F.lit("no_reciprocal").alias("rule"), F.count("*").alias("n"))
    return loops.union(twice).union(alone)


def reached(edges: DataFrame, start, most_rounds: int = 100_000) -> DataFrame:
    """node and hops from ``start`` over directed edges (src, dst), by a frontier."""
    all_ = cut_lineage(edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("node"), F.lit(0).alias("hops")))
    front = all_
    for hop in range(1, most_rounds):
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(all_, "node", "left_anti")
        front = cut_lineage(new.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return all_
        all_ = cut_lineage(all_.union(front))
    raise RuntimeError("the frontier did not end")


def components(edges: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """node and root, the least node of its component, for the nodes of undirected edges (src, dst).

    Stars, larger and smaller in turn: a node's larger neighbours, then its smaller ones, are tied to the least node around it. The rounds
    grow with the logarithm of the longest way; the least node of a hub is found with map-side combine.
    """
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    now = cut_lineage(both)
    for _ in range(most_rounds):
        ways = now.union(now.select("b", "a")).toDF("n", "m")
        least = ways.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        large = ways.where("m > n").join(least.hint("merge"), "n").select(F.col("root").alias("a"), F.col("m").alias("b"))
        tied = cut_lineage(large.where("a < b").distinct())
        # smaller star: each node's smaller neighbours and itself to the least of them
        low = tied.groupBy("b").agg(F.min("a").alias("root"))
        met = tied.join(low.hint("merge"), "b")
        after = cut_lineage(met.select(F.col("root").alias("x"), F.col("a").alias("y")).union(met.select("root", "b")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        same = after.count() == now.count() and after.join(now.hint("merge"), ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError("the components did not settle")


def shortest_costs(edges: DataFrame, start) -> DataFrame:
    """node, cost and previous node of the cheapest ways from ``start`` over (src, dst, w >= 0); unreachable nodes are not there. See ``routing``."""
    kind = edges.schema["src"].dataType
    leg = edges.sparkSession.range(1).select(F.lit(0).alias("leg"), F.lit(start).cast(kind).alias("start"), F.lit(None).cast(kind).alias("end"))
    return cut_lineage(routing.costs(edges, leg)).drop("leg")


def split_at(edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Edges (edge, ax, ay, bx, by) cut at the snapped places (edge, t in 0..1): pieces in order of t, without those of no length."""
    marks = snaps.select("edge", "t").union(edges.select("edge", F.lit(0.0))).union(edges.select("edge", F.lit(1.0))).distinct()
    w = Window.partitionBy("edge").orderBy("t")
    spans = marks.withColumn("t1", F.lead("t").over(w)).where("t1 > t").withColumnRenamed("t", "t0")
    at = lambda c, t: F.col(f"a{c}") + F.col(t) * (F.col(f"b{c}") - F.col(f"a{c}"))
    cut = spans.join(edges, "edge")
    return cut.select("edge", "t0", "t1", at("x", "t0").alias("ax"), at("y", "t0").alias("ay"), at("x", "t1").alias("bx"), at("y", "t1").alias("by"))


def closing_edges(near: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs (low, high, distance) of nearest ends, each once."""
    pairs = near.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "distance")
    return pairs.groupBy("low", "high").agg(F.min("distance").alias("distance"))
