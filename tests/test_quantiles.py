"""Grouped exact quantiles against numpy, with groups far beyond the held values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import quantiles
from waymark.operators.quantiles import grouped_quantiles, summarised
from waymark.operators.stats import cohort_contrast, describe_exact, level_summary

PS = [0.0, 0.05, 0.31, 0.5, 0.9, 0.95, 1.0]


def rows_of(seed, n):
    rng = random.Random(seed)
    draw = {"hot": lambda: rng.random() * 1e6, "ties": lambda: rng.choice([1.0, 1.0, 2.0]), "ends": lambda: rng.choice([-1e300, 1e300, rng.gauss(0, 1)]), None: lambda: rng.expovariate(1), "few": lambda: 5.0}
    rows = [(g, draw[g]() if rng.random() > 0.05 else None) for g in rng.choices(["hot", "ties", "ends", None], [8, 2, 2, 1], k=n)]
    return [*rows, ("few", 5.0), ("few", None), ("none", None)]


@pytest.mark.parametrize("held", [10**9, 700, 40])
def test_against_numpy(spark, held):
    rows = rows_of(3, 6_000)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = grouped_quantiles(frame, ["g"], [(F.col("v"), {f"q{k}": p for k, p in enumerate(PS)}), (-F.col("v"), {"low": 0.25})], held).collect()
    assert {r.g for r in found} == {"hot", "ties", "ends", None, "few"}
    for r in found:
        own = np.array([v for g, v in rows if g == r.g and v is not None])
        assert [r[f"q{k}"] for k in range(len(PS))] == pytest.approx(np.quantile(own, PS).tolist(), rel=1e-12)
        assert r.low == pytest.approx(np.quantile(-own, 0.25), rel=1e-12)


def test_two_keys_and_clashing_names(spark):
    frame = spark.range(5_000).select((F.col("id") % 2).alias("key"), F.lit("x").alias("group"), F.col("id").alias("v"), F.col("id").alias("slot"))
    found = grouped_quantiles(frame, ["key", "group"], [(F.col("slot"), {"n": 0.5})], 100).collect()
    assert sorted((r.key, r.group, r.n) for r in found) == [(0, "x", 2499.0), (1, "x", 2500.0)]


def test_no_buffer_beyond_the_bound(spark, monkeypatch):
    """One group with all rows: no aggregate sees it, and each round hands on less than a hundredth."""
    sizes, brackets = [], quantiles._bracketed

    def watched(rows, targets):
        sizes.append((rows.count(), targets.count()))
        return brackets(rows, targets)

    monkeypatch.setattr(quantiles, "_bracketed", watched)
    frame = spark.range(400_000).select(F.lit(1).alias("g"), F.hash("id").cast("double").alias("v"))
    got = grouped_quantiles(frame, ["g"], [(F.col("v"), {"a": 0.5, "b": 0.999})], 200).first()
    own = np.array([r.v for r in frame.select("v").toLocalIterator()])
    assert [got.a, got.b] == pytest.approx(np.quantile(own, [0.5, 0.999]).tolist(), rel=1e-12)
    assert len(sizes) > 1 and all(n <= 400_000 * 0.01 * targets for n, targets in sizes[1:])


def test_groups_and_columns_without_values(spark):
    frame = spark.createDataFrame([("a", None, 1.0), ("b", None, None)], "g string, v double, w double")
    found = summarised(frame, ["g"], [F.count("v").alias("n")], [(F.col("v"), {"q": 0.5}), (F.col("w"), {"r": 0.5})]).collect()
    assert sorted(map(tuple, found)) == [("a", 0, None, 1.0), ("b", 0, None, None)]
    assert grouped_quantiles(frame.limit(0), ["g"], [(F.col("v"), {"q": 0.5})]).collect() == []
    assert [tuple(r) for r in summarised(frame.limit(0), [], [F.count("v").alias("n")], [(F.col("v"), {"q": 0.5})]).collect()] == [(0, None)]


def test_summaries_keep_their_columns(spark):
    frame = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 4.0), (None, 1, 9.0)], "g string, f int, v double")
    assert sorted(map(tuple, level_summary(frame, "g", "v").collect()), key=str) == [("a", 2, 3.0, 3.0, 2.0, 4.0), (None, 1, 9.0, 9.0, 9.0, 9.0)]
    assert [tuple(r) for r in cohort_contrast(frame, [("f", "v")]).collect()] == [("v", 2, 1, 5.5, 4.0, 5.5, 4.0, 1.5)]
    assert [r.q50 for r in describe_exact(frame, ["v", "f"]).collect()] == [4.0, 1.0]


def test_few_unlike_values_are_counted(spark, monkeypatch):
    """A large group of few unlike values never goes through the brackets, and no join brings its rows to the task of its key."""
    monkeypatch.setattr(quantiles, "_ranked", None)
    frame = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 40).cast("double").alias("v"))
    found = grouped_quantiles(frame, ["g"], [(F.col("v"), {f"q{k}": p for k, p in enumerate(PS)})], 1_000)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rows = frame.collect()
    for r in found.collect():
        own = [x.v for x in rows if x.g == r.g]
        assert [r[f"q{k}"] for k in range(len(PS))] == pytest.approx(np.quantile(own, PS).tolist(), rel=1e-12)
