import random

import numpy as np
import pytest

from waymark.operators.index import composite, percentile_rank, quantile_class, scaler_params
from waymark.operators.ranking import exact_quantiles, with_global_rank


def frame_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")


VALUES = [float(x) for x in [3, 1, 2, 2, 2, 9, -4, 0, 0, 7, 7, 7, 7]] + [None, None]


@pytest.mark.parametrize("buckets", [1, 2, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_with_ties_and_nulls(spark, buckets, descending):
    got = {r.id: r.k for r in with_global_rank(frame_of(spark, VALUES), "v", "k", descending, buckets=buckets).collect()}
    for i, v in enumerate(VALUES):
        better = sum(w is not None and (v is None or (w > v if descending else w < v)) for w in VALUES)
        assert got[i] == better + 1


def test_percentile_rank_averages_ties(spark):
    got = {r.id: r.p for r in percentile_rank(frame_of(spark, VALUES), "v", "p").collect()}
    some = [v for v in VALUES if v is not None]
    for i, v in enumerate(VALUES):
        want = None if v is None else (sum(w < v for w in some) + (sum(w == v for w in some) + 1) / 2) / len(some) * 100
        assert got[i] == pytest.approx(want)
    assert percentile_rank(frame_of(spark, []), "v", "p").collect() == []


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_exact_quantiles_by_bracketing(spark, held):
    rng = random.Random(4)
    values = [rng.choice([0.0, 1.0, rng.random() * 100]) for _ in range(1500)]
    ps = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    got = exact_quantiles(frame_of(spark, [*values, None]), {"v": ps}, held)["v"]
    assert got == pytest.approx(np.quantile(values, ps).tolist(), rel=1e-12)
    assert exact_quantiles(frame_of(spark, [None]), {"v": [0.5]}, held) == {"v": [None]}


def test_scaler_needs_spread(spark):
    with pytest.raises(ValueError, match="spread"):
        scaler_params(frame_of(spark, [5.0] * 20), ["v"])
    with pytest.raises(ValueError, match="edges"):
        quantile_class(frame_of(spark, [1.0] * 20 + [2.0]), "v", "c")


def test_composite_is_the_mean_of_means(spark):
    rows = spark.range(101).selectExpr("id", "double(id) AS a", "double(100 - id) AS b", "exp(id / 20.0) - 1 AS c")
    got = {r.id: r for r in composite(rows, {"g": ["a", "b"], "h": ["c"]}, logs=("c",)).collect()}
    assert got[0].g == pytest.approx(0.5) and got[50].h == pytest.approx(0.5) and got[50].score == pytest.approx(50)
    assert got[0].a_norm == 0 and got[100].a_norm == 1


def test_classes_are_right_closed(spark):
    rows = frame_of(spark, [float(x) for x in range(11)] + [None])
    got = {r.v: r.c for r in quantile_class(rows, "v", "c", labels=tuple("abcde")).collect()}
    assert [got[float(x)] for x in range(11)] == list("aaabbccddee") and got[None] is None
