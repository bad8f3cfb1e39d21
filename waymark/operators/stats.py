"""Summaries, contrasts, errors and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.quantiles import summarised
from waymark.operators.ranking import with_global_rank


def level_summary(frame: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median, least and most of ``value`` for each level, the null level too."""
    v = F.col(value)
    plain = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most")]
    return summarised(frame, [by], plain, [(v, {"median": 0.5})]).select(by, "n", "mean", "median", "least", "most")


def cohort_contrast(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each (flag, value): n, mean and median with and without the flag, and the difference of the means; one pass for all."""
    plain, wanted, rows = [], [], []
    for i, (flag, value) in enumerate(pairs):
        on, off = (F.when(F.col(flag) == k, F.col(value)) for k in (1, 0))
        plain += [F.count(on).alias(f"n1_{i}"), F.count(off).alias(f"n0_{i}"), F.avg(on).alias(f"m1_{i}"), F.avg(off).alias(f"m0_{i}")]
        wanted += [(on, {f"q1_{i}": 0.5}), (off, {f"q0_{i}": 0.5})]
        told = {"n_with": "n1", "n_without": "n0", "mean_with": "m1", "mean_without": "m0", "median_with": "q1", "median_without": "q0"}
        difference = (F.col(f"m1_{i}") - F.col(f"m0_{i}")).alias("difference")
        rows.append(F.struct(F.lit(value).alias("dimension"), *(F.col(f"{c}_{i}").alias(name) for name, c in told.items()), difference))
    return summarised(frame, [], plain, wanted).select(F.inline(F.array(*rows)))


def describe_exact(frame: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, least, quartiles and most of each column; one pass for all columns, and one for the quartiles."""
    plain, wanted, rows = [], [], []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        told = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "least": F.min(v), "most": F.max(v)}
        plain += [x.alias(f"{name}_{i}") for name, x in told.items()]
        wanted.append((v, {f"q25_{i}": 0.25, f"q50_{i}": 0.5, f"q75_{i}": 0.75}))
        rows.append(F.struct(F.lit(c).alias("feature"), *(F.col(f"{name}_{i}").alias(name) for name in ("n", "mean", "std", "least", "q25", "q50", "q75", "most"))))
    return summarised(frame, [], plain, wanted).select(F.inline(F.array(*rows)))


def error_metrics(frame: DataFrame, model: str, truth: str) -> DataFrame:
    e = F.col(model) - F.col(truth)
    return frame.where(F.col(model).isNotNull() & F.col(truth).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_abs")
    )


def value_counts(frame: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    kept = frame if nulls else frame.where(F.col(column).isNotNull())
    return kept.groupBy(column).agg(F.count("*").alias("n"))


def null_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns feature and n_null, in one pass."""
    counts = frame.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_null")) for c in columns))))


def threshold_sweep(frame: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold, in one pass."""
    counts = frame.agg(*(F.count_if(F.col(value) >= t).alias(f"t{k}") for k, t in enumerate(thresholds)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("n")) for k, t in enumerate(thresholds)))))


def top_share(frame: DataFrame, value: str, n: int) -> DataFrame:
    """Percent of the total that the ``n`` largest hold."""
    best = frame.select(value).orderBy(F.desc_nulls_last(value)).limit(n).agg(F.sum(value).alias("top"))
    return best.join(F.broadcast(frame.agg(F.sum(value).alias("whole")))).select((100 * F.col("top") / F.col("whole")).alias("share_pct"))


def top_capture(frame: DataFrame, score: str, flag: str, tops: list[int]) -> DataFrame:
    """Share of flagged rows among the ``n`` best ranks, beside the base rate over all rows."""
    ranked = with_global_rank(frame, score, "__rank")
    sums = ranked.agg(F.avg(flag).alias("base_rate"), *(F.avg(F.when(F.col("__rank") <= n, F.col(flag))).alias(f"t{n}") for n in tops))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("top"), F.col(f"t{n}").alias("capture"), F.col("base_rate")) for n in tops))))


def class_capture(frame: DataFrame, by: str, flag: str) -> DataFrame:
    """Share of flagged rows in each class, beside the base rate over all rows, in one pass over the table."""
    sums = frame.groupBy(by).agg(F.sum(flag).alias("hits"), F.count(flag).alias("n"))
    whole = sums.agg((F.sum("hits") / F.sum("n")).alias("base_rate"))
    return sums.join(F.broadcast(whole)).select(by, (F.col("hits") / F.col("n")).alias("capture"), "base_rate")
