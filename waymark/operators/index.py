"""Robust scaling, composite index, ranking and quantile classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.ranking import exact_quantiles, with_global_rank
from waymark.schemas import CLASSES


def scaler_params(frame: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> dict[str, tuple[float, float]]:
    """The winsorising bounds of each column. Bounds that are the same to 1e-5 raise."""
    found = exact_quantiles(frame, {c: [low, high] for c in columns})
    for column, (a, b) in found.items():
        if a is None or abs(a - b) <= 1e-8 + 1e-5 * abs(b):
            raise ValueError(f"{column} has no spread between its quantiles {low} and {high}")
    return {c: (a, b) for c, (a, b) in found.items()}


def params_frame(frame: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """The scaler's parameters as a published table."""
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(a).alias("p_low"), F.lit(b).alias("p_high")) for c, (a, b) in params.items()]
    return frame.sparkSession.range(1).select(F.inline(F.array(*rows)))


def scaled(value: Column, low: float, high: float) -> Column:
    """Clipped to the bounds and mapped to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low))


def composite(frame: DataFrame, groups: dict[str, list[str]], logs: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """Scaled columns (``*_norm``), a mean for each group, and the mean of the groups times 100 as ``out``. ``logs``: columns taken as log1p."""
    columns = [c for own in groups.values() for c in own]
    ready = frame.withColumns({f"__{c}": F.log1p(c) if c in logs else F.col(c).cast("double") for c in columns})
    params = scaler_params(ready, [f"__{c}" for c in columns])
    ready = ready.withColumns({f"{c}_norm": scaled(F.col(f"__{c}"), *params[f"__{c}"]) for c in columns}).drop(*(f"__{c}" for c in columns))
    mean = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    ready = ready.withColumns({g: mean([f"{c}_norm" for c in own]) for g, own in groups.items()})
    return ready.withColumn(out, mean(list(groups)) * 100)


def quantile_class(frame: DataFrame, value: str, out: str, labels: tuple[str, ...] = CLASSES, places: int | None = None) -> DataFrame:
    """Right-closed classes between interpolated quantiles, the lowest value included. Equal edges raise. ``places``: compare values and edges rounded."""
    n = len(labels)
    edges = exact_quantiles(frame, {value: [k / n for k in range(n + 1)]})[value]
    if len(set(edges)) <= n:
        raise ValueError(f"the quantile edges of {value} are not all different")
    column = F.col(value)
    if places is not None:
        column, edges = F.round(column, places), [round(e, places) for e in edges]
    kind = F.lit(labels[-1])
    for label, edge in reversed(list(zip(labels[:-1], edges[1:-1], strict=True))):
        kind = F.when(column <= edge, F.lit(label)).otherwise(kind)
    return frame.withColumn(out, F.when(column.isNotNull(), kind))


def percentile_rank(frame: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank among the values times 100 over their number; null for nulls."""
    ranked = with_global_rank(frame, value, "__rank", descending=False, peers="__peers", rows="__rows")
    share = (F.col("__rank") + (F.col("__peers") - 1) / 2) / F.col("__rows") * 100
    return ranked.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop("__rank", "__peers", "__rows")


def dominant(columns: list[str]) -> Column:
    """The name of the largest column, the first of equal ones."""
    best = F.greatest(*columns)
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) == best, F.lit(c)).otherwise(name)
    return name


def top_drivers(columns: list[str], n: int = 2) -> Column:
    """The ``n`` largest columns as structs (value, name), larger names first on ties; nulls and NaN are no drivers, so there may be fewer."""
    known = F.filter(F.array(*(F.struct(F.col(c).cast("double").alias("value"), F.lit(c).alias("name")) for c in columns)), lambda d: d["value"].isNotNull() & ~F.isnan(d["value"]))
    return F.slice(F.reverse(F.array_sort(known)), 1, n)
