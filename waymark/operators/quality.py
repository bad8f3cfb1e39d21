"""Gates: frames of violations, and a wrapper that fails fast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailure(ValueError):
    """A table broke its contract."""


def require_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in frame.columns]:
        raise GateFailure(f"missing columns: {missing}")
    return frame


def forbid_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    if clash := [c for c in columns if c in frame.columns]:
        raise GateFailure(f"columns that are there already: {clash}")
    return frame


def summary(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and n: the rows that break each row rule (a rule that is unknown counts as broken), in one pass."""
    counts = frame.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{k}") for k, ok in enumerate(rules.values())))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("n")) for k, name in enumerate(rules)))))


def row_count(frame: DataFrame, wanted: int, rule: str = "row_count") -> DataFrame:
    """rule and n: by how many rows the table misses the wanted number."""
    return frame.agg(F.lit(rule).alias("rule"), F.abs(F.count("*") - wanted).alias("n"))


def finite(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(frame: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with problem: missing or unexpected."""
    lost = expected.select(*keys).join(frame, keys, "left_anti").withColumn("problem", F.lit("missing"))
    more = frame.select(*keys).join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lost.union(more)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys), keys, "left_anti")


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 5e-10) -> DataFrame:
    """Keys whose values differ by more than ``tolerance``, or that only one side has."""
    other = b.select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__there"))
    both = a.select(*keys, *values, F.lit(True).alias("__here")).join(other, keys, "full")
    same = reduce(lambda x, y: x & y, (F.col(v).eqNullSafe(F.col(f"__{v}")) | F.coalesce(F.abs(F.col(v) - F.col(f"__{v}")) <= tolerance, F.lit(False)) for v in values))
    return both.where(F.col("__here").isNull() | F.col("__there").isNull() | ~same).select(*keys)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fail_on(violations: DataFrame, name: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise GateFailure(f"{name}: {[r.asDict() for r in rows]}")


def fingerprint(frame: DataFrame, keys: list[str], most: int = 100_000) -> str:
    """SHA-256 over the rows' digests in key order, for published products. Refuses more than ``most`` rows."""
    if frame.limit(most + 1).count() > most:
        raise GateFailure(f"more than {most} rows")
    rows = frame.select(*keys, F.sha2(F.to_json(F.struct(*frame.columns)), 256).alias("__h")).orderBy(*keys)
    return rows.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(*keys, "__h"))), lambda r: r["__h"])), 256)).first()[0]
