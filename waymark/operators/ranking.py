"""Global order statistics that do not sort the table in one task.

Ranks and quantiles over a whole table have no partition key. Values are dealt to
buckets by bounds from an approximate quantile sketch; equal values share a
bucket, so a rank is the number of rows in better buckets plus the rank inside
its own. Only the bounds and one count a bucket are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.quantiles import HELD, grouped_quantiles

#: Rows of a bucket; buckets at most.
BUCKET, BUCKETS = 250_000, 512


def _bucket(value: Column, bounds: list[float]) -> Column:
    """Number of bounds below the value, by halving (nulls go first)."""
    def half(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value > bounds[m], half(m + 1, b)).otherwise(half(a, m))

    return F.when(value.isNull(), F.lit(-1)).otherwise(half(0, len(bounds)))


def _bounds(frame: DataFrame, value: Column, buckets: int | None) -> list[float]:
    """Sketched bounds of as many buckets as the table's rows ask for."""
    buckets = buckets or min(BUCKETS, frame.count() // BUCKET + 1)
    if buckets == 1:
        return []
    return sorted(set(frame.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []))


def with_rank_within(frame: DataFrame, by: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """``out``: min rank of ``value`` in each group of ``by`` (1 = highest; nulls last), where a group may be as large as the table."""
    bounds = _bounds(frame, F.col(value).cast("double"), buckets)
    dealt = frame.withColumn("__bucket", _bucket(F.col(value).cast("double"), bounds))
    ahead = Window.partitionBy(*by).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*by, "__bucket").count().withColumn("__before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    inside = F.rank().over(Window.partitionBy(*by, "__bucket").orderBy(F.desc_nulls_last(value)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__bucket")]
    met = dealt.withColumn(out, inside).alias("a").join(before.alias("b"), same)
    return met.select(*(F.col(f"a.{c}") for c in frame.columns), (F.col(f"a.{out}") + F.col("b.__before")).cast("int").alias(out))


def with_global_rank(frame: DataFrame, value: str, out: str, descending: bool = True, peers: str | None = None, rows: str | None = None, buckets: int | None = None) -> DataFrame:
    """``out``: min rank of ``value`` (1 = best; null values come last). ``peers``, ``rows``: also the number of equal values, and of all values."""
    column = F.col(value).cast("double")
    bounds = _bounds(frame, column, buckets)
    dealt = frame.withColumn("__bucket", _bucket(column, bounds))
    counts = {r[0]: r[1] for r in dealt.groupBy("__bucket").count().collect()}
    keys = sorted(counts, key=lambda k: (k < 0, -k if descending else k))
    before, at = {}, 0
    for k in keys:
        before[k] = at
        at += counts[k]
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    offset = F.element_at(F.create_map(*(F.lit(x) for k in keys for x in (k, before[k]))), F.col("__bucket")) if keys else F.lit(0)
    ranked = dealt.withColumn(out, (offset + F.rank().over(Window.partitionBy("__bucket").orderBy(order))).cast("int"))
    if peers:
        ranked = ranked.withColumn(peers, F.count("*").over(Window.partitionBy("__bucket", value)))
    if rows:
        ranked = ranked.withColumn(rows, F.lit(sum(n for k, n in counts.items() if k >= 0)))
    return ranked.drop("__bucket")


def exact_quantiles(frame: DataFrame, wanted: dict[str, list[float]], held: int = HELD) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of whole columns, nulls left out; see ``quantiles`` for how their buffers stay bounded."""
    named = {c: {f"q{i}_{k}": p for k, p in enumerate(ps)} for i, (c, ps) in enumerate(wanted.items())}
    row = grouped_quantiles(frame, [], [(F.col(c), own) for c, own in named.items()], held).first()
    return {c: [row[n] if row else None for n in own] for c, own in named.items()}
