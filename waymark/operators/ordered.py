"""Order along lines of any length: neighbours, running sums and next matches without a line in one task.

Rows are dealt by ranges of (line, place), so a slice holds a stretch of one or of some lines and a long line is cut into many slices. What a
slice can't know by itself, the row behind its last one, the sum ahead of it, the next match, comes from a table with a row for each
slice and line, which is joined back. Windows go over a slice's rows, and over the slices of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage

SLICE = "__slice"


def sliced(frame: DataFrame, line: str, *places: str, parts: int | None = None) -> DataFrame:
    """``frame`` with its slice, in ranges of (line, places); ``parts`` of them, or as many as Spark deals."""
    keys = [F.col(f"`{c}`") for c in (line, *places)]
    dealt = frame.repartitionByRange(parts, *keys) if parts else frame.repartitionByRange(*keys)
    return cut_lineage(dealt.sortWithinPartitions(*keys).withColumn(SLICE, F.spark_partition_id()))


def _inside(line: str, *places: str | Column):
    return Window.partitionBy(line, SLICE).orderBy(*places)


def _joined(rows: DataFrame, told: DataFrame, line: str) -> DataFrame:
    """``rows`` with what is ``told`` of their slice and line (null lines too)."""
    named = told.withColumnsRenamed({line: "__line", SLICE: "__s"})
    met = rows.join(named, F.col(line).eqNullSafe(F.col("__line")) & (F.col(SLICE) == F.col("__s")), "left")
    return met.drop("__line", "__s")


def with_next(rows: DataFrame, line: str, place: str, columns: list[str], out: str) -> DataFrame:
    """Sliced ``rows`` with ``columns`` of the next row of their line as the struct ``out``, null at a line's end."""
    own = F.struct(*columns)
    first = rows.groupBy(line, SLICE).agg(F.min_by(own, place).alias("__own"))
    behind = first.withColumn("__behind", F.lead("__own").over(Window.partitionBy(line).orderBy(SLICE))).drop("__own")
    inner = rows.withColumn("__inner", F.lead(own).over(_inside(line, place)))
    return _joined(inner, behind, line).withColumn(out, F.coalesce("__inner", "__behind")).drop("__inner", "__behind")


def with_previous(rows: DataFrame, line: str, place: str, columns: list[str], out: str) -> DataFrame:
    """As ``with_next``, of the row before."""
    own = F.struct(*columns)
    last = rows.groupBy(line, SLICE).agg(F.max_by(own, place).alias("__own"))
    ahead = last.withColumn("__ahead", F.lag("__own").over(Window.partitionBy(line).orderBy(SLICE))).drop("__own")
    inner = rows.withColumn("__inner", F.lag(own).over(_inside(line, place)))
    return _joined(inner, ahead, line).withColumn(out, F.coalesce("__inner", "__ahead")).drop("__inner", "__ahead")


def with_running_sum(rows: DataFrame, line: str, place: str, value: str, out: str) -> DataFrame:
    """Sliced ``rows`` with the sum of ``value`` along their line up to and with them."""
    sums = rows.groupBy(line, SLICE).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(line).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0.0))).drop("__sum")
    inner = rows.withColumn("__upto", F.sum(value).over(_inside(line, place).rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(inner, before, line).withColumn(out, F.col("__before") + F.col("__upto")).drop("__before", "__upto")


def next_match(asked: DataFrame, there: DataFrame, line: str, at: Column, ends: Column, out: str, parts: int | None = None) -> DataFrame:
    """``asked`` with the first row of ``there``, as the struct ``out``, whose ``ends`` on the line is at ``at`` or behind it; null if there is none.

    Both sides are dealt together by their places, so neither a dense stretch nor a long row makes a hot key.
    """
    mine, theirs = F.struct(*(F.col(f"`{c}`") for c in asked.columns)), F.struct(*(F.col(f"`{c}`") for c in there.columns))
    both = asked.select(F.col(line).alias("__l"), at.cast("double").alias("__at"), F.lit(0).alias("__kind"), mine.alias("__mine"), F.lit(None).cast(there.select(theirs.alias("x")).schema["x"].dataType).alias("__theirs"))
    rows = both.unionByName(there.select(F.col(line).alias("__l"), ends.cast("double").alias("__at"), F.lit(1).alias("__kind"), theirs.alias("__theirs")), allowMissingColumns=True)
    rows = sliced(rows, "__l", "__at", "__kind", parts=parts)
    # from a slice's end towards its start: frames that grow with the rows are one pass, frames up to the end would be one for each row
    ahead = _inside("__l", F.desc("__at"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.where("__kind = 1").groupBy("__l", SLICE).agg(F.min_by("__theirs", "__at").alias("__first"))
    every = rows.select("__l", SLICE).distinct().join(first.withColumnsRenamed({"__l": "__k", SLICE: "__s"}), F.col("__l").eqNullSafe(F.col("__k")) & (F.col(SLICE) == F.col("__s")), "left").drop("__k", "__s")
    later = Window.partitionBy("__l").orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    behind = every.withColumn("__behind", F.last("__first", ignorenulls=True).over(later)).drop("__first")
    found = _joined(rows.withColumn("__inner", F.last("__theirs", ignorenulls=True).over(ahead)), behind, "__l").where("__kind = 0")
    return found.select("__mine.*", F.coalesce("__inner", "__behind").alias(out))
