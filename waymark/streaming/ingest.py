"""Append-only ingestion of snapshots with corrections, and day windows, as streams.

At every stop of a stream ``current`` over what it has written is the batch operator ``temporal.latest`` over what it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.operators import temporal


def corrections(shots: DataFrame) -> DataFrame:
    """The changes of a stream of snapshots: every version that is ingested later than all that were met of its logical key.

    The columns of ``shots`` and change (``new`` or ``correction``) and replaces (when the version before was ingested). Repeated versions and
    versions ingested earlier than one already met say nothing new, however late they come. Of versions ingested at the same time the
    one with the greater text holds, as in ``temporal.latest``. The state has one time and one digest for each key and is not forgotten, since
    a correction may come at any time; it is spread by key.
    """
    told = shots.withColumns({"__at": F.unix_micros("ingested_at_utc"), "__text": temporal.version_text(shots)})
    out = T.StructType([*shots.schema.fields, T.StructField("change", T.StringType()), T.StructField("replaces", T.LongType())])

    def newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["__at", "__text"], kind="stable")
        met = (rows["__at"].tolist(), rows["__text"].tolist())
        last = state.get if state.exists else None
        kept, changes, replaces = [], [], []
        for i, version in enumerate(zip(*met, strict=True)):
            if last is None or version > tuple(last):
                kept.append(i)
                changes.append("correction" if last else "new")
                replaces.append(last[0] if last else None)
                last = version
        if kept:
            state.update(last)
            found = rows.iloc[kept].drop(columns=["__at", "__text"])
            yield found.assign(change=changes, replaces=pd.array(replaces, dtype="Int64"))[[f.name for f in out]]

    grouped = told.where(F.col("__at").isNotNull()).groupBy(*temporal.LOGICAL_KEY)
    found = grouped.applyInPandasWithState(newer, out, "at long, text string", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("replaces", F.timestamp_micros("replaces"))


def keep(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``changes`` to a folder for each batch under ``path``, over all that is there now: a batch that runs again after a failure replaces its own folder."""

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions kept under ``path``, with the batch that brought them."""
    return spark.read.parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each logical key under ``path``, with the columns of the snapshots."""
    return temporal.latest(versions(spark, path).drop("batch", "change", "replaces"))


def daily_totals(events: DataFrame, ts: str, by: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Day windows of an event stream: least, most, total and n. ``ts`` without a zone counts as the session's."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    days = timed.groupBy(F.window(ts, "1 day"), *by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return days.select(F.to_date("window.start").alias("day"), *by, "least", "most", "total", "n")


def append(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To parquet, exactly once, over all that is there now."""
    return frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
