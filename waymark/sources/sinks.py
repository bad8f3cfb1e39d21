"""Deterministic sinks: ordered CSV, GeoJSON, cell tables, and regenerate-and-compare."""

from __future__ import annotations

import csv
import io
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(frame: DataFrame, path: str, keys: list[str], parts: int = 1) -> None:
    """Ordered parts with a header each, in order one after the other."""
    frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_sorted(frame: DataFrame, path: str, keys: list[str], partitions: int) -> None:
    """Range-partitioned parts that are in order one after the other, of any size."""
    frame.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def render_csv(frame: DataFrame, columns: list[str], keys: list[str], most: int = 100_000) -> str:
    """The same text for the same rows: fixed columns, key order, line feeds. Refuses more than ``most`` rows."""
    rows = frame.select(*columns).orderBy(*keys).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them in parts")
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(columns)
    out.writerows(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r] for r in rows)
    return text.getvalue()


def publish(text: str, path: str) -> None:
    """Written beside its place and moved there in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def is_current(text: str, path: str) -> bool:
    """True if the published file holds this very text."""
    try:
        with open(path, encoding="utf-8", newline="") as file:
            return file.read() == text
    except FileNotFoundError:
        return False


def features(vertices: DataFrame, line: str = "line", seq: str = "seq", properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature text for each line."""
    own = [F.first(c, ignorenulls=True).alias(c) for c in properties or []]
    points = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("x"), F.col("y")))), lambda p: F.array(p["x"], p["y"]))
    lines = vertices.groupBy(line).agg(points.alias("coordinates"), *own)
    shape = F.struct(F.lit("LineString").alias("type"), "coordinates")
    whole = F.struct(F.lit("Feature").alias("type"), F.struct(line, *(properties or [])).alias("properties"), shape.alias("geometry"))
    return lines.select(line, F.to_json(whole).alias("feature"))


def feature_collection(lines: DataFrame, line: str = "line", most: int = 100_000) -> str:
    """The features as one collection, in order. Refuses more than ``most``."""
    rows = lines.orderBy(line).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features: write them in parts")
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}\n"


def write_cells(cells: DataFrame, path: str, block: int = 512) -> None:
    """Cells in square blocks, so that a window of the raster reads few files."""
    blocks = cells.withColumns({"block_row": F.floor(F.col("row") / block), "block_col": F.floor(F.col("col") / block)})
    blocks.repartition("block_row", "block_col").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("block_row", "block_col").parquet(path)
