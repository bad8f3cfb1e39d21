"""Explicit-schema readers for the segment pipeline's inputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.text import clean_code
from waymark.operators.temporal import ChangePlan
from waymark.schemas import CELLS, CONTROL_POINTS


class SourceError(ValueError):
    """An input breaks its contract."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header and this very schema; an empty cell is null, a malformed row fails."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=False)


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """Control points with their confidence trimmed and in lower case."""
    return read_csv(spark, path, CONTROL_POINTS).withColumn("confianza", clean_code(F.col("confianza")))


def with_row_numbers(frame: DataFrame, out: str, first: int = 0) -> DataFrame:
    """``frame``, straight from files, with the rows' numbers in the order of the files' names and their rows: places inside a split, and offsets from a count of each split."""
    split = ("__file", "__start")
    at = frame.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__at", F.monotonically_increasing_id())
    counts = at.groupBy(*split).agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    ahead = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = counts.select(*split, (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__from")).alias("__offset"))
    return at.join(offsets, [*split]).select(*frame.columns, (F.col("__at") + F.col("__offset") + first).alias(out))


def load_segment_keys(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """km_inicio and km_fin as whole numbers, start below end; ``expected``: the file must have exactly 0..n-1 by one kilometre, in this order.

    What is wrong is named with its row in the file, the header being row 1.
    """
    raw = spark.read.csv(path, header=True)
    if missing := {"km_inicio", "km_fin"} - set(raw.columns):
        raise SourceError(f"missing columns: {sorted(missing)}")
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    rows = with_row_numbers(raw, "row", 2).select("km_inicio", "km_fin", "row")
    whole = F.coalesce((number("km_inicio") == F.floor(number("km_inicio"))) & (number("km_fin") == F.floor(number("km_fin"))) & (number("km_inicio") < number("km_fin")), F.lit(False))
    if bad := rows.where(~whole).orderBy("row").limit(3).collect():
        raise SourceError(f"not whole or not ordered: {[f'row {r.row}: {r.km_inicio}, {r.km_fin}' for r in bad]}")
    keys = raw.select(number("km_inicio").cast("int").alias("km_inicio"), number("km_fin").cast("int").alias("km_fin"))
    if expected is not None:
        wrong = rows.where((number("km_inicio") != F.col("row") - 2) | (number("km_fin") != F.col("row") - 1)).orderBy("row").limit(3).collect()
        if wrong or keys.count() != expected:
            raise SourceError(f"the keys are not 0..{expected} by one in order: {[f'row {r.row}: {r.km_inicio}, {r.km_fin}' for r in wrong]}")
    return keys


def read_lines(spark: SparkSession, path: str, crs: str = "EPSG:4326", by_line: bool = False) -> DataFrame:
    """Vertices of the LineStrings of a GeoJSON Feature or FeatureCollection: line, seq, x, y, properties (as JSON) and crs.

    ``by_line``: a Feature on each line of the files, which are then split between tasks; ``line`` is 0 there, properties tell lines apart.
    """
    feature = "struct<type: string, geometry: struct<type: string, coordinates: array<array<double>>>, properties: string>"
    schema = f"type string, geometry struct<type: string, coordinates: array<array<double>>>, properties string, features array<{feature}>"
    read = spark.read.schema(schema).json(path, multiLine=not by_line)
    one = F.struct("type", "geometry", "properties")
    features = read.select(F.posexplode(F.coalesce("features", F.array(one))).alias("line", "f")).where("f.geometry.type = 'LineString'")
    vertices = features.select("line", F.posexplode("f.geometry.coordinates").alias("seq", "p"), F.col("f.properties").alias("properties"))
    return vertices.select("line", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "properties", F.lit(crs).alias("crs"))


def read_cells(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A raster band as a table of cells; ``glob``: only files of that name pattern, at least one."""
    reader = spark.read.schema(CELLS)
    found = (reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true") if glob else reader).parquet(path)
    if glob and not found.inputFiles():
        raise SourceError(f"no file matches {glob} under {path}")
    return found


def crop_cube(cube: DataFrame, lon: tuple[float, float], lat: tuple[float, float], start: str, end: str, slack: float = 1e-6) -> DataFrame:
    """The part of an hourly cube in a box and an inclusive time range; both conditions reach the scan."""
    box = F.col("longitude").between(lon[0] - slack, lon[1] + slack) & F.col("latitude").between(lat[0] - slack, lat[1] + slack)
    return cube.where(box & F.col("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def select_ways(ways: DataFrame, tag: str, pattern: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Ways (points: array of struct x, y) whose tag matches, with a point in the box (west, south, east, north) and two points or more."""
    west, south, east, north = box
    inside = F.exists("points", lambda p: p["x"].between(west, east) & p["y"].between(south, north))
    return ways.where(F.col(tag).rlike(pattern) & inside & (F.size("points") >= 2))


#: Where the settings of a published change run stand, and the plan's names for them.
_SETTINGS = {
    "metric": {"name": "metric", "unit": "unit", "higher_is_better": None},
    "timestamps": {n: n for n in ("baseline_at_utc", "current_at_utc", "ingested_at_utc")},
    "baseline_formula": {n: n for n in ("intercept", "multiplier", "modulus", "center", "scale")},
    "provenance": {n: n for n in ("fuente", "quality_flag", "notes")},
}


def load_plan(path: str, segments: int = 130) -> ChangePlan:
    """The change plan of a published JSON (or, with PyYAML, YAML) file. A run not marked as simulation only fails, and so do unknown names."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yml", ".yaml")):
            import yaml

            said = yaml.safe_load(file)
        else:
            said = json.load(file)
    if said.pop("simulation_only", None) is not True or said.pop("operational_use_allowed", None) is not False:
        raise SourceError("the run must say simulation_only = true and operational_use_allowed = false")
    made = {n: said.pop(n) for n in ("scenario_id", "schema_version", "default_delta_pattern") if n in said}
    try:
        for part, names in _SETTINGS.items():
            own = said.pop(part, {})
            made |= {names[n]: v for n, v in own.items() if names[n]}
        if "demonstration_zones" in said:
            made["demonstration_zones"] = [(int(z["km_inicio_min"]), int(z["km_inicio_max"]), float(z["delta"])) for z in said.pop("demonstration_zones")]
        if "uncertainty_half_width" in said:
            made["uncertainty"] = tuple(float(said["uncertainty_half_width"][n]) for n in ("baseline", "current"))
            said.pop("uncertainty_half_width")
        if "change_thresholds_abs" in said:
            made["thresholds"] = tuple(float(said["change_thresholds_abs"][n]) for n in ("stable_max", "minor_max", "moderate_max"))
            said.pop("change_thresholds_abs")
    except KeyError as name:
        raise SourceError(f"unknown or missing setting: {name}") from None
    if said:
        raise SourceError(f"unknown settings: {sorted(said)}")
    return ChangePlan(**made, segments=segments)


def grid_index(value: Column, origin: float, step: float) -> Column:
    """The whole-number index of a coordinate on a regular grid, whatever its last digits."""
    return F.round((value - origin) / step).cast("int")
