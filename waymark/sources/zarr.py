"""Chunked cubes (Zarr, version 2) as rows, planned from their metadata.

The driver reads the metadata and the three axes. Times and box choose the chunks: only those with a cell in both are dealt to tasks,
and no other is opened. Each task inflates its chunk and hands on the cells inside, as latitude, longitude, ts, variable and value. The fill
value, NaN and chunks without a file are null; scale and offset attributes are applied.

Read: dimensions time, latitude and longitude in any order (valid_time, lat and lon too), C order, zlib, gzip or no compression, no filters. What else
there is is refused. Writing deals cells to tasks by chunk, and each task writes its own chunk files under their final names at once.
"""

from __future__ import annotations

import gzip
import itertools
import json
import os
import uuid
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.sources.readers import SourceError

SCHEMA = "latitude double, longitude double, ts timestamp, variable string, value double"
#: Names of the axes, and micros of the units of time.
AXES = {"time": "time", "valid_time": "time", "latitude": "latitude", "lat": "latitude", "longitude": "longitude", "lon": "longitude"}
_MICROS = {"seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6}
_ORDER = ("time", "latitude", "longitude")


def plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _bytes(path: str) -> bytes | None:
    """A file's bytes; None if it isn't there."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    with system.open_input_stream(name) as file:
        return file.read()


@dataclass
class Array:
    """One array's metadata."""

    path: str

    def __post_init__(self):
        raw = _bytes(f"{self.path}/.zarray")
        if raw is None:
            raise SourceError(f"{self.path} is no array of version 2")
        said = json.loads(raw)
        self.attributes = json.loads(_bytes(f"{self.path}/.zattrs") or b"{}")
        kind = (said["compressor"] or {}).get("id")
        if said["zarr_format"] != 2 or kind not in (None, "zlib", "gzip") or said["order"] != "C" or said.get("filters"):
            raise SourceError(f"{self.path}: compressor {kind}, order {said['order']} or filters are not read")
        self.shape, self.chunks, self.dtype, self.fill = said["shape"], said["chunks"], np.dtype(said["dtype"]), said["fill_value"]
        self.inflate = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[kind]
        self.mark = said.get("dimension_separator", ".")

    def chunk(self, index: tuple[int, ...]) -> np.ndarray | None:
        """A chunk's values, at its full size; None if it has no file."""
        raw = _bytes(f"{self.path}/{self.mark.join(map(str, index))}")
        return None if raw is None else np.frombuffer(self.inflate(raw), self.dtype).reshape(self.chunks)

    def line(self) -> np.ndarray:
        """All values of an array of one dimension, such as an axis."""
        parts = [self.chunk((k,)) for k in range(-(-self.shape[0] // self.chunks[0]))]
        return np.concatenate(parts)[: self.shape[0]] if parts else np.zeros(0, self.dtype)


def _micros(axis: Array) -> np.ndarray:
    """A time axis in micros since 1970, by its units."""
    unit, _, start = axis.attributes["units"].partition(" since ")
    if unit not in _MICROS:
        raise SourceError(f"times in {unit} are not read")
    begin = datetime.fromisoformat(start.replace("Z", "+00:00"))
    begin = begin if begin.tzinfo else begin.replace(tzinfo=UTC)
    return (axis.line().astype(np.float64) * _MICROS[unit]).round().astype(np.int64) + int(begin.timestamp() * 10**6)


def _span(inside: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """The chunks of one axis with a place inside, and their places."""
    places = np.flatnonzero(inside)
    return [(int(k), places[places // size == k]) for k in np.unique(places // size)]


class _Chunk(InputPartition):
    def __init__(self, variable: str, index: tuple[int, ...], places: list[np.ndarray]):
        self.variable, self.index, self.places = variable, index, places


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.asked = options["path"], json.loads(options["asked"])

    def _cube(self, variable: str) -> tuple[Array, list[str], dict[str, np.ndarray]]:
        cube = Array(f"{self.path}/{variable}")
        names = cube.attributes.get("_ARRAY_DIMENSIONS", [])
        kinds = [AXES.get(n) for n in names]
        if sorted(map(str, kinds)) != sorted(_ORDER):
            raise SourceError(f"{variable} has dimensions {names}")
        axes = {kind: _micros(Array(f"{self.path}/{n}")) if kind == "time" else Array(f"{self.path}/{n}").line().astype(np.float64) for n, kind in zip(names, kinds, strict=True)}
        return cube, kinds, axes

    def partitions(self):
        out, slack = [], self.asked["slack"]
        ends = {"time": self.asked["time"], **{k: v and [v[0] - slack, v[1] + slack] for k, v in self.asked["box"].items()}}
        for variable in self.asked["variables"]:
            cube, kinds, axes = self._cube(variable)
            inside = {k: np.ones(len(x), bool) if not ends[k] else (x >= ends[k][0]) & (x <= ends[k][1]) for k, x in axes.items()}
            spans = [_span(inside[k], size) for k, size in zip(kinds, cube.chunks, strict=True)]
            out += [_Chunk(variable, tuple(i for i, _ in own), [p for _, p in own]) for own in itertools.product(*spans)]
        return out or [_Chunk("", (), [])]

    def read(self, partition):
        if not partition.variable:
            return
        cube, kinds, axes = self._cube(partition.variable)
        laid = cube.chunk(partition.index)
        inner = [p - i * size for p, i, size in zip(partition.places, partition.index, cube.chunks, strict=True)]
        shape = tuple(map(len, inner))
        values = np.full(shape, np.nan) if laid is None else laid[np.ix_(*inner)].astype(np.float64)
        if laid is not None:
            for fill in (cube.fill, cube.attributes.get("_FillValue")):
                if fill is not None and fill != "NaN":
                    values[laid[np.ix_(*inner)] == cube.dtype.type(fill)] = np.nan
            values = values * cube.attributes.get("scale_factor", 1.0) + cube.attributes.get("add_offset", 0.0)
        at = {k: np.broadcast_to(axes[k][p].reshape([-1 if d == n else 1 for d in range(3)]), shape).ravel() for n, (k, p) in enumerate(zip(kinds, partition.places, strict=True))}
        flat = values.ravel()
        arrays = [
            pa.array(at["latitude"]), pa.array(at["longitude"]), pa.array(at["time"], pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array([partition.variable] * len(flat), pa.string()), pa.array(flat, mask=np.isnan(flat)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


class Zarr(DataSource):
    """``spark.read.format("chunked_cube")``; use ``read``, which fills its options."""

    @classmethod
    def name(cls) -> str:
        return "chunked_cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _at(text: str) -> int:
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return round((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 10**6)


def read(spark: SparkSession, path: str, variables: list[str], start: str | None = None, end: str | None = None, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, slack: float = 1e-6) -> DataFrame:
    """The cells of ``variables`` between two ISO times (UTC, both included) and in a box."""
    spark.dataSource.register(Zarr)
    times = [_at(start) if start else -(2**62), _at(end) if end else 2**62]
    asked = {"variables": variables, "time": times, "box": {"latitude": lat, "longitude": lon}, "slack": slack}
    return spark.read.format("chunked_cube").options(path=plain(path), asked=json.dumps(asked)).load()


def planned(path: str, variables: list[str], **asked) -> list[tuple[str, tuple[int, ...]]]:
    """The chunks that ``read`` opens."""
    times = [_at(asked["start"]) if asked.get("start") else -(2**62), _at(asked["end"]) if asked.get("end") else 2**62]
    said = {"variables": variables, "time": times, "box": {"latitude": asked.get("lat"), "longitude": asked.get("lon")}, "slack": 1e-6}
    return [(p.variable, p.index) for p in _Reader({"path": plain(path), "asked": json.dumps(said)}).partitions() if p.variable]


def write(cells: DataFrame, path: str, chunks: tuple[int, int, int] = (24, 16, 16)) -> None:
    """``cells`` (latitude, longitude, ts, variable, value; each once) as a cube of hours since 1970. Its axes are the values that are there: they alone go through the driver. The folder must be shared."""
    path = plain(path)
    hour = F.floor(F.unix_micros("ts") / _MICROS["hours"])
    told = cells.where("latitude IS NOT NULL AND longitude IS NOT NULL AND ts IS NOT NULL").withColumn("hour", hour)
    axes = {k: np.array(sorted(r[0] for r in told.select(k).distinct().collect())) for k in ("hour", "latitude", "longitude")}
    variables = [r[0] for r in told.select("variable").distinct().collect()]
    shape = [len(axes[k]) for k in ("hour", "latitude", "longitude")]

    def put(name: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(f"{name}.{uuid.uuid4().hex}", "wb") as file:
            file.write(data)
        os.replace(file.name, name)

    def described(name: str, size: list[int], own: list[int], kind: str, attributes: dict) -> None:
        said = {"zarr_format": 2, "shape": size, "chunks": own, "dtype": kind, "compressor": {"id": "zlib", "level": 5}, "fill_value": "NaN" if kind == "<f8" else None, "order": "C", "filters": None}
        put(f"{path}/{name}/.zarray", json.dumps(said).encode())
        put(f"{path}/{name}/.zattrs", json.dumps(attributes).encode())

    names = {"hour": ("time", "<i8"), "latitude": ("latitude", "<f8"), "longitude": ("longitude", "<f8")}
    for k, (name, kind) in names.items():
        described(name, [len(axes[k])], [max(1, len(axes[k]))], kind, {"_ARRAY_DIMENSIONS": [name]} | ({"units": "hours since 1970-01-01"} if k == "hour" else {}))
        put(f"{path}/{name}/0", zlib.compress(axes[k].astype(kind).tobytes()))
    for v in variables:
        described(v, shape, list(chunks), "<f8", {"_ARRAY_DIMENSIONS": list(_ORDER)})

    def chunk_file(group: pd.DataFrame) -> pd.DataFrame:
        variable, laid = group["variable"].iloc[0], np.full(chunks, np.nan)
        places = [np.searchsorted(axes[k], group[k].to_numpy()) for k in ("hour", "latitude", "longitude")]
        index = tuple(int(p[0]) // size for p, size in zip(places, chunks, strict=True))
        laid[tuple(p % size for p, size in zip(places, chunks, strict=True))] = group["value"].to_numpy(np.float64)
        put(f"{path}/{variable}/{'.'.join(map(str, index))}", zlib.compress(laid.tobytes(), 5))
        return pd.DataFrame({"written": [len(group)]})

    where = told
    for k, size in zip(("hour", "latitude", "longitude"), chunks, strict=True):
        firsts = [float(x) for x in axes[k][::size]]
        at = F.col(k)
        where = where.withColumn(f"__{k}", F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= at)))  # noqa: B023
    dealt = where.select("variable", "hour", "latitude", "longitude", "value", "__hour", "__latitude", "__longitude")
    dealt.groupBy("variable", "__hour", "__latitude", "__longitude").applyInPandas(chunk_file, "written long").agg(F.sum("written")).collect()
