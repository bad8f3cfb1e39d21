"""GeoTIFF rasters as cell tables, read and written by Spark tasks, with the standard library's deflate.

Reading. The driver reads the tags of each file; its tiles or strips are dealt to partitions of up to ``blocks_per_task``, and each task reads
and inflates its own blocks. A window, given as options or pushed from conditions on row and col (where the session has
spark.sql.python.filterPushdown.enabled), leaves blocks outside of it unread. Columns: file, row, col, value (null where it is the file's
no-data value or NaN), x and y of the cell's centre by the file's affine tags, and epsg (null if the file doesn't say).

Writing. ``write`` deals cells to tasks by tile; each task compresses its tiles into a part file of its own and hands on where they lie. The commit
copies the parts behind a header into one file and moves it to its name at once; a failed job leaves neither parts nor file. Tiles without a cell
take no room. Files of 4 GB or more are BigTIFF.

Read: classic and BigTIFF, either byte order, tiles and strips, uncompressed or deflate, predictors 1 to 3, integers and floats of 8 to 64 bits, pixel-interleaved
bands. What else there is is refused. Paths are local or any that pyarrow opens (hdfs://, s3://), and must be seen by all executors.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "file string, row int, col int, value double, x double, y double, epsg int"

#: Sizes and struct codes of the tag types, and the tags that are read.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


class GeoTiffError(ValueError):
    """A file that is no GeoTIFF, or one of a kind that is not read."""


def _plain(path: str) -> str:
    """A file: uri as a path; other uris and paths as they are."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _opened(path: str):
    """The file at a path or uri, for reading at any place."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def files_of(path: str, pattern: str | None = None) -> list[str]:
    """The file itself, or the files under a folder whose names match."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    own = sorted(x.path for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, pattern or "*.tif*"))
    if not own:
        raise GeoTiffError(f"no file matches {pattern or '*.tif*'} under {path}")
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [prefix + x for x in own]


@dataclass
class Raster:
    """What a file's tags say."""

    path: str
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    def __post_init__(self):
        self.width, self.height = self.one(WIDTH), self.one(HEIGHT)
        self.tiled = TILE_OFFSETS in self.tags
        self.block = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if self.tiled else (min(self.one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.offsets, self.counts = (self.tags.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if self.tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
        self.samples, self.predictor = self.one(SAMPLES, 1), self.one(PREDICTOR, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(self.one(FORMAT, 1))
        if self.one(COMPRESSION, 1) not in (1, 8, 32946) or kind is None or self.one(BITS, 1) not in (8, 16, 32, 64) or self.predictor not in (1, 2, 3) or self.samples > 1 and self.one(PLANAR, 1) != 1:
            raise GeoTiffError(f"{self.path}: compression {self.one(COMPRESSION)}, format {self.one(FORMAT)}, {self.one(BITS)} bits, predictor {self.predictor} or layout is not read")
        self.dtype = np.dtype(f"{self.order}{kind}{self.one(BITS) // 8}")
        text = b"".join(self.tags.get(NODATA, ())).split(b"\0")[0].strip()
        self.nodata = float(text) if text else None
        if TRANSFORM in self.tags:
            a, b, _, c, d, e, _, f = self.tags[TRANSFORM][:8]
        elif SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[SCALE][:2], self.tags[TIEPOINT][:5]
            a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        else:
            a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, -1.0, 0.0
        self.affine = (a, b, c, d, e, f)
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        self.epsg = codes.get(3072, codes.get(2048))

    def blocks(self, window: tuple[int, int, int, int]) -> list[tuple[int, int, int, int, int]]:
        """(number, first row, first column, offset, bytes) of the blocks with a cell in the window (rows from, to, columns from, to; ends excluded)."""
        h, w = self.block
        across = -(-self.width // w)
        out = []
        for number, (offset, count) in enumerate(zip(self.offsets, self.counts, strict=True)):
            row, col = number // across * h, number % across * w
            if row < window[1] and row + h > window[0] and col < window[3] and col + w > window[2]:
                out.append((number, row, col, offset, count))
        return out

    def values(self, raw: bytes, band: int) -> np.ndarray:
        """The band's values of one block; the last strip may be shorter."""
        data = zlib.decompress(raw) if self.one(COMPRESSION, 1) != 1 else raw
        row_bytes = self.block[1] * self.samples * self.dtype.itemsize
        rows = len(data) // row_bytes
        if self.predictor == 3:
            planes = np.cumsum(np.frombuffer(data, np.uint8)[: rows * row_bytes].reshape(rows, -1, self.samples), axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, -1)
            laid = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, self.block[1], self.samples)
        else:
            laid = np.frombuffer(data, self.dtype)[: rows * self.block[1] * self.samples].reshape(rows, self.block[1], self.samples)
            if self.predictor == 2:
                laid = np.cumsum(laid, axis=1, dtype=laid.dtype)
        return laid[:, :, band]


def read_tags(path: str) -> Raster:
    """The tags of the file's first image."""
    with _opened(path) as file:
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise GeoTiffError(f"{path} is no TIFF")
        big = magic == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        file.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
        entries, tags = file.read(n * (20 if big else 12)), {}
        for k in range(n):
            entry = entries[k * (20 if big else 12) :][: 20 if big else 12]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            count = struct.unpack(order + ("Q" if big else "I"), entry[4:12] if big else entry[4:8])[0]
            if kind not in _TYPES:
                continue
            code = order + _TYPES[kind] * count if count < 64 else f"{order}{count * len(_TYPES[kind])}{_TYPES[kind][0]}"
            size, own = struct.calcsize(code), entry[12:] if big else entry[8:]
            if size > len(own):
                file.seek(struct.unpack(order + ("Q" if big else "I"), own)[0])
                own = file.read(size)
            tags[tag] = struct.unpack(code, own[:size])
    return Raster(path, order, tags)


@dataclass
class _Blocks(InputPartition):
    path: str
    blocks: list[tuple[int, int, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = files_of(options["path"], options.get("pattern"))
        self.band, self.per_task = int(options.get("band", 1)) - 1, int(options.get("blocks_per_task", 16))
        ends = json.loads(options.get("window", "[0, 2147483647, 0, 2147483647]"))
        self.window = [int(x) for x in ends]

    def partitions(self):
        out = []
        for path in self.files:
            blocks = read_tags(path).blocks(tuple(self.window))
            out += [_Blocks(path, blocks[k : k + self.per_task]) for k in range(0, len(blocks), self.per_task)]
        return out or [_Blocks(self.files[0], [])]

    def read(self, partition):
        raster, window = read_tags(partition.path), self.window
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        a, b, c, d, e, f = raster.affine
        with _opened(partition.path) as file:
            for _, row, col, offset, count in partition.blocks:
                if not count:
                    continue  # a tile without cells
                file.seek(offset)
                value = raster.values(file.read(count), self.band)
                rows, cols = (x.ravel() for x in np.meshgrid(np.arange(row, row + value.shape[0]), np.arange(col, col + value.shape[1]), indexing="ij"))
                kept = (rows < min(raster.height, window[1])) & (rows >= window[0]) & (cols < min(raster.width, window[3])) & (cols >= window[2])
                rows, cols, values = rows[kept], cols[kept], value.ravel()[kept].astype(np.float64)
                empty = np.isnan(values) if raster.nodata is None else np.isnan(values) | (values == np.float64(raster.dtype.type(raster.nodata)))
                n = len(rows)
                arrays = [
                    pa.array([partition.path] * n, pa.string()), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(values, pa.float64(), mask=empty),
                    pa.array(a * (cols + 0.5) + b * (rows + 0.5) + c), pa.array(d * (cols + 0.5) + e * (rows + 0.5) + f), pa.array([raster.epsg] * n, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)


class _PushReader(_Reader):
    """The reader for sessions that push conditions; others refuse a reader that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on row and col narrow the window; all conditions are handed back, so that Spark tests the cells of blocks that are read in part."""
        for f in filters:
            if getattr(f, "attribute", None) in (("row",), ("col",)):
                k = 0 if f.attribute == ("row",) else 2
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.window[k] = max(self.window[k], int(np.floor(f.value)) + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.window[k + 1] = min(self.window[k + 1], int(np.ceil(f.value)) + (not isinstance(f, LessThan)))
            yield f


@dataclass
class _Part(WriterCommitMessage):
    file: str
    tiles: list[tuple[int, int, int]]


class _Writer(DataSourceArrowWriter):
    """Tiles in the order in which they come: rows of a task must be in order of their tile."""

    def __init__(self, options):
        said = json.loads(options["layout"])
        self.path, self.width, self.height, self.tile = options["path"], said["width"], said["height"], said["tile"]
        self.dtype, self.nodata, self.origin, self.step, self.epsg = np.dtype(said["dtype"]).newbyteorder("<"), said["nodata"], said["origin"], said["step"], said["epsg"]
        self.folder = f"{self.path}.{said['job']}.parts"

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        context = TaskContext.get()
        name = f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        tiles, number, laid, at = [], None, None, 0
        empty = self.dtype.type(self.nodata)
        with open(name, "wb") as file:

            def close() -> None:
                nonlocal at
                packed = zlib.compress(laid.tobytes(), 6)
                file.write(packed)
                tiles.append((number, at, len(packed)))
                at += len(packed)

            for batch in iterator:
                row, col, value, tile = (batch.column(c) for c in ("row", "col", "value", "tile"))
                row, col, tile = (x.to_numpy(zero_copy_only=False) for x in (row, col, tile))
                filled = value.fill_null(self.nodata).to_numpy(zero_copy_only=False)
                if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= self.height or col.max() >= self.width):
                    raise GeoTiffError("a cell lies outside of the raster")
                cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)] if len(tile) else []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if tile[a] != number:
                        if number is not None:
                            close()
                        number, laid = int(tile[a]), np.full((self.tile, self.tile), empty, self.dtype)
                    laid[row[a:b] % self.tile, col[a:b] % self.tile] = filled[a:b]
            if number is not None:
                close()
        return _Part(name, tiles)

    def _head(self, counts: list[int]) -> bytes:
        """Header, tags and their values, for tiles that follow in order."""
        big = sum(counts) + 32 * len(counts) + 4096 >= 1 << 32
        word, code = (8, "Q") if big else (4, "I")
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        keys = (1, 1, 0, 1, 3072, 0, 1, self.epsg) if self.epsg else ()
        tags = {
            WIDTH: ("I", [self.width]), HEIGHT: ("I", [self.height]), BITS: ("H", [self.dtype.itemsize * 8]), COMPRESSION: ("H", [8]), 262: ("H", [1]), SAMPLES: ("H", [1]), PLANAR: ("H", [1]), PREDICTOR: ("H", [1]),
            TILE_WIDTH: ("I", [self.tile]), TILE_HEIGHT: ("I", [self.tile]), TILE_OFFSETS: (code, counts), TILE_COUNTS: (code, counts), FORMAT: ("H", [kind]), SCALE: ("d", [self.step[0], self.step[1], 0.0]),
            TIEPOINT: ("d", [0.0, 0.0, 0.0, self.origin[0], self.origin[1], 0.0]), GEO_KEYS: ("H", list(keys)), NODATA: ("s", repr(self.nodata).encode() + b"\0"),
        }
        tags = {t: x for t, x in sorted(tags.items()) if len(x[1])}
        types = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
        first = 16 if big else 8
        behind = first + (8 if big else 2) + len(tags) * (20 if big else 12) + word
        packed = {t: x[1] if x[0] == "s" else struct.pack(f"<{len(x[1])}{x[0]}", *x[1]) for t, x in tags.items()}
        places, end = {}, behind
        for t, own in packed.items():
            if len(own) > word:
                places[t], end = end, end + len(own) + len(own) % 2
        offsets = np.where(np.array(counts) > 0, end + np.cumsum([0, *counts])[:-1], 0).tolist()
        packed[TILE_OFFSETS] = struct.pack(f"<{len(counts)}{code}", *offsets)
        out = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first), struct.pack("<Q" if big else "<H", len(tags))]
        for t, own in packed.items():
            held = struct.pack("<" + code, places[t]) if t in places else own.ljust(word, b"\0")
            out.append(struct.pack("<HH" + code, t, types[tags[t][0]], len(tags[t][1])) + held)
        out.append(b"\0" * word)
        out += [own + b"\0" * (len(own) % 2) for t, own in packed.items() if t in places]
        return b"".join(out)

    def commit(self, messages) -> None:
        across = -(-self.width // self.tile)
        where = {n: (m.file, at, size) for m in messages if m for n, at, size in m.tiles}
        tiles = range(across * -(-self.height // self.tile))
        whole = f"{self.folder}/whole"
        os.makedirs(self.folder, exist_ok=True)
        with open(whole, "wb") as out:
            out.write(self._head([where[n][2] if n in where else 0 for n in tiles]))
            for n in tiles:
                if n in where:
                    name, at, size = where[n]
                    with open(name, "rb") as part:
                        part.seek(at)
                        out.write(part.read(size))
        os.replace(whole, self.path)
        shutil.rmtree(self.folder)

    def abort(self, messages) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class GeoTiff(DataSource):
    """``spark.read.format("geotiff")`` with path (a file or a folder), pattern, band (from 1), window and blocks_per_task."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushReader if self.options.get("push") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, **options) -> DataFrame:
    """The cells of one file, or of all files of a folder. ``window``: rows from, to and columns from, to, ends excluded."""
    spark.dataSource.register(GeoTiff)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("geotiff").options(path=_plain(path), push=push, **options)
    return (reader.option("window", json.dumps(window)) if window else reader).load()


def write(cells: DataFrame, path: str, height: int, width: int, origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0), nodata: float = -9999.0, epsg: int | None = None, dtype: str = "f4", tile: int = 256) -> None:
    """``cells`` (row, col, value; each once) as one tiled file; ``origin``: the upper left corner, ``step``: the cells' width and height. The folder must be shared."""
    if tile % 16:
        raise GeoTiffError("tiles have sides of a multiple of 16")
    cells.sparkSession.dataSource.register(GeoTiff)
    path = _plain(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    across = -(-width // tile)
    number = (F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).cast("long")
    dealt = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), number.alias("tile"))
    layout = {"width": width, "height": height, "tile": tile, "dtype": dtype, "nodata": nodata, "origin": origin, "step": step, "epsg": epsg, "job": uuid.uuid4().hex}
    dealt.repartition("tile").sortWithinPartitions("tile").write.format("geotiff").options(path=path, layout=json.dumps(layout)).mode("append").save()
