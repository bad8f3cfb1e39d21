"""GeoTIFF files made here, byte by byte, read as cells; what is written is read back."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.sources import geotiff


def packed(value, order, predictor):
    """One block's bytes before deflate; value: rows, columns, bands."""
    rows, cols, bands = value.shape
    if predictor == 2:
        value = np.concatenate([value[:, :1], np.diff(value, axis=1).astype(value.dtype)], axis=1)
    if predictor == 3:
        planes = np.frombuffer(value.astype(value.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(rows, cols * bands, -1).transpose(0, 2, 1).reshape(rows, -1, bands)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1).astype(np.uint8)], axis=1).tobytes()
    return value.astype(value.dtype.newbyteorder(order)).tobytes()


def made(path, value, block, tiled, order="<", deflate=True, predictor=1, big=False, nodata=None, transform=False):
    value = value if value.ndim == 3 else value[:, :, None]
    height, width, bands = value.shape
    h, w = block
    blocks = []
    for r in range(0, height, h):
        for c in range(0, width, w):
            own = value[r : r + h, c : c + w]
            if tiled:
                own = np.pad(own, ((0, h - own.shape[0]), (0, w - own.shape[1]), (0, 0)))
            raw = packed(own, order, predictor)
            blocks.append(zlib.compress(raw) if deflate else raw)
    code, word = ("Q", 8) if big else ("I", 4)
    kind = {"u": 1, "i": 2, "f": 3}[value.dtype.kind]
    counts, places = (325, 324) if tiled else (279, 273)
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [value.dtype.itemsize * 8] * bands), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 284: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind] * bands)}
    tags |= {322: ("I", [w]), 323: ("I", [h])} if tiled else {278: ("I", [h])}
    tags |= {34264: ("d", [2.0, 0, 0, 100.0, 0, -3.0, 0, 500.0, 0, 0, 0, 0, 0, 0, 0, 1])} if transform else {33550: ("d", [2.0, 3.0, 0]), 33922: ("d", [0, 0, 0, 100.0, 500.0, 0])}
    tags |= {34735: ("H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32719])}
    if nodata is not None:
        tags[42113] = ("s", str(nodata).encode() + b"\0")
    start, offsets = (16 if big else 8), []
    body = b""
    for b in blocks:
        offsets.append(start + len(body))
        body += b + b"\0" * (len(b) % 2)
    tags |= {counts: (code, [len(b) for b in blocks]), places: (code, offsets)}
    ifd = start + len(body)
    extra, entries = b"", b""
    behind = ifd + (8 if big else 2) + len(tags) * (20 if big else 12) + word
    types = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    for tag, (k, xs) in sorted(tags.items()):
        own = xs if k == "s" else struct.pack(f"{order}{len(xs)}{k}", *xs)
        held = own.ljust(word, b"\0")
        if len(own) > word:
            held = struct.pack(order + code, behind + len(extra))
            extra += own + b"\0" * (len(own) % 2)
        entries += struct.pack(order + "HH" + code, tag, types[k], len(xs)) + held
    mark = {"<": b"II", ">": b"MM"}[order]
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, ifd) if big else struct.pack(order + "HI", 42, ifd))
    path.write_bytes(head + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * word + extra)
    return str(path)


def surface(kind, shape=(50, 70), bands=1):
    rng = np.random.default_rng(3)
    return (rng.normal(0, 50, (*shape, bands)) if kind.startswith("f") else rng.integers(0, 200, (*shape, bands))).astype(kind)


KINDS = [
    ("f4", (16, 32), True, {}), ("f4", (16, 16), True, {"predictor": 3}), ("f8", (7, 70), False, {"deflate": False}), ("i2", (13, 70), False, {"predictor": 2, "nodata": 7}), ("u1", (50, 70), False, {"order": ">"}),
    ("f4", (16, 16), True, {"order": ">", "predictor": 3, "big": True}), ("u2", (32, 32), True, {"predictor": 2, "transform": True}), ("f4", (16, 16), True, {"nodata": -9999}),
]


@pytest.mark.parametrize("kind,block,tiled,more", KINDS)
def test_own_files(spark, tmp_path, kind, block, tiled, more):
    value = surface(kind)
    if "nodata" in more:
        value[3:9, 10:30] = more["nodata"]
    if kind == "f4":
        value[0, 0] = np.nan
    path = made(tmp_path / "a.tif", value, block, tiled, **more)
    rows = geotiff.read(spark, path, blocks_per_task=3).collect()
    assert len(rows) == 50 * 70
    for r in rows:
        v = float(value[r.row, r.col, 0])
        assert r.value == (None if np.isnan(v) or v == more.get("nodata") else v)
        assert (r.x, r.y, r.epsg, r.file) == (100 + 2 * (r.col + 0.5), 500 - 3 * (r.row + 0.5), 32719, path)


def test_bands_and_folders(spark, tmp_path):
    value = surface("i2", bands=3)
    (tmp_path / "in").mkdir()
    made(tmp_path / "in" / "a_dem.tif", value, (16, 16), True)
    made(tmp_path / "in" / "b_dem.tif", value + 1, (10, 70), False)
    (tmp_path / "in" / "notes.txt").write_text("no raster")
    second = geotiff.read(spark, str(tmp_path / "in"), band=2, pattern="*_dem.tif")
    sums = {r.file[-9:]: r.s for r in second.groupBy("file").agg(F.sum("value").alias("s")).collect()}
    assert sums == {"a_dem.tif": value[:, :, 1].sum(), "b_dem.tif": value[:, :, 1].sum() + 3500}
    with pytest.raises(Exception, match="no file matches"):
        geotiff.read(spark, str(tmp_path / "in"), pattern="*.jp2").count()


def test_a_window_leaves_blocks_unread(spark, tmp_path):
    value = surface("f4", (160, 160))
    path = made(tmp_path / "a.tif", value, (16, 16), True)
    raster = geotiff.read_tags(path)
    assert len(raster.blocks((20, 40, 100, 101))) == 2 and len(raster.blocks((0, 160, 0, 160))) == 100
    # blocks outside of the window are damaged: they are not even looked at
    data = bytearray(open(path, "rb").read())
    for number, row, col, offset, count in raster.blocks((0, 160, 0, 160)):
        if number not in {x[0] for x in raster.blocks((20, 40, 100, 101))}:
            data[offset : offset + count] = b"\xff" * count
    open(path, "wb").write(bytes(data))
    rows = geotiff.read(spark, path, (20, 40, 100, 101)).collect()
    assert sorted((r.row, r.col, r.value) for r in rows) == [(r, 100, float(value[r, 100, 0])) for r in range(20, 40)]
    with pytest.raises(Exception, match="Error -3|incorrect header"):
        geotiff.read(spark, path).count()


def test_conditions_are_pushed(spark, tmp_path):
    value = surface("f4", (160, 160))
    path = made(tmp_path / "a.tif", value, (16, 16), True)
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        found = geotiff.read(spark, path, blocks_per_task=1).where("row >= 20 AND row < 40 AND col = 100 AND value > 0")
        assert found.rdd.getNumPartitions() == 2
        assert found.count() == int((value[20:40, 100] > 0).sum())
    finally:
        spark.conf.unset(name)


def test_refused(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"PNG and so on, not a raster at all")
    with pytest.raises(geotiff.GeoTiffError, match="no TIFF"):
        geotiff.read_tags(str(tmp_path / "a.tif"))
    path = made(tmp_path / "b.tif", surface("u1"), (50, 70), False)
    data = bytearray(open(path, "rb").read())
    at = data.rfind(struct.pack("<HHI", 259, 3, 1)) + 8
    data[at : at + 2] = struct.pack("<H", 7)
    (tmp_path / "c.tif").write_bytes(bytes(data))
    with pytest.raises(geotiff.GeoTiffError, match="compression 7"):
        geotiff.read_tags(str(tmp_path / "c.tif"))


@pytest.mark.parametrize("dtype", ["f4", "i2", "f8"])
def test_round_trip(spark, tmp_path, dtype):
    value = np.round(surface("f4", (100, 130))[:, :, 0])
    cells = [(r, c, None if (r + c) % 11 == 0 else float(value[r, c])) for r in range(100) for c in range(130) if not (32 <= r < 64 and 64 <= c < 96)]
    frame = spark.createDataFrame(cells, "row int, col int, value double").repartition(7)
    path = str(tmp_path / "out.tif")
    geotiff.write(frame, path, 100, 130, origin=(100.0, 500.0), step=(2.0, 3.0), nodata=-999.0, epsg=32719, dtype=dtype, tile=32)
    assert os.listdir(tmp_path) == ["out.tif"]
    back = {(r.row, r.col): r for r in geotiff.read(spark, path).collect()}
    assert {k for k, r in back.items() if r.value is not None} == {(r, c) for r, c, v in cells if v is not None}
    assert all(back[r, c].value == v for r, c, v in cells)
    assert (back[0, 0].x, back[0, 0].y, back[0, 0].epsg) == (101.0, 498.5, 32719)
    geotiff.write(frame.limit(0), str(tmp_path / "none.tif"), 100, 130, tile=32)
    assert geotiff.read(spark, str(tmp_path / "none.tif")).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    frame = spark.range(6_000).selectExpr("int(id div 100) AS row", "int(id % 100) AS col", "double(id) AS value")
    broken = frame.withColumn("value", F.when((F.col("row") == 45) & (F.col("col") == 45), F.raise_error("lost")).otherwise(F.col("value")))
    path = str(tmp_path / "out.tif")
    with pytest.raises(Exception, match="lost"):
        geotiff.write(broken, path, 60, 100, tile=16)
    with pytest.raises(Exception, match="outside of the raster"):
        geotiff.write(frame, path, 50, 100, tile=16)
    assert os.listdir(tmp_path) == []
