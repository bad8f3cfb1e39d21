"""Chunk folders made here, and what is written, read back; chunks outside of times and box are never opened."""

import json
import os
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import temporal
from waymark.sources import zarr
from waymark.sources.readers import SourceError

START = datetime(2020, 1, 1)


def array(folder, name, value, chunks, dims, mark=".", fill=None, skip=(), compressor="zlib", **attributes):
    own = folder / name
    own.mkdir(parents=True)
    said = {"zarr_format": 2, "shape": list(value.shape), "chunks": list(chunks), "dtype": value.dtype.str, "compressor": compressor and {"id": compressor}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": mark}
    (own / ".zarray").write_text(json.dumps(said))
    (own / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | attributes))
    for index in np.ndindex(*(-(-n // c) for n, c in zip(value.shape, chunks, strict=True))):
        if index in skip:
            continue
        laid = np.zeros(chunks, value.dtype)
        part = value[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks, strict=True))]
        laid[tuple(slice(0, n) for n in part.shape)] = part
        path = own / mark.join(map(str, index))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zlib.compress(laid.tobytes()) if compressor else laid.tobytes())


@pytest.fixture
def cube(tmp_path):
    """Four days of hours, 7 x 9 cells; one chunk has no file, one cell the fill value."""
    value = np.random.default_rng(1).integers(-100, 100, (96, 7, 9)).astype("<i2")
    value[5, 3, 3] = -999
    array(tmp_path, "t2m", value, (24, 3, 4), ["time", "latitude", "longitude"], fill=-999, skip={(3, 0, 0)}, scale_factor=0.5, add_offset=10.0)
    array(tmp_path, "rain", value.transpose(1, 2, 0).astype("<f4"), (7, 5, 48), ["latitude", "longitude", "time"], mark="/", compressor=None)
    array(tmp_path, "time", np.arange(96, dtype="<i4"), (50,), ["time"], units="hours since 2020-01-01 00:00:00")
    array(tmp_path, "latitude", np.linspace(-28, -31, 7), (4,), ["latitude"])
    array(tmp_path, "longitude", np.linspace(-70, -68, 9), (9,), ["longitude"])
    return tmp_path, value


def test_whole_cube(spark, cube):
    path, value = cube
    lats, lons = np.linspace(-28, -31, 7).tolist(), np.linspace(-70, -68, 9).tolist()
    rows = zarr.read(spark, str(path), ["t2m", "rain"]).select("*", F.date_format("ts", "yyyy-MM-dd HH").alias("at")).collect()
    assert len(rows) == 2 * value.size
    hours = {(START + timedelta(hours=h)).strftime("%Y-%m-%d %H"): h for h in range(96)}
    for r in rows:
        k = hours[r["at"]], lats.index(r.latitude), lons.index(r.longitude)
        gone = r.variable == "t2m" and (value[k] == -999 or k[0] >= 72 and k[1] < 3 and k[2] < 4)
        assert r.value == (None if gone else value[k] * 0.5 + 10 if r.variable == "t2m" else float(value[k]))


def test_only_chunks_of_time_and_box_are_opened(spark, cube):
    path, value = cube
    asked = {"start": "2020-01-02T00:00:00Z", "end": "2020-01-02T23:00:00Z", "lat": (-31.0, -30.4), "lon": (-70.0, -69.0)}
    wanted = zarr.planned(str(path), ["t2m"], **asked)
    assert sorted(wanted) == [("t2m", (1, 1, 0)), ("t2m", (1, 1, 1)), ("t2m", (1, 2, 0)), ("t2m", (1, 2, 1))] and len(zarr.planned(str(path), ["t2m"])) == 36
    for name in os.listdir(path / "t2m"):
        if name[0] != "." and ("t2m", tuple(map(int, name.split(".")))) not in wanted:
            (path / "t2m" / name).write_bytes(b"damaged")
    rows = zarr.read(spark, str(path), ["t2m"], **asked)
    assert rows.count() == 24 * 2 * 5 and rows.where("value IS NULL").isEmpty()
    assert zarr.read(spark, str(path), ["t2m"], start="2031-01-01T00:00:00Z").count() == 0
    with pytest.raises(Exception, match="Error -3|incorrect header"):
        zarr.read(spark, str(path), ["t2m"]).count()


def test_days_over_a_cube(spark, cube):
    path, value = cube
    days = temporal.daily(zarr.read(spark, str(path), ["rain"]), ["latitude", "longitude"], "ts", "value")
    got = sorted((r.latitude, r.longitude, str(r.day), r.least, r.most, r.total) for r in days.collect())
    own = value.reshape(4, 24, 7, 9)
    assert len(got) == 4 * 63
    for (lat, lon, day, least, most, total) in got:
        i, j, d = round((-28 - lat) / 0.5), round((lon + 70) / 0.25), int(day[-2:]) - 1
        assert (least, most, total) == (own[d, :, i, j].min(), own[d, :, i, j].max(), own[d, :, i, j].sum())


def test_refused(spark, tmp_path):
    array(tmp_path, "a", np.zeros((2, 2)), (2, 2), ["time", "depth"])
    array(tmp_path, "b", np.zeros((2, 2)), (2, 2), ["time", "latitude"], compressor="zlib")
    said = json.loads((tmp_path / "b" / ".zarray").read_text()) | {"compressor": {"id": "blosc"}}
    (tmp_path / "b" / ".zarray").write_text(json.dumps(said))
    for name, text in (("a", "dimensions"), ("b", "blosc"), ("c", "no array")):
        with pytest.raises(SourceError, match=text):
            zarr.planned(str(tmp_path), [name])


def test_round_trip(spark, tmp_path):
    cells = spark.range(4_000).selectExpr("double(id % 10) AS latitude", "double(id div 10 % 8) / 4 AS longitude", "timestamp_seconds(1577836800 + (id div 80) * 7200) AS ts", "'w' AS variable", "CASE WHEN id % 7 > 0 THEN id * 0.5 END AS value")
    zarr.write(cells.repartition(5), str(tmp_path / "w"), (6, 4, 3))
    back = zarr.read(spark, str(tmp_path / "w"), ["w"])
    assert back.exceptAll(cells).isEmpty() and cells.exceptAll(back).isEmpty()
    assert len(zarr.planned(str(tmp_path / "w"), ["w"], lat=(0, 3), lon=(0.0, 0.5))) == 9
