import json

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.__main__ import main
from waymark.operators import evidence, quality, temporal
from waymark.sources import readers, sinks
from waymark.streaming import ingest

PLAN = {"metric": "surface", "unit": "index", "scenario_id": "demo_a", "baseline_at_utc": "2030-01-01T00:00:00Z", "current_at_utc": "2030-02-01T00:00:00Z", "ingested_at_utc": "2030-02-02T00:00:00Z"}
PUBLISHED = {
    "schema_version": "v9", "scenario_id": "demo_a", "simulation_only": True, "operational_use_allowed": False, "metric": {"name": "surface", "unit": "index", "higher_is_better": True},
    "timestamps": {n: PLAN[n] for n in ("baseline_at_utc", "current_at_utc", "ingested_at_utc")}, "baseline_formula": {"intercept": 50.0, "multiplier": 13, "modulus": 11, "center": 5, "scale": 0.25},
    "default_delta_pattern": [-2.0, 0.0, 2.0, 3.0], "demonstration_zones": [{"km_inicio_min": 20, "km_inicio_max": 24, "delta": -12.0}, {"km_inicio_min": 40, "km_inicio_max": 40, "delta": 5.0}, {"km_inicio_min": 41, "km_inicio_max": 41, "delta": -10.0}],
    "uncertainty_half_width": {"baseline": 1.0, "current": 2.5}, "change_thresholds_abs": {"stable_max": 2.0, "minor_max": 5.0, "moderate_max": 10.0}, "provenance": {"fuente": "simulation:test", "quality_flag": "simulated", "notes": "none"},
}


def test_csv_is_typed_and_strict(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("progresiva_km,lat,lon,confianza,fuente,fecha_relevamiento,observacion\n1.5,-29.1,-69.0, ALTA ,x,2024-05-01,\n,,,,,,\n")
    rows = readers.read_control_points(spark, str(tmp_path / "ok.csv")).collect()
    assert (rows[0].confianza, rows[0].observacion, rows[1].lat, rows[1].confianza) == ("alta", None, None, "")
    (tmp_path / "bad.csv").write_text("km_inicio,km_fin,peligro,categoria,estacionalidad,nivel,fuente\nx,1,a,b,c,d,e\n")
    with pytest.raises(Exception, match="MALFORMED|x"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), schemas.HAZARDS).collect()


@pytest.mark.parametrize("body,said", [("a,b\n1,2\n", "missing"), ("km_inicio,km_fin\n0.5,1\n", "whole"), ("km_inicio,km_fin\n2,1\n", "ordered"), ("km_inicio,km_fin\n0,1\n2,3\n", "by one"), ("km_inicio,km_fin\n1,2\n0,1\n", "row 2: 1, 2"), ("km_inicio,km_fin\n0,1\n1,x\n", "row 3: 1, x"), ("km_inicio,km_fin\n0,1\n", "by one")])
def test_segment_keys_are_checked(spark, tmp_path, body, said):
    (tmp_path / "k.csv").write_text(body)
    with pytest.raises(readers.SourceError, match=said):
        readers.load_segment_keys(spark, str(tmp_path / "k.csv"), 2)


def test_geojson_both_ways(spark, tmp_path):
    said = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}]}
    for k, text in enumerate((said, said["features"][0])):
        (tmp_path / f"{k}.json").write_text(json.dumps(text, indent=1))
        vertices = readers.read_lines(spark, str(tmp_path / f"{k}.json"))
        assert [(r.seq, r.x, r.y) for r in vertices.orderBy("seq").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
        back = json.loads(sinks.feature_collection(sinks.features(vertices)))
        assert back["features"][0]["geometry"]["coordinates"] == [[1.0, 2.0], [3.0, 4.0]]


def test_cells_cubes_and_ways(spark, tmp_path):
    cells = spark.range(20).selectExpr("int(id) AS row", "int(id) AS col", "double(id) AS value")
    sinks.write_cells(cells, str(tmp_path / "cells"), block=8)
    assert readers.read_cells(spark, str(tmp_path / "cells"), "*.parquet").count() == 20
    with pytest.raises(readers.SourceError):
        readers.read_cells(spark, str(tmp_path / "cells"), "*.img").count()
    cube = spark.createDataFrame([(-29.0, -69.0, 0), (-29.0000001, -69.1, 1), (-10.0, -69.0, 2)], "latitude double, longitude double, k int").withColumn("ts", F.timestamp_seconds(F.col("k") * 3600))
    assert readers.crop_cube(cube, (-69.1, -68.0), (-29.0, -28.0), "1970-01-01T00:00:00Z", "1970-01-01T01:00:00Z").count() == 2
    ways = spark.createDataFrame([("primary", [(0.0, 0.0), (1.0, 1.0)]), ("path", [(0.0, 0.0), (1.0, 1.0)]), ("primary", [(0.0, 0.0)]), ("primary", [(9.0, 9.0), (8.0, 8.0)])], "highway string, points array<struct<x: double, y: double>>")
    assert readers.select_ways(ways, "highway", "^(primary|trunk)$", (-1, -1, 2, 2)).count() == 1
    assert spark.range(1).select(readers.grid_index(F.lit(-28.5999999999993), -30.0, 0.1)).first()[0] == 14


def test_plan_is_checked():
    assert temporal.ChangePlan(**PLAN).thresholds == (2.0, 5.0, 10.0)
    zones = lambda *z: {"demonstration_zones": list(z)}
    for bad in ({"current_at_utc": "2029-01-01T00:00:00Z"}, {"baseline_at_utc": "2030-01-01"}, {"thresholds": (5.0, 5.0, 9.0)}, {"fuente": "observed"}, {"scenario_id": "real"}, zones((0, 5, 1.0), (5, 6, 1.0)), zones((120, 130, 1.0))):
        with pytest.raises(ValueError):
            temporal.ChangePlan(**PLAN | bad)


@pytest.mark.parametrize("change", [{"simulation_only": False}, {"operational_use_allowed": None}, {"more": 1}, {"metric": {"nam": "x"}}])
def test_a_published_plan_must_be_marked_and_known(tmp_path, change):
    (tmp_path / "plan.json").write_text(json.dumps(PUBLISHED | change))
    with pytest.raises(readers.SourceError):
        readers.load_plan(str(tmp_path / "plan.json"))


def test_bounds_belong_to_the_lower_class_and_zones_hold_their_ends(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps(PUBLISHED))
    plan = readers.load_plan(str(tmp_path / "plan.json"))
    keys = spark.range(130).selectExpr("int(id) AS km_inicio", "int(id + 1) AS km_fin")
    shots = temporal.snapshots(keys, plan)
    events = temporal.change_events(shots, F.to_timestamp(F.lit(plan.baseline_at_utc)), F.to_timestamp(F.lit(plan.current_at_utc)), plan.thresholds)
    assert temporal.run_violations(shots, events, plan).isEmpty()
    got = {r.segment_id[4:7]: (r.delta_abs, r.change_direction, r.change_class) for r in events.collect()}
    assert got["020"] == got["024"] == (-12.0, "decrease", "major") and got["025"] == (0.0, "stable", "stable")
    assert got["040"] == (5.0, "increase", "minor") and got["041"] == (-10.0, "decrease", "moderate")
    assert got["000"] == (-2.0, "stable", "stable") and got["002"] == (2.0, "stable", "stable") and got["003"] == (3.0, "increase", "minor")
    one = temporal.published_events(events).where("segment_id = 'seg_040_041'").first()
    assert one.change_event_id == "chg_demo_a_seg_040_041_surface" and one.baseline_snapshot_at_utc == PLAN["baseline_at_utc"]
    assert (one.baseline_value, one.delta_abs, one.confidence, one.is_simulated, one.fuente, one.source_version) == ("49.500", "5.000", "0.0", "true", "simulation:test", "v9")
    shown = temporal.published_snapshots(shots).where("segment_id = 'seg_040_041'").orderBy("observed_at_utc").collect()
    assert [(r.metric_value, r.uncertainty_lower, r.uncertainty_upper) for r in shown] == [("49.500", "48.500", "50.500"), ("54.500", "52.000", "57.000")]
    broken = temporal.run_violations(shots.limit(259).withColumn("is_simulated", F.lit(None).cast("boolean")), events.withColumn("confidence", F.lit(0.4)), plan)
    assert {r.rule: r.n for r in broken.collect()} == {"snapshot_count": 1, "snapshot_not_simulated": 259, "event_with_confidence": 130}


def test_command_line_writes_and_checks(spark, tmp_path):
    (tmp_path / "k.csv").write_text("km_inicio,km_fin\n" + "".join(f"{i},{i + 1}\n" for i in range(130)))
    (tmp_path / "plan.json").write_text(json.dumps(PUBLISHED))
    at = lambda name: str(tmp_path / name)
    words = ["graph", "--source", at("k.csv"), "--output", at("g.csv")]
    assert main([*words, "--check"]) == 1 and main(words) == 0 and main([*words, "--check"]) == 0
    assert len((tmp_path / "g.csv").read_text().splitlines()) == 259
    words = ["change", "--source", at("k.csv"), "--config", at("plan.json"), "--snapshots-output", at("s.csv"), "--events-output", at("e.csv")]
    assert main(words) == 0 and main([*words, "--check"]) == 0
    assert len((tmp_path / "s.csv").read_text().splitlines()) == 261 and len((tmp_path / "e.csv").read_text().splitlines()) == 131


def test_a_zero_base_has_no_percentage_and_taint_spreads(spark):
    rows = [("a", "m", "s", 1, 0.0, False), ("a", "m", "s", 2, 5.5, True), ("b", "m", "s", 1, 1.0, False)]
    shots = spark.createDataFrame([(*r, "f", "v") for r in rows], "segment_id string, metric_name string, simulation_scenario_id string, t int, metric_value double, is_simulated boolean, fuente string, source_version string").withColumn("observed_at_utc", F.timestamp_seconds("t"))
    got = temporal.change_events(shots, F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(2)), (2.0, 5.0, 10.0)).collect()
    assert [(r.segment_id, r.delta_pct, r.change_class, r.is_simulated) for r in got] == [("a", None, "moderate", True)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, None), (2, float("nan"))], "k int, v double")
    assert {r.rule: r.n for r in quality.summary(rows, {"v": quality.finite("v"), "k": F.col("k") > 1}).collect()} == {"v": 2, "k": 2}
    with pytest.raises(quality.GateFailure):
        quality.fail_on(quality.repeated_keys(rows, ["k"]), "keys")
    with pytest.raises(quality.GateFailure):
        quality.require_columns(rows, ["z"])
    with pytest.raises(quality.GateFailure):
        quality.forbid_columns(rows, ["v"])
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double"), spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (4, 0.0)], "k int, v double")
    assert sorted(r.k for r in quality.differences(a, b, ["k"], ["v"]).collect()) == [2, 3, 4]
    assert sorted(map(tuple, quality.coverage(a, b, ["k"]).collect())) == [(3, "unexpected"), (4, "missing")]
    assert quality.fingerprint(a, ["k"]) == quality.fingerprint(a.repartition(3), ["k"]) != quality.fingerprint(b, ["k"])
    assert quality.same_rows(a, a.repartition(2)) and not quality.same_rows(a, b)


def test_unknown_levels_do_not_count(spark):
    rows = spark.createDataFrame([(1, "alto"), (1, "zzz"), (2, "zzz"), (3, "medio"), (3, "alto_medio")], "g int, nivel string")
    assert {r.g: r.m for r in rows.groupBy("g").agg(evidence.highest_level("nivel").alias("m")).collect()} == {1: "alto", 2: None, 3: "alto_medio"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ingest.append(ingest.daily_totals(stream, "ts", ["event_type"], "value"), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    got = {(str(r.day), r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(str(r.day), r.event_type): r.n for r in temporal.daily(events, ["event_type"], "ts", "value").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_corrections_stream_as_the_batch_has_them(spark, tmp_path):
    """Corrections, repeated and late ones, over several stops: at each the stream's result is the batch's."""
    shots = temporal.snapshots(spark.range(5).selectExpr("int(id) AS km_inicio", "int(id + 1) AS km_fin"), temporal.ChangePlan(**PLAN))
    shots = shots.withColumn("simulation_scenario_id", F.when(F.col("km_inicio") > 0, F.col("simulation_scenario_id"))).cache()

    def fixed(days, value, keys):
        moved = shots.where(F.col("km_inicio").isin(keys))
        return moved.withColumns({"ingested_at_utc": F.col("ingested_at_utc") + F.expr(f"INTERVAL {days} DAYS"), "metric_value": F.col("metric_value") + value})

    late = fixed(2, 20.0, [0, 1])
    stops = [shots.union(shots), fixed(1, 10.0, [0, 1, 2, 3, 4]).union(fixed(3, 30.0, [0])), late.union(shots).union(fixed(1, 10.0, [3])), fixed(3, 31.0, [0]).union(fixed(3, 32.0, [0])), shots]
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    counts = []
    for stop in stops:
        stop.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(shots.schema).parquet(folder)
        ingest.keep(ingest.corrections(stream), out, mark).awaitTermination(120)
        batch = temporal.latest(spark.read.schema(shots.schema).parquet(folder))
        assert sorted(map(repr, ingest.current(spark, out).collect())) == sorted(map(repr, batch.collect()))
        counts.append(ingest.versions(spark, out).count())
    assert counts[0] == 10 and counts[1] == 22 and counts[2] == 24 and counts[-1] == counts[-2]
    told = ingest.versions(spark, out).where("change = 'correction'")
    assert told.count() == counts[-1] - 10 and told.where("replaces IS NULL OR replaces > ingested_at_utc").isEmpty()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    shots = temporal.snapshots(spark.range(3).selectExpr("int(id) AS km_inicio", "int(id + 1) AS km_fin"), temporal.ChangePlan(**PLAN))
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    shots.coalesce(1).write.parquet(folder)
    for again in (False, True):
        if again:  # as if the driver was lost between writing and committing
            for name in ("0", ".0.crc"):
                (tmp_path / "mark" / "commits" / name).unlink(missing_ok=True)
        ingest.keep(ingest.corrections(spark.readStream.schema(shots.schema).parquet(folder)), out, mark).awaitTermination(120)
        assert ingest.versions(spark, out).count() == 6
