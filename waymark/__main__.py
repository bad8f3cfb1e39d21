"""Command line: neighbour graph and change run, written or checked."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from waymark.operators.graph import linear_neighbours, violations
from waymark.operators.quality import fail_on
from waymark.operators.temporal import change_events, published_events, published_snapshots, run_violations, snapshots
from waymark.schemas import NEIGHBOURS
from waymark.session import build_session
from waymark.sources.readers import load_plan, load_segment_keys
from waymark.sources.sinks import is_current, publish, render_csv


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="waymark")
    tasks = parser.add_subparsers(dest="task", required=True)
    graph = tasks.add_parser("graph")
    change = tasks.add_parser("change")
    for one in (graph, change):
        one.add_argument("--source", required=True)
        one.add_argument("--check", action="store_true")
        one.add_argument("--segments", type=int, default=130)
    graph.add_argument("--output", required=True)
    change.add_argument("--config", required=True)
    change.add_argument("--snapshots-output", required=True)
    change.add_argument("--events-output", required=True)
    said = parser.parse_args(words)
    spark = build_session()
    keys = load_segment_keys(spark, said.source, said.segments)
    if said.task == "graph":
        edges = linear_neighbours(keys)
        fail_on(violations(edges, "segment_id", "neighbor_segment_id").where("n > 0"), "neighbour graph")
        made = {said.output: render_csv(edges, NEIGHBOURS.names, ["km_inicio", "neighbor_km_inicio"])}
    else:
        plan = load_plan(said.config, said.segments)
        shots = snapshots(keys, plan)
        events = change_events(shots, F.to_timestamp(F.lit(plan.baseline_at_utc)), F.to_timestamp(F.lit(plan.current_at_utc)), plan.thresholds)
        fail_on(run_violations(shots, events, plan), "change run")
        shown, told = published_snapshots(shots), published_events(events)
        made = {said.snapshots_output: render_csv(shown, shown.columns, ["segment_id", "observed_at_utc"]), said.events_output: render_csv(told, told.columns, ["segment_id"])}
    if said.check:
        return int(not all(is_current(text, path) for path, text in made.items()))
    for path, text in made.items():
        publish(text, path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
