"""Hour, day and year reductions; bitemporal snapshots, change events and rank stability."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import fixed, segment_id
from waymark.operators.ranking import with_rank_within


def true_share(condition: Column) -> Column:
    """Aggregate: share of rows where the condition holds; an unknown one does not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def daily(frame: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """least, most, total and n of each calendar day."""
    return frame.groupBy(*by, F.to_date(ts).alias("day")).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"), F.count(value).alias("n"))


def annual_mean(days: DataFrame, by: list[str], measure: Column, out: str) -> DataFrame:
    """Mean over the years of each year's sum of ``measure`` over its days."""
    years = days.groupBy(*by, F.year("day").alias("year")).agg(F.sum(measure).alias("__sum"))
    return years.groupBy(*by).agg(F.avg("__sum").alias(out))


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


@dataclass
class ChangePlan:
    """Parameters of a simulated change run, under the names of the published settings; checked on creation."""

    metric: str
    unit: str
    scenario_id: str
    baseline_at_utc: str
    current_at_utc: str
    ingested_at_utc: str
    intercept: float = 70.0
    multiplier: int = 17
    modulus: int = 21
    center: int = 10
    scale: float = 0.5
    default_delta_pattern: list[float] = field(default_factory=lambda: [-2.0, -1.0, 0.0, 1.0, 2.0])
    #: First and last kilometre (both in the zone) and delta.
    demonstration_zones: list[tuple[int, int, float]] = field(default_factory=list)
    #: Half widths of the band at the baseline and now.
    uncertainty: tuple[float, float] = (2.0, 3.0)
    #: Largest absolute change that is stable, minor and moderate.
    thresholds: tuple[float, float, float] = (2.0, 5.0, 10.0)
    fuente: str = "simulation:demo"
    quality_flag: str = "simulated_demo_only"
    notes: str = ""
    schema_version: str = "v0.1"
    segments: int = 130

    def __post_init__(self):
        times = [_utc(t) for t in (self.baseline_at_utc, self.current_at_utc, self.ingested_at_utc)]
        if not times[0] < times[1] <= times[2]:
            raise ValueError("times must keep baseline < current <= ingested")
        if not 0 <= self.thresholds[0] < self.thresholds[1] < self.thresholds[2]:
            raise ValueError("thresholds must increase from 0 on")
        if not self.fuente.startswith("simulation:") or not self.scenario_id.startswith("demo_"):
            raise ValueError("a simulated run must be named as one")
        ordered = sorted(self.demonstration_zones)
        if any(a[1] >= b[0] for a, b in zip(ordered, ordered[1:], strict=False)) or any(not 0 <= a <= b < self.segments for a, b, _ in ordered):
            raise ValueError("zones must lie on the line and must not overlap")


def _utc(text: str) -> datetime:
    if not isinstance(text, str) or not text.endswith("Z"):
        raise ValueError(f"{text!r} is not an ISO time that ends in Z")
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def baseline_of(k: Column, plan: ChangePlan) -> Column:
    return F.round(F.lit(plan.intercept) + (k * plan.multiplier % plan.modulus - plan.center) * plan.scale, 3)


def delta_of(k: Column, plan: ChangePlan) -> Column:
    """The first zone that holds k, both ends included, gives the delta, else the cyclic pattern does."""
    value = F.element_at(F.array(*map(F.lit, plan.default_delta_pattern)), (k % len(plan.default_delta_pattern) + 1).cast("int"))
    for low, high, delta in reversed(plan.demonstration_zones):
        value = F.when(k.between(low, high), F.lit(float(delta))).otherwise(value)
    return value


def change_class(delta: Column, thresholds: tuple[float, float, float]) -> Column:
    """By the absolute change; a bound belongs to the class below it: stable, minor, moderate, major."""
    size = F.abs(delta)
    stable, minor, moderate = thresholds
    return F.when(size <= stable, "stable").when(size <= minor, "minor").when(size <= moderate, "moderate").when(size.isNotNull(), "major")


def change_direction(delta: Column, stable: float) -> Column:
    """Changes up to ``stable`` have no direction."""
    return F.when(F.abs(delta) <= stable, "stable").when(delta > 0, "increase").when(delta < 0, "decrease")


def snapshots(segments: DataFrame, plan: ChangePlan) -> DataFrame:
    """Two rows for each segment (km_inicio, km_fin), baseline and current, each with its band."""
    k = F.col("km_inicio")
    base = baseline_of(k, plan)
    both = [(plan.baseline_at_utc, base, plan.uncertainty[0]), (plan.current_at_utc, F.round(base + delta_of(k, plan), 3), plan.uncertainty[1])]
    rows = F.array(*(F.struct(F.to_timestamp(F.lit(at)).alias("observed_at_utc"), v.alias("metric_value"), (v - w).alias("uncertainty_lower"), (v + w).alias("uncertainty_upper")) for at, v, w in both))
    constants = {
        "ingested_at_utc": F.to_timestamp(F.lit(plan.ingested_at_utc)), "metric_name": F.lit(plan.metric), "unit": F.lit(plan.unit), "evidence_type": F.lit("simulated"), "fuente": F.lit(plan.fuente), "source_version": F.lit(plan.schema_version),
        "quality_flag": F.lit(plan.quality_flag), "is_simulated": F.lit(True), "simulation_scenario_id": F.lit(plan.scenario_id), "notes": F.lit(plan.notes),
    }
    return segments.select(segment_id(k, F.col("km_fin")).alias("segment_id"), "km_inicio", "km_fin", F.inline(rows)).withColumns(constants)


#: What names a snapshot; its versions differ in when they were ingested.
LOGICAL_KEY = ("segment_id", "metric_name", "observed_at_utc", "fuente", "source_version", "simulation_scenario_id")


def version_text(shots: DataFrame) -> Column:
    """A digest of a whole row, which orders versions that were ingested at the same time."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(shots.columns)))), 256)


def latest(shots: DataFrame) -> DataFrame:
    """The last ingested version of each logical key: an aggregate, so a key with very many versions is combined before the shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in shots.columns))
    best = shots.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(LOGICAL_KEY))).agg(F.max_by(row, F.struct("ingested_at_utc", version_text(shots))).alias("row"))
    return best.select("row.*")


def change_events(shots: DataFrame, baseline_at: Column, current_at: Column, thresholds: tuple[float, float, float]) -> DataFrame:
    """One row for each segment and metric that has both instants: one conditional aggregate, no self join. A zero base has no percentage. Any simulated input makes the event simulated."""
    at = lambda t: F.max(F.when(F.col("observed_at_utc") == t, F.col("metric_value")))
    keys = ["segment_id", "metric_name", "simulation_scenario_id", "fuente", "source_version"]
    both = shots.groupBy(*keys).agg(at(baseline_at).alias("baseline_value"), at(current_at).alias("current_value"), F.bool_or("is_simulated").alias("is_simulated"))
    delta = F.round(F.col("current_value") - F.col("baseline_value"), 3)
    found = both.where("baseline_value IS NOT NULL AND current_value IS NOT NULL").withColumns({"baseline_snapshot_at_utc": baseline_at, "current_snapshot_at_utc": current_at, "delta_abs": delta})
    return found.withColumns(
        {
            "delta_pct": F.round(100 * F.col("delta_abs") / F.nullif(F.col("baseline_value"), F.lit(0.0)), 6), "change_direction": change_direction(F.col("delta_abs"), thresholds[0]),
            "change_class": change_class(F.col("delta_abs"), thresholds), "confidence": F.lit(0.0), "change_event_id": F.concat_ws("_", F.lit("chg"), "simulation_scenario_id", "segment_id", "metric_name"),
        }
    )


def _as_published(frame: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Columns in order as texts: doubles with so many decimals, times as ISO with Z, booleans in lower case."""
    kinds = dict(frame.dtypes)
    text = lambda c, places: fixed(F.col(c), places) if places is not None else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    return frame.select(*(text(c, places).alias(c) for c, places in columns.items()))


def published_snapshots(shots: DataFrame) -> DataFrame:
    # fixed values: the published header
    names = ("segment_id", "km_inicio", "km_fin", "observed_at_utc", "ingested_at_utc", "metric_name", "metric_value", "unit", "evidence_type", "fuente", "source_version", "uncertainty_lower", "uncertainty_upper", "quality_flag", "is_simulated", "simulation_scenario_id", "notes")
    return _as_published(shots, {n: 3 if n in ("metric_value", "uncertainty_lower", "uncertainty_upper") else None for n in names})


def published_events(events: DataFrame) -> DataFrame:
    # fixed values: the published header
    names = ("change_event_id", "segment_id", "baseline_snapshot_at_utc", "current_snapshot_at_utc", "metric_name", "baseline_value", "current_value", "delta_abs", "delta_pct", "change_direction", "change_class", "confidence", "is_simulated", "simulation_scenario_id", "fuente", "source_version")
    return _as_published(events, {n: {"delta_pct": 6, "confidence": 1}.get(n, 3 if n in ("baseline_value", "current_value", "delta_abs") else None) for n in names})


def run_violations(shots: DataFrame, events: DataFrame, plan: ChangePlan) -> DataFrame:
    """rule and n: what keeps a simulated run from being published, one pass over each table. No rows: it may be."""
    simulated = lambda: F.coalesce(F.col("is_simulated") & (F.col("simulation_scenario_id") == plan.scenario_id) & F.col("fuente").startswith("simulation:"), F.lit(False))
    rules = [
        (shots, 2 * plan.segments, {"snapshot_not_simulated": simulated() & (F.col("evidence_type") == "simulated"), "band_without_value": F.col("metric_value").between(F.col("uncertainty_lower"), F.col("uncertainty_upper"))}, "snapshot_count"),
        (events, plan.segments, {"event_not_simulated": simulated(), "event_with_confidence": F.col("confidence") == 0.0}, "event_count"),
    ]
    parts = []
    for frame, wanted, own, name in rules:
        counts = frame.agg(F.abs(F.count("*") - wanted).alias(name), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in own.items()))
        parts.append(counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in (name, *own))))))
    return parts[0].union(parts[1]).where("n > 0")


def rank_stability(scores: DataFrame, entity: str, scenario: str, score: str) -> DataFrame:
    """Median, p10 and p90 of an entity's ranks over the scenarios, and its shares of ranks within 10 and 20."""
    ranked = with_rank_within(scores, [scenario], score, "__rank")
    q = F.percentile("__rank", [0.5, 0.1, 0.9])
    found = ranked.groupBy(entity).agg(q.alias("q"), true_share(F.col("__rank") <= 10).alias("p_top10"), true_share(F.col("__rank") <= 20).alias("p_top20"))
    return found.select(entity, F.col("q")[0].alias("rank_median"), F.col("q")[1].alias("rank_p10"), F.col("q")[2].alias("rank_p90"), "p_top10", "p_top20")
