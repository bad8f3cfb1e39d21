"""Rollup of interval evidence onto segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import joined_set
from waymark.operators.joins import overlap_binned
from waymark.schemas import CATEGORIES, LEVELS


def highest_level(level: str, levels: tuple[str, ...] = LEVELS):
    """Aggregate: the highest known level, null if there is none. Unknown levels don't count."""
    order = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    return F.max_by(F.when(order > 0, F.col(level)), F.when(order > 0, order))


def rollup(segments: DataFrame, hazards: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row for each segment (km_inicio, km_fin): counts, flags, highest level and joined texts of the hazards that overlap it."""
    facts = hazards.withColumnsRenamed({"km_inicio": "h_inicio", "km_fin": "h_fin"})
    keys = ["km_inicio", "km_fin"]
    met = overlap_binned(segments.select(*keys), facts, ("km_inicio", "km_fin"), ("h_inicio", "h_fin"))
    counts = [F.count_if(F.col("categoria") == c).cast("int").alias(f"n_{c}_campo") for c in categories]
    found = met.groupBy(*keys).agg(F.count("*").cast("int").alias("n_peligros_campo"), highest_level("nivel").alias("nivel_campo_max"), *counts, joined_set(F.col("peligro")).alias("peligros_campo"), joined_set(F.col("estacionalidad")).alias("estacionalidades_campo"))
    whole = segments.select(*keys).join(found, keys, "left")
    numbers = ["n_peligros_campo", *(f"n_{c}_campo" for c in categories)]
    whole = whole.fillna(0, numbers).fillna("", ["peligros_campo", "estacionalidades_campo"])
    return whole.withColumns({f"campo_{c}": (F.col(f"n_{c}_campo") > 0).cast("int") for c in categories})


def any_flag(flags: list[str]):
    """1 if any of the 0/1 columns is 1."""
    met = F.lit(False)
    for f in flags:
        met = met | (F.col(f) == 1)
    return F.coalesce(met, F.lit(False)).cast("int")
