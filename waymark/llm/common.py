"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z only, unlike lower()."""
    return F.translate(column, UPPER, LOWER)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and the
    master is this very machine, as in tests, a temporary folder takes its place; a cluster without one is refused.
    """
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return frame.checkpoint()


def free_name(wanted: str, taken) -> str:
    """``wanted``, or it with underscores behind, so that it clashes with no name in ``taken``."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted


