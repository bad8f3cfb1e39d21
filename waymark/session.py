"""Session settings shared by the tests, the benchmark and the command line."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for one machine; on a cluster, pass your own session to the operators instead."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(master).appName("waymark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


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


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder of this name in the folder that all executors share."""
    context = spark.sparkContext
    cut_lineage(spark.range(1))  # sets the folder where it is unset, and refuses a cluster without one
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
