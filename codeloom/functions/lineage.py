"""Cutting lineage in loops, in the folder that all executors share; and what Python workers import."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in spark.checkpoint.dir; a temporary folder of our own only where that is unset, as in tests."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="codeloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        context.setCheckpointDir(f"file://{_own[0]}")
    return df.checkpoint(eager=True)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder that was started in."""
    root = str(Path(__file__).resolve().parents[2])
    have = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
