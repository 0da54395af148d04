"""Cut lineage safely: checkpoints go to the folder that the session names, or to one of its own in tests."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine without it, a temporary one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="voxelloom-")
        atexit.register(shutil.rmtree, base, True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def meet(many: DataFrame, few: DataFrame, on, most: int = 100_000) -> DataFrame:
    """Inner join of rows that grew in the plan (explodes) with a table that is cheap to count.

    Spark takes exploded rows for as few as they were before, and would broadcast them through the
    driver. So `few` is counted: up to `most` of its rows go to every task, which also spares `many`
    a shuffle; more meet by a sort-merge join, whatever their number.
    """
    small = few.limit(most + 1).count() <= most
    return many.join(F.broadcast(few) if small else few.hint("merge"), on)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as the session shuffles to, before small rows become many (Spark would leave a small table in one task)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
