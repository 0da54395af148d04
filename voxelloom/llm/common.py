"""What the training-data operators share: the shared folder, cut lineage, worker imports."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


ROWS_PER_BATCH = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by its own sys.path.

    Arrow batches are held to ROWS_PER_BATCH rows where the session leaves Spark's default:
    whole texts make wide rows, and two batches at once stand in a worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_PER_BATCH)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if REPO not in known.split(":"):
        env["PYTHONPATH"] = f"{REPO}:{known}" if known else REPO
    return spark


_kept: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What one operator keeps in a worker between its tasks.

    Call it from a function of a module only: a function inside another one travels to the workers
    by value, with globals of its own for each task.
    """
    return _kept.setdefault(name, {})


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def clean_worker(keep: str = "") -> None:
    """Drop what other operators keep and what earlier tasks left."""
    for name in list(_kept):
        if name != keep:
            del _kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back()


def tidy(run, keep: str = ""):
    """A function for mapInArrow that leaves its worker as small as it found it, but for one operator's cache."""

    def task(batches):
        clean_worker(keep)
        yield from run(batches)
        clean_worker(keep)

    return task


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is unset and Spark runs on one machine (tests) a temporary folder is
    made and removed at exit; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="voxelloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts lineage so that lost executors cost a re-read only, computes shared inputs once, and
    gives the planner true sizes: a later join is broadcast only if the written table is below
    spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
