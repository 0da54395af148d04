"""Keyed state of long streams: voxel sums (M10) and coverage sets (C1, C2) in RocksDB.

The state lives in the stream's checkpoint, so a stream that starts again goes on from it, and what
it holds is read as a table by Spark's state source. Both are native aggregates, so a task sends one
row a key. A hot voxel's sums are dealt over `salts` keys and add up when they are read; a coverage
set has a key for each voxel and viewpoint.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import surfel as SU
from ..operators.voxel import KEY
from ..params import SurfelParams

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Entries of a state list that Python is handed at once: LastPose's hold thousands of rows.
ENTRIES = "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch"
COUNTS = ("count", "n_points")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; the session's own settings come back after."""
    own = {STORE: ROCKSDB, ENTRIES: "10"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _start(kept: DataFrame, checkpoint: str, every: str | None, sink) -> StreamingQuery:
    """every: a processing-time trigger; None: all that is there, batch by batch, then the end."""
    out = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    out = out.foreachBatch(sink) if sink else out.format("noop")
    with rocksdb(kept.sparkSession):
        return out.trigger(processingTime=every).start() if every else out.trigger(availableNow=True).start()


def stream_voxel_sums(points: DataFrame, checkpoint: str, p: SurfelParams = SurfelParams(), salts: int = 8, every: str | None = None, sink=None) -> StreamingQuery:
    """M10 on a stream of points(x, y, z, nx, ny, nz, w) in the map's frame.

    Every micro-batch adds its points to the state; the voxels it touched go to `sink` (foreachBatch)
    with their new sums. Points with null coordinates have no voxel and are left out; of other points,
    a term that is null or NaN adds nothing. `salts` and the session's number of shuffle partitions
    stay what they were when the stream first started.
    """
    points = points.where("x is not null and y is not null and z is not null")
    # A task adds up what it has of a voxel first; tasks, not points, are dealt over the salts.
    terms = SU.moment_terms(points, p).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    known = lambda c: F.col(c) if c in COUNTS else F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    kept = terms.groupBy(*KEY, "salt").agg(*[F.sum(known(c)).alias(c) for c in SU.SUMS])
    return _start(kept, checkpoint, every, sink)


def voxel_sums(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What stream_voxel_sums holds: SUMS per voxel, for surfel.merge and surfel.finalise."""
    parts = spark.read.format("statestore").option("path", checkpoint).load()
    kinds = ", ".join(f"{c}: {'bigint' if c in COUNTS else 'double'}" for c in SU.SUMS)
    value = F.col("value").cast(f"struct<{kinds}>")  # all named after their function there
    return SU.merge(parts.select("key.*", value.alias("value")).select(*KEY, "value.*"))


def stream_coverage(visible: DataFrame, checkpoint: str, salts: int = 8, every: str | None = None, sink=None) -> StreamingQuery:
    """C1, C2 on a stream of visible(vp_id, vx, vy, vz, ts): which viewpoints saw each voxel, and when first.

    A viewpoint that is told again, in one batch or after a restart, counts once. Rows with null ids
    or keys are left out. The set is a native aggregate, as one entry at a time through a Python worker
    took ten times as long. `sink` (foreachBatch) gets (vx, vy, vz, salt, n_new): the
    voxels that a batch told of, each in up to `salts` parts, and how many viewpoints are new to them.
    """
    rows = visible.dropna(subset=["vp_id", "ts", *KEY]).withColumn("now", F.current_timestamp())  # its batch's
    kept = rows.groupBy(*KEY, "vp_id").agg(F.min("ts").alias("since"), F.min("now").alias("first"), F.max("now").alias("last"))

    def parts(told: DataFrame, batch: int) -> None:
        salted = told.groupBy(*KEY, F.pmod(F.xxhash64("vp_id"), F.lit(salts)).cast("int").alias("salt"))
        # First and last differ for what an earlier batch told.
        sink(salted.agg(F.count_if(F.col("first") == F.col("last")).alias("n_new")), batch)

    return _start(kept, checkpoint, every, parts if sink else None)


def coverage(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What stream_coverage holds: (vx, vy, vz, vp_id, since), one row per voxel and viewpoint."""
    seen = spark.read.format("statestore").option("path", checkpoint).load()
    value = F.col("value").cast("struct<since timestamp, first timestamp, last timestamp>")  # named after their functions there
    return seen.select("key.*", value.alias("value")).select(*KEY, "vp_id", "value.since")
