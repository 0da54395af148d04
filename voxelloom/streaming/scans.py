"""Scan streams (S1-S3) and the pose of each scan on streams (S5-S7), with bounded state and back-pressure.

`read_files` takes at most so many files a micro-batch. A pose may come late: both streams are
watermarked, state holds what the watermark hasn't passed, and rows that come later still are
dropped and counted (`late_rows`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import preprocess as PR
from ..params import ScanParams
from ..sources.poses import pose_as_of
from .keyed import rocksdb


def read_files(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream of Parquet files, oldest first, at most `files` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress reports that the query holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


# --- the pose of a scan ----------------------------------------------------------------------


def join_poses(scans: DataFrame, poses: DataFrame, late: str = "10 seconds", reach: str = "1 second", how: str = "skip", by: str = "drone_id") -> DataFrame:
    """Each scan(by, scan_id, ts) with its drone's newest pose(by, event_id, ts, ...) of the `reach` up to it.

    A stream-stream join within an interval, then an aggregate by scan, both in append mode: state
    holds `late` and `reach` of time. A scan comes out once the watermark has passed its time. how:
    skip drops scans without a pose in reach, null leaves them with nulls. Of poses of one time the
    largest event_id counts.
    """
    rest = [c for c in poses.columns if c not in (by, "ts")]
    a = scans.select(by, "scan_id", "ts").withWatermark("ts", late).alias("s")
    b = poses.withColumnRenamed("ts", "pose_ts").withWatermark("pose_ts", late).alias("p")
    near = F.expr(f"s.{by} = p.{by} and p.pose_ts <= s.ts and p.pose_ts >= s.ts - interval {reach}")
    joined = a.join(b, near, "inner" if how == "skip" else "leftOuter")
    joined = joined.select(f"s.{by}", "s.scan_id", "s.ts", F.col("p.pose_ts").alias("pose_ts"), *[F.col(f"p.{c}").alias(c) for c in rest])
    first = ["pose_ts", "event_id"]
    best = F.max(F.when(F.col("pose_ts").isNotNull(), F.struct(*first, *[c for c in rest if c not in first]))).alias("pose")
    newest = joined.groupBy(by, "scan_id", "ts").agg(best)
    return newest.select(by, "scan_id", "ts", "pose.pose_ts", *[F.col(f"pose.{c}").alias(c) for c in rest])


#: Rows of a state entry, as many as Spark puts into a frame.
MOST = 10_000


class LastPose(StatefulProcessor):
    """One drone's rows until the watermark passes them, and its last pose from then on, whatever its age.

    Spark pickles each state entry with its schema, which costs far more than a row: the rows that a
    call is given wait as one entry, a list for each column. Times are microseconds here, and pandas
    frames, one a drone, hold no timestamps, which cost most there.
    """

    def __init__(self, fields: list[str], types: list[str], whole: set[str], skip: bool):
        self.fields, self.types, self.whole, self.skip = fields, types, whole | {"pose_us", "event_id"}, skip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = [*zip(self.fields, self.types, strict=True)]
        self.waiting = handle.getListState("waiting", ", ".join(["ts_us array<long>", "kind array<int>", "tie array<long>", *(f"`{c}` array<{t}>" for c, t in own)]))
        self.last = handle.getValueState("last", ", ".join(["ts_us long", "event_id long", *(f"`{c}` {t}" for c, t in own)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            # Scans have nulls here, and pandas holds whole numbers beside nulls as floats.
            own = [[None if v is None or v != v else int(v) if c in self.whole else v for v in pdf[c].tolist()] for c in self.fields]
            self.waiting.appendValue((pdf["ts_us"].tolist(), pdf["kind"].tolist(), pdf["tie"].tolist(), *own))
            top = int(pdf["ts_us"].max())
            latest = top if latest is None else max(latest, top)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted((r for entry in self.waiting.get() for r in zip(*entry, strict=True)), key=lambda r: r[:3])
        ready = [r for r in rows if r[0] <= until]
        if not ready:
            return
        last, out = self.last.get(), []
        for at, kind, tie, *own in ready:
            if kind == 0:
                last = (at, tie, *own)
            elif last is not None or not self.skip:
                out.append((tie, at, *(last or [None] * (2 + len(self.fields)))))
        if last is not None:
            self.last.update(last)
        rest = [rows[i : i + MOST] for i in range(len(ready), len(rows), MOST)]
        if rest:
            self.waiting.put([tuple(map(list, zip(*part, strict=True))) for part in rest])
        else:
            self.waiting.clear()
        if out:
            columns = dict(zip(("scan_id", "ts_us", "pose_us", "event_id", *self.fields), map(list, zip(*out, strict=True)), strict=True))
            # Beside None, pandas would make floats of whole numbers.
            columns |= {c: pd.array(columns[c], "Int64") for c in self.whole if None in columns[c]}
            yield pd.DataFrame({"by": [key[0]] * len(out)} | columns)

    def close(self) -> None:
        pass


def keep_poses(scans: DataFrame, poses: DataFrame, late: str = "10 seconds", how: str = "keep", by: str = "drone_id") -> DataFrame:
    """Each scan with its drone's newest pose at or before it, whatever its age: pose_as_of on streams.

    Both streams go to one keyed state that sorts a drone's rows once the watermark has passed them
    and keeps one pose from then on. how: keep leaves scans before the first pose with nulls, skip
    drops them. Start the result inside keyed.rocksdb. A drone is one key, as in pose_as_of.
    """
    rest = [f for f in poses.schema if f.name not in (by, "ts", "event_id")]
    fields, types = [f.name for f in rest], [f.dataType.simpleString() for f in rest]
    stamp = F.col("ts").cast("timestamp")
    time = [stamp.alias("ts"), F.unix_micros(stamp).alias("ts_us")]
    a = poses.select(by, *time, F.lit(0).alias("kind"), F.col("event_id").alias("tie"), *fields)
    b = scans.select(by, *time, F.lit(1).alias("kind"), F.col("scan_id").alias("tie"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    whole = {f.name for f in rest if isinstance(f.dataType, T.IntegralType)}
    kind = poses.schema[by].dataType.simpleString()
    schema = ", ".join([f"`by` {kind}", "scan_id long", "ts_us long", "pose_us long", "event_id long", *(f"`{c}` {t}" for c, t in zip(fields, types, strict=True))])
    both = a.unionByName(b).dropna(subset=[by, "ts", "tie"]).withWatermark("ts", late)
    out = both.groupBy(by).transformWithStateInPandas(LastPose(fields, types, whole, how == "skip"), schema, "Append", "EventTime")
    own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in poses.schema if f.name not in (by, "ts")]
    return out.select(F.col("by").alias(by), "scan_id", F.timestamp_micros("ts_us").alias("ts"), F.timestamp_micros("pose_us").alias("pose_ts"), *own)


# --- scans -----------------------------------------------------------------------------------


def cleaned_scans(batch: DataFrame, poses: DataFrame, p: ScanParams = ScanParams(), how: str = "skip", by: str = "drone_id", world: bool = True) -> DataFrame:
    """A batch of raw points to points with normals, in the world of their scans' poses.

    batch(by, scan_id, ts, point_idx, x, y, z); poses(by, event_id, ts, px, py, pz, yaw). The ground
    filter uses the pose's height. how: skip leaves out scans without a pose; keep, with world=False,
    keeps them in the sensor's frame, where a scan before the first pose has no ground filter. Columns:
    by, scan_id, ts, u, v, x, y, z, nx, ny, nz, w.
    """
    scans = batch.select(by, "scan_id", "ts").distinct()
    posed = pose_as_of(scans, poses, how, by)
    own = batch.join(posed.select(by, "scan_id", *[F.col(c).alias(f"_{c}") for c in ("px", "py", "pz", "yaw")]), [by, "scan_id"])
    own = own.withColumns({"drone": F.col(by), "_scan": F.struct(by, "scan_id", "ts", "_px", "_py", "_pz", "_yaw")})
    # The operators know one key of a scan; the struct goes through them under its name.
    points = own.select(F.col("_scan").alias("scan_id"), "point_idx", "x", "y", "z", F.coalesce(F.col("_pz"), F.lit(float("inf"))).alias("_height"), F.lit(0.0).alias("_zero"), F.lit(1.0).alias("_one"))
    clean = PR.preprocess(points, p, ("_zero", "_zero", "_one", "_height"))
    s = lambda c: F.col(f"scan_id.{c}")
    flat = clean.select(s(by).alias(by), s("scan_id").alias("_id"), s("ts").alias("ts"), *[s(f"_{c}").alias(f"_{c}") for c in ("px", "py", "pz", "yaw")], "u", "v", "x", "y", "z", "nx", "ny", "nz", "w")
    if world:
        flat = PR.to_world(flat, "_yaw", ("_px", "_py", "_pz"), with_normals=True)
    return flat.select(by, F.col("_id").alias("scan_id"), "ts", "u", "v", "x", "y", "z", "nx", "ny", "nz", "w")


def scan_sink(poses: Callable[[], DataFrame], *sinks: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: cleans a batch of scans once and hands it to each sink (S1: a map, S2: a fusion, S3: a folder).

    poses() tells the poses known by now: a table that grows beside the stream.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        clean = cleaned_scans(batch, poses(), **how).persist()
        try:
            for sink in sinks:
                sink(clean, batch_id)
        finally:
            clean.unpersist()

    return process


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """S3: each batch's cleaned points under its number, so that a batch that runs again replaces its own."""

    def write(clean: DataFrame, batch_id: int) -> None:
        clean.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def start(points: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """every: a processing-time trigger; None: all that is there, batch by batch, then the end."""
    out = points.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=every).start() if every else out.trigger(availableNow=True).start()


def start_kept_poses(scans: DataFrame, poses: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """keep_poses as files under `path`, all that is there, batch by batch."""
    with rocksdb(scans.sparkSession):
        return keep_poses(scans, poses, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
