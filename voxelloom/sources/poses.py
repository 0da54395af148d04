"""Scan and pose tables: schemas, as-of joins, latest pose."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import linalg as L


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, getattr(T, k)()) for n, k in (x.split(":") for x in text.split())])


POINTS = _schema("scan_id:LongType ts:TimestampType point_idx:LongType x:FloatType y:FloatType z:FloatType")
POSES = _schema("ts:TimestampType tx:FloatType ty:FloatType tz:FloatType qw:FloatType qx:FloatType qy:FloatType qz:FloatType")
GOALS = _schema("plan_id:LongType seq:IntegerType x:FloatType y:FloatType z:FloatType yaw:FloatType pos_tol:FloatType yaw_tol:FloatType v_max:FloatType a_max:FloatType")
FEEDBACK = _schema("plan_id:LongType active_index:IntegerType remaining:FloatType progress:FloatType state:StringType")


def pose_as_of(scans: DataFrame, poses: DataFrame, how: str = "skip", by: str = "drone_id") -> DataFrame:
    """Each scan with the latest pose of its drone at or before its time.

    One union, one sort per drone and one `last non-null`: no range join, so the work grows with the
    rows, not with pairs. Of poses of one time the largest event_id counts. how: skip drops scans
    before the first pose; keep leaves them with nulls.
    """
    pose = F.struct("ts", "event_id", *[c for c in poses.columns if c not in (by, "ts", "event_id")])
    a = poses.select(by, "ts", F.lit(0).alias("kind"), F.col("event_id").alias("tie"), pose.alias("pose"), F.lit(None).cast("long").alias("scan_id"))
    b = scans.select(by, "ts", F.lit(1).alias("kind"), F.col("scan_id").alias("tie"), F.lit(None).cast(a.schema["pose"].dataType).alias("pose"), "scan_id")
    w = Window.partitionBy(by).orderBy("ts", "kind", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("pose", F.last("pose", ignorenulls=True).over(w)).where("kind = 1")
    out = out.select(by, "scan_id", "ts", F.col("pose.ts").alias("pose_ts"), *[F.col(f"pose.{c}").alias(c) for c in poses.columns if c not in (by, "ts")])
    return out.where("pose_ts is not null") if how == "skip" else out


def latest_pose(poses: DataFrame, by: str = "drone_id") -> DataFrame:
    """The newest pose of each drone (partial and final aggregation)."""
    rest = [c for c in poses.columns if c != by]
    best = poses.groupBy(by).agg(F.max(F.struct("ts", "event_id", *[c for c in rest if c not in ("ts", "event_id")])).alias("p"))
    return best.select(by, "p.*")


def path_poses(path: DataFrame) -> DataFrame:
    """Stamped poses: yaw as a quaternion."""
    q = L.quaternion_of_yaw(F.col("yaw"))
    return path.select("plan_id", "seq", "x", "y", "z", *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


PI = math.pi
# The scripted flight's poses x, y, z, yaw.
FLIGHT = (
    (0, 0, 5, 0),
    (0, 3, 5, -PI / 4),
    (5, 3, 5, -PI / 2),
    (10, 3, 5, -PI / 2),
    (20, 3, 5, -PI / 2),
    (30, 3, 5, -PI * 3 / 4),
    (30, -3, 5, PI * 3 / 4),
    (20, -3, 5, PI / 2),
    (10, -3, 5, PI / 2),
    (5, -3, 5, PI / 2),
    (0, -3, 5, PI / 4),
    (0, 0, 2, 0),
)


def scripted_flight(spark: SparkSession) -> DataFrame:
    """Plan 0 with the scripted poses."""
    rows = [(0, i, *map(float, q)) for i, q in enumerate(FLIGHT)]
    return spark.createDataFrame(rows, "plan_id long, seq int, x double, y double, z double, yaw double")


def active_goals(events: DataFrame, by: str) -> DataFrame:
    """events(by, ts, goal_id, kind, n_points): the newest accepted goal that no cancel follows.

    Empty paths are rejected; a new goal pre-empts.
    """
    ok = events.where((F.col("kind") == "cancel") | (F.col("n_points") > 0))
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("goal_id").desc())
    top = ok.withColumn("rank", F.row_number().over(w)).where("rank = 1 and kind = 'goal'")
    return top.select(by, "goal_id", "ts")
