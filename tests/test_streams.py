"""Real streams over files, restarted in between, against the batch operators and plain re-derivations."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import surfel, visibility
from voxelloom.params import SurfelParams
from voxelloom.plans import queries as Q
from voxelloom.sources.fixtures import fixture
from voxelloom.streaming import keyed

SF = "/root/testdata/sf0.001"
MAP = SurfelParams(min_points=10)


def write_parts(df, path, parts):
    """One file for each of `parts` (a column expression), written in its order: later files are newer."""
    for i, cond in enumerate(parts):
        df.where(cond).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-") and "-done" not in f:
                os.rename(f"{path}/{f}", f"{path}/part-{i:03d}-done-{f}")
                os.utime(f"{path}/part-{i:03d}-done-{f}", (1_700_000_000 + i, 1_700_000_000 + i))


def equal(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def files(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def test_voxel_state_equals_batch_after_a_restart(spark, tmp_path):
    pwn = fixture(spark, SF, "fx_pwn").withColumn("x", F.when(F.col("l_orderkey") % 50 == 0, None).otherwise(F.col("x")))
    path, cp = str(tmp_path / "points"), str(tmp_path / "cp")
    batches = []
    write_parts(pwn, path, ["scan_id <= 2", "scan_id in (3, 4)"])
    for more in ([], ["scan_id in (5, 6)", "scan_id = 7"]):  # a second run goes on from the first
        write_parts(pwn, path, more)
        q = keyed.stream_voxel_sums(files(spark, path, pwn.schema), cp, MAP, salts=3, sink=lambda df, i: batches.append((i, df.count())))
        q.awaitTermination()
    assert [i for i, _ in batches] == [0, 1, 2, 3] and all(n > 0 for _, n in batches)
    cols = ["vx", "vy", "vz", "count", "n_points", *[f"round({c}, 9) {c}" for c in ("mx", "my", "mz", "sxx", "nx")], "is_valid"]
    got = surfel.finalise(keyed.voxel_sums(spark, cp), MAP).selectExpr(*cols)
    want = surfel.surfels(pwn.where("x is not null"), MAP).selectExpr(*cols)
    assert want.count() > 20 and equal(got, want)
    assert spark.conf.get(keyed.STORE, "") != keyed.ROCKSDB


def test_voxel_sums_leave_a_task_added_up(spark, tmp_path):
    """A task sends a row for each voxel it has points of, not one a point; odd points count as before, in several batches."""
    nan, inside = float("nan"), (0.1, 0.1, 0.1, -1.0, 0.0, 0.0)
    odd = [(*inside, nan), (*inside, None), (*inside, 0.05), (0.1, nan, 0.1, -1.0, 0.0, 0.0, 0.5), (0.1, 0.2, 0.1, None, nan, 0.0, 0.5), (None, 0.1, 0.1, -1.0, 0.0, 0.0, 1.0), (0.4, -0.1, 0.1, None, None, None, None)]
    twice = [(*inside, 0.75)] * 2
    path, cp, told, plans = str(tmp_path / "points"), str(tmp_path / "cp"), [], []
    schema = "x double, y double, z double, nx double, ny double, nz double, w double"
    for rows_ in (odd + twice * 500, twice):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
        q = keyed.stream_voxel_sums(files(spark, path, spark.createDataFrame(odd, schema).schema), cp, MAP, salts=3, sink=lambda df, i: told.append((df.columns, df.collect())))
        q.awaitTermination()
        plans.append(q._jsq.lastProgress().stateOperators()[0])
    assert [p.operatorName() for p in plans] == ["stateStoreSave"] * 2 and [p.numRowsUpdated() for p in plans] == [2, 1]
    assert [c for c, _ in told] == [["vx", "vy", "vz", "salt", *surfel.SUMS]] * 2 and [len(r) for _, r in told] == [2, 1]
    got = {(r.vx, r.vy, r.vz): r for r in keyed.voxel_sums(spark, cp).collect()}
    assert set(got) == {(0, 0, 0), (1, -1, 0)}
    near = got[0, 0, 0]
    assert (near["count"], near.n_points) == (1005, 1007) and abs(near.sum_w - (1002 * 0.75 + 1.0)) < 1e-9
    assert abs(near.wy - (1002 * 0.75 * -0.05 + 0.5 * 0.05)) < 1e-9 and abs(near.wnx + 1002 * 0.75 + 0.5) < 1e-9 and near.wny == 0
    assert [got[1, -1, 0][c] for c in surfel.SUMS] == [0, 1, *[0.0] * 13]


def test_coverage_state_equals_batch_after_a_restart(spark, tmp_path):
    seen = visibility.visibility(fixture(spark, SF, "fx_viewpoints"), surfel.surfels(fixture(spark, SF, "fx_pwn"), MAP), 0.3)
    told = seen.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vp_id")))
    again = told.where("vp_id <= 3").withColumn("ts", F.col("ts") - F.expr("interval 1 hour"))
    lost = told.limit(1).withColumn("vp_id", F.lit(None).cast("long"))
    path, cp = str(tmp_path / "seen"), str(tmp_path / "cp")
    for part in (told.where("vp_id <= 4"), told.where("vp_id > 2").unionByName(again).unionByName(lost)):
        part.coalesce(1).write.mode("append").parquet(path)
        keyed.stream_coverage(files(spark, path, told.schema), cp, salts=2).awaitTermination()
    got = keyed.coverage(spark, cp)
    want = told.unionByName(again).groupBy("vx", "vy", "vz", "vp_id").agg(F.min("ts").alias("since"))
    assert seen.count() > 100 and equal(got, want)
    assert equal(visibility.observe(got), visibility.observe(seen))


def test_coverage_tells_new_viewpoints_without_python_rows(spark, tmp_path):
    """Per batch and voxel part the viewpoints new to it, zero for what is told again; the set is kept by the JVM alone."""
    rows_ = lambda *told: spark.createDataFrame([(vp, x, 0, 0, 1_700_000_000 + s) for vp, x, s in told], "vp_id long, vx int, vy int, vz int, s long").selectExpr("vp_id", "vx", "vy", "vz", "timestamp_seconds(s) ts")
    path, cp, got, plans = str(tmp_path / "seen"), str(tmp_path / "cp"), [], []
    for told in (rows_((1, 0, 5), (2, 0, 5), (1, 0, 3), (1, 7, 5)), rows_((1, 0, 9), (3, 0, 9), (2, 0, 1)), rows_((1, 7, 5))):
        told.coalesce(1).write.mode("append").parquet(path)
        q = keyed.stream_coverage(files(spark, path, told.schema), cp, salts=1, sink=lambda df, i: got.append((i, sorted((r.vx, r.salt, r.n_new) for r in df.collect()))))
        q.awaitTermination()
        plans.append(q._jsq.lastProgress().stateOperators()[0].operatorName())
    assert got == [(0, [(0, 0, 2), (7, 0, 1)]), (1, [(0, 0, 1)]), (2, [(7, 0, 0)])]
    assert set(plans) == {"stateStoreSave"}
    since = {(r.vx, r.vp_id): r.s - 1_700_000_000 for r in keyed.coverage(spark, cp).selectExpr("*", "unix_seconds(since) s").collect()}
    assert since == {(0, 1): 3, (0, 2): 1, (0, 3): 9, (7, 1): 5}


# --- poses and scans


def pose_files(spark, tmp_path):
    """Pose and scan events of one time base in four files each, a sentinel that lets the watermark pass all, and late poses."""
    poses = fixture(spark, SF, "fx_pose_events").withColumn("ts", F.col("ts").cast("timestamp"))
    scans = fixture(spark, SF, "fx_scan_events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = [f"ts >= '2024-01-{a:02d}' and ts < '2024-01-{a:02d}' + interval 8 days" for a in (1, 9, 17, 25)]
    end = "timestamp '2024-03-01'"
    late = poses.limit(5).selectExpr("-1L as drone_id", "event_id", "timestamp '2024-01-02' as ts", "px", "py", "pz", "yaw")
    for df, name in ((poses, "poses"), (scans, "scans")):
        write_parts(df, str(tmp_path / name), week)
        last = df.limit(1).withColumn("ts", F.expr(end)).withColumn("drone_id", F.lit(-9).cast("long"))
        if name == "poses":
            last = last.unionByName(late)
        for k in range(2):
            last.withColumn("ts", F.expr(f"ts + interval {k} days") if k else F.col("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, df: files(spark, str(tmp_path / name), df.schema)
    return poses, scans, read("poses", poses), read("scans", scans)


@pytest.mark.parametrize("how", ["skip", "null"])
def test_streamed_pose_join_equals_as_of(spark, tmp_path, how):
    from voxelloom.sources.poses import pose_as_of
    from voxelloom.streaming import scans as S

    poses, scans, pose_stream, scan_stream = pose_files(spark, tmp_path)
    out = S.join_poses(scan_stream, pose_stream, late="1 hour", reach="3 days", how=how)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 4 and S.late_rows(q) >= 5
    got = spark.read.parquet(str(tmp_path / "out")).where("drone_id >= 0").select("drone_id", "scan_id", "ts", "pose_ts", "event_id", "px")
    near = F.expr("pose_ts >= ts - interval 3 days")
    want = pose_as_of(scans, poses, "keep").select("drone_id", "scan_id", "ts", *[F.when(near, F.col(c)).alias(c) for c in ("pose_ts", "event_id", "px")])
    want = want.where("pose_ts is not null") if how == "skip" else want
    assert want.count() > 50 and equal(got, want)


@pytest.mark.parametrize("how", ["skip", "keep"])
def test_streamed_last_pose_equals_as_of(spark, tmp_path, how):
    from voxelloom.sources.poses import pose_as_of
    from voxelloom.streaming import scans as S

    poses, scans, pose_stream, scan_stream = pose_files(spark, tmp_path)
    q = S.start_kept_poses(scan_stream, pose_stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour", how=how)
    q.awaitTermination()
    assert S.late_rows(q) >= 5
    cols = ["drone_id", "scan_id", "ts", "pose_ts", "event_id", "px", "yaw"]
    got = spark.read.parquet(str(tmp_path / "out")).where("drone_id >= 0").select(*cols)
    want = pose_as_of(scans, poses, how).select(*cols)
    assert want.count() > 100 and equal(got, want)


@pytest.mark.parametrize("how", ["skip", "keep"])
def test_last_pose_of_odd_rows_equals_as_of(spark, tmp_path, how):
    """Null keys, times and ids, rows that come twice, poses of one time, null and NaN values, in several batches."""
    from voxelloom.sources.poses import pose_as_of
    from voxelloom.streaming import scans as S

    big = 2**40 + 1
    pose_rows = [("a", 1, 10, 0.5, big, "x"), ("a", 2, 10, None, None, None), ("a", 3, 20, 1.5, 7, "y"), ("a", 3, 20, 1.5, 7, "y"), (None, 4, 5, 2.5, 1, "z"), ("b", 5, None, 2.5, 1, "z"), ("c", 6, 30, -0.0, 2, ""), ("c", None, 31, 9.5, 2, "w"), ("d", 7, 90, 3.5, None, None)]
    scan_rows = [("a", 1, 5), ("a", 2, 10), ("a", 3, 15), ("a", 3, 15), ("a", 4, 20), ("a", 5, 95), ("b", 6, 40), ("c", 7, 30), (None, 8, 50), ("c", None, 50), ("d", 9, None), ("d", 10, 89), ("d", 11, 90)]
    at = "timestamp_micros(1700000000123456 + s * 1000000) ts"
    poses = spark.createDataFrame(pose_rows, "drone_id string, event_id int, s long, px double, lap long, note string").selectExpr("drone_id", "event_id", at, "px", "lap", "note")
    scans = spark.createDataFrame(scan_rows, "drone_id string, scan_id long, s long").selectExpr("drone_id", "scan_id", at)
    for name, df in (("poses", poses), ("scans", scans)):
        write_parts(df, str(tmp_path / name), ["ts is null or ts < timestamp_seconds(1700000026)", "ts >= timestamp_seconds(1700000026)"])
        for k in range(2):
            ids = {c: F.lit(-1).cast(df.schema[c].dataType) for c in ("event_id", "scan_id") if c in df.columns}
            df.limit(1).withColumns({"drone_id": F.lit("end"), "ts": F.timestamp_seconds(F.lit(1700001000 + k)), **ids}).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, df: files(spark, str(tmp_path / name), df.schema)
    S.start_kept_poses(read("scans", scans), read("poses", poses), str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour", how=how).awaitTermination()
    # A last stream passes all times: the watermark is an hour late.
    for name, df in (("poses", poses), ("scans", scans)):
        ids = {c: F.lit(-2).cast(df.schema[c].dataType) for c in ("event_id", "scan_id") if c in df.columns}
        df.limit(1).withColumns({"drone_id": F.lit("end"), "ts": F.timestamp_seconds(F.lit(1700010000)), **ids}).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    S.start_kept_poses(read("scans", scans), read("poses", poses), str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour", how=how).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("drone_id <> 'end'")
    known = lambda df, c: df.where(f"drone_id is not null and ts is not null and {c} is not null")
    want = pose_as_of(known(scans, "scan_id"), known(poses, "event_id"), how)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert want.count() == (7 if how == "skip" else 10) and equal(got, want)


def test_last_pose_asks_its_state_by_batch(spark):
    """The rows that a call is given go into the state as one entry; a drone's frame holds no timestamps."""
    from voxelloom.streaming.scans import LastPose

    class State:
        def __init__(self):
            self.values, self.calls = [], 0

        def appendValue(self, value):
            self.calls += 1
            self.values.append(value)

        def put(self, values):
            self.calls += 1
            self.values = values

        def update(self, value):
            self.put([value])

        def get(self):
            return iter(self.values) if self.listed else self.values[0] if self.values else None

        def exists(self):
            return bool(self.values)

        def clear(self):
            self.calls, self.values = self.calls + 1, []

    class Handle:
        timers: list[int] = []

        def getListState(self, name, schema):
            self.waiting = State()
            self.waiting.listed = True
            return self.waiting

        def getValueState(self, name, schema):
            self.last = State()
            self.last.listed = False
            return self.last

        def registerTimer(self, at):
            self.timers.append(at)

    class Expired:
        def getExpiryTimeInMs(self):
            return handle.timers[0]

    handle, op = Handle(), LastPose(["px", "lap"], ["double", "long"], {"lap"}, True)
    op.init(handle)
    n = 1000
    rows = pd.DataFrame({"ts_us": [1_000_000 + 1000 * i for i in range(n)], "kind": [i % 2 for i in range(n)], "tie": range(n), "px": [0.5 * i if i % 2 == 0 else None for i in range(n)], "lap": [float(i) if i % 4 == 0 else None for i in range(n)]})
    assert not list(op.handleInputRows((1,), iter([rows[n // 2 :], rows[: n // 2]]), None))
    assert handle.waiting.calls == 2 and handle.timers == [1_000 + n]
    late = rows[:3].assign(ts_us=lambda d: d["ts_us"] + 10_000_000)
    list(op.handleInputRows((1,), iter([late]), None))
    (out,) = op.handleExpiredTimer((1,), None, Expired())
    assert out["scan_id"].tolist() == list(range(1, n, 2)) and out["event_id"].tolist() == list(range(0, n, 2))
    assert out["px"].tolist() == [0.5 * i for i in range(0, n, 2)] and out["lap"].dropna().tolist() == list(range(0, n, 4)) and str(out["lap"].dtype) == "Int64"
    assert not any(str(t).startswith("datetime") for t in out.dtypes)
    assert handle.waiting.calls == 4 and [len(c) for c in handle.waiting.values[0]] == [3] * 5 and handle.last.calls == 1
    # What still waits of a drone with many rows stays in entries of bounded size.
    many = pd.DataFrame({"ts_us": [0, *range(2_000_001, 2_025_001)], "kind": 1, "tie": range(25_001), "px": None, "lap": None})
    list(op.handleInputRows((1,), iter([many]), None))
    assert len(next(op.handleExpiredTimer((1,), None, Expired()))) == 1
    assert [len(e[0]) for e in handle.waiting.values] == [10_000, 10_000, 5_003]


def test_a_drone_with_most_rows_keeps_its_poses(spark, tmp_path):
    """One drone has nearly all rows, more than an entry of its state holds, in several entries a batch."""
    from voxelloom.sources.poses import pose_as_of
    from voxelloom.streaming import scans as S

    rows = spark.range(90_000).select(F.when(F.col("id") % 9 > 0, 1).otherwise(F.col("id") % 50).cast("long").alias("drone_id"), "id", F.timestamp_micros(1_700_000_000_000_000 + F.pmod(F.col("id") * 7919, F.lit(90_000)) * 1000).alias("ts"))
    end = spark.range(2).select(F.lit(-1).cast("long").alias("drone_id"), "id", F.timestamp_seconds(1_800_000_000 + F.col("id")).alias("ts"))
    name = {"poses": "event_id", "scans": "scan_id"}
    known = {k: rows.where(F.col("id") % 3 == 0 if k == "poses" else F.col("id") % 3 > 0).withColumnRenamed("id", v) for k, v in name.items()}
    known["poses"] = known["poses"].withColumn("px", F.col("event_id") * 0.5)
    for k, df in known.items():
        last = end.withColumnRenamed("id", name[k]).withColumns({"px": F.lit(0.0)} if k == "poses" else {}).select(df.columns)
        write_parts(df.withColumn("part", F.col(name[k]) % 2), str(tmp_path / k), ["part = 0", "part = 1"])
        for i in range(2):
            last.where(F.col(name[k]) == i).withColumn("part", F.lit(2).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / k))
    read = lambda k: files(spark, str(tmp_path / k), known[k].schema, 2)
    S.start_kept_poses(read("scans"), read("poses"), str(tmp_path / "out"), str(tmp_path / "cp"), late="1 day", how="keep").awaitTermination()
    assert spark.conf.get(keyed.ENTRIES) != "10"
    got = spark.read.parquet(str(tmp_path / "out")).where("drone_id >= 0")
    want = pose_as_of(known["scans"], known["poses"], "keep")
    assert want.count() == 60_000 and equal(got, want)


def test_scan_stream_equals_batch(spark, tmp_path):
    """Raw scans in files, poses in a table; the map and the cleaned points equal those of all scans at once."""
    from voxelloom.operators import preprocess
    from voxelloom.params import ScanParams
    from voxelloom.streaming import scans as S
    from voxelloom.streaming.drivers import SurfelMapStream

    p = ScanParams(width=60, height=45)
    drone = (F.col("scan_id") % 2).cast("long")
    points = fixture(spark, SF, "fx_points").select(drone.alias("drone_id"), F.col("scan_id").cast("long").alias("scan_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("scan_id")).alias("ts"), "point_idx", "x", "y", "z")
    at = [(d, k, 1_700_000_000 + k, 0.1 * k, 0.2 * d, 1.5, 0.1 * k) for d in (0, 1) for k in range(2, 9, 2)]  # scan 1 has no pose yet
    poses = spark.createDataFrame(at, "drone_id long, event_id long, s long, px double, py double, pz double, yaw double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path / "scans")
    write_parts(points, path, [f"scan_id = {k}" for k in range(1, 8)])
    surfels = SurfelMapStream(spark, str(tmp_path / "map"), MAP, prune="never")
    sink = S.scan_sink(lambda: poses, surfels.process, S.folder_sink(str(tmp_path / "clean")), p=p)
    q = S.start(S.read_files(spark, path, points.schema, 2), sink, str(tmp_path / "cp"))
    q.awaitTermination()
    assert [x.numInputRows > 0 for x in q.recentProgress] == [True] * 4
    whole = S.cleaned_scans(points, poses, p)
    cols = ["drone_id", "scan_id", "u", "v", *[f"round({c}, 9) + 0.0 {c}" for c in ("x", "y", "z", "nx", "ny", "nz", "w")]]
    got = spark.read.parquet(str(tmp_path / "clean"))
    assert {r.scan_id for r in got.select("scan_id").distinct().collect()} == set(range(2, 8))
    assert equal(got.selectExpr(*cols), whole.selectExpr(*cols))
    show = ["vx", "vy", "vz", "count", "round(mx, 9) mx", "is_valid"]
    assert equal(surfels.surfels().selectExpr(*show), surfel.surfels(whole, MAP).selectExpr(*show))
    # One scan by the operators alone.
    one = preprocess.preprocess(points.where("scan_id = 3"), p, (0.0, 0.0, 1.0, 1.5)).withColumns({"a": F.lit(0.2), "tx": F.lit(0.2), "ty": F.lit(0.2), "tz": F.lit(1.5)})
    one = preprocess.to_world(one, "a", ("tx", "ty", "tz"), with_normals=True).selectExpr(*cols[2:])
    assert equal(one, whole.where("scan_id = 3").selectExpr(*cols[2:]))
    # A scan before the first pose stays, in the sensor's frame.
    kept = S.cleaned_scans(points, poses, p, how="keep", world=False)
    assert {r.scan_id for r in kept.select("scan_id").distinct().collect()} == set(range(1, 8))


# --- fusion


def plain_frames(frames, p):
    """B1, B3, B8, B13, B14, B17 in plain loops; a frame associates with the surfels before it."""
    from voxelloom.operators.fusion2d import fuse, new_state

    surfels, waiting, told, count, nxt = {}, [], [], 0, 0

    def near(s, x, n):
        d = x - s["center"]
        u = np.cross(s["normal"], [0, 0, 1.0] if abs(s["normal"][2]) < 0.9 else [1.0, 0, 0])
        u /= np.linalg.norm(u)
        a = np.array([d @ u, d @ np.cross(s["normal"], u)])
        vals, axes = np.linalg.eigh(s["covariance"])
        vals, a = np.maximum(vals, 1e-8), axes.T @ (a - s["sum_tangent"] / s["weight"])
        cells = np.floor(x / p.voxel), np.floor(s["center"] / p.voxel)
        if np.abs(cells[0] - cells[1]).max() > 1 or abs(n @ s["normal"]) < np.cos(np.radians(p.normal_deg)) or abs(d @ s["normal"]) > p.normal_dist:
            return None
        m = sum(v * v / w for v, w in zip(a, vals) if w > 1e-8)
        return m if m < p.mahalanobis else None

    def fold(k, pts, stamps):
        surfels[k] = fuse(surfels[k], np.array([q[2] for q in pts]), np.array([q[3] for q in pts]), np.array(stamps), p)

    for rows in frames:
        rows = [r for r in rows if np.isfinite([*r[2], *r[3]]).all() and np.linalg.norm(r[3]) >= 0.1]
        mine = {}
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            best = min(((m, k) for k, s in surfels.items() if (m := near(s, r[2], r[3])) is not None), default=None)
            if best is None:
                waiting.append(r)
            else:
                mine.setdefault(best[1], []).append(r)
        for k, pts in mine.items():
            fold(k, pts, [q[1] for q in pts])
        waiting = waiting[-p.accumulator :]
        count += 1
        if count % 5 == 0:
            stamp = max(r[1] for r in rows)
            cells = {}
            for r in waiting:
                cells.setdefault(tuple(np.floor(r[2] / (2 * p.coherence)).astype(int)), []).append(r)
            base, gone, seed = nxt, set(), 0
            before = {k: dict(s) for k, s in surfels.items()}
            for cell, pts in sorted(cells.items()):
                if len(pts) < 5:
                    continue
                c = np.mean([q[2] for q in pts], 0)
                n = np.sum([q[3] for q in pts], 0)
                n = n / np.linalg.norm(n)
                if max(((q[2] - c) ** 2).sum() for q in pts) > (2 * p.coherence) ** 2 or np.mean([1 - (q[3] @ n) ** 2 for q in pts]) > p.coherence:
                    continue
                seed += 1
                options = []
                for k, s in before.items():
                    d = np.linalg.norm(s["center"] - c)
                    dot = abs(s["normal"] @ n)
                    radius = np.sqrt(max(np.linalg.eigvalsh(s["covariance"])[1], 1e-8))
                    if dot >= p.merge_dot and d <= 2 * radius + p.merge_dist and np.abs(np.floor(s["center"] / p.voxel) - np.floor(c / p.voxel)).max() <= 1:
                        options.append((-dot * told_confidence(s, p) / (1 + d), k))
                gone |= {id(q) for q in pts}
                if options:
                    told.append(("merged", min(options)[1], len(pts)))
                    fold(min(options)[1], sorted(pts, key=lambda q: q[0]), [stamp] * len(pts))
                else:
                    told.append(("new", base + seed, len(pts)))
                    surfels[base + seed] = new_state(c, n, p.init_radius, stamp)
                    nxt = base + seed + 1
            waiting = [q for q in waiting if id(q) not in gone]
    return surfels, waiting, told


def told_confidence(s, p):
    n, o = s["points"], s["observations"]
    e = np.maximum(np.linalg.eigvalsh(s["covariance"]), 1e-8)
    rms = np.sqrt(s["sum_sq"]) / n
    mean = np.linalg.norm(s["sum_normals"]) / n
    area = np.pi * np.sqrt(e[0]) * np.sqrt(e[1])
    return (1 - np.exp(-n / p.support)) * np.exp(-(rms**2) / p.fit_sigma**2) * mean * ((1 - p.temporal) + p.temporal * (1 - np.exp(-o / p.observations))) * (1 - np.exp(-area / p.area))


def test_ten_frames_equal_a_plain_fusion(spark, tmp_path):
    from voxelloom.params import FusionParams
    from voxelloom.streaming import scans as S
    from voxelloom.streaming.fusion import FusionStream

    p = FusionParams(accumulator=160)
    rng = np.random.default_rng(8)
    frames = []
    for k in range(11):
        at = np.column_stack([2 + rng.normal(0, 0.004, 46), rng.uniform(-0.9, 0.9, 46), rng.uniform(0.1, 1.3, 46)])
        if k >= 5:
            at[:12] = [2.02, 0.31, 0.65] + rng.normal(0, 0.03, (12, 3)) * [0.1, 1, 1]
        n = np.array([-1.0, 0, 0]) + rng.normal(0, 0.05, (46, 3))
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        rows = [(1000 * k + i, 10**15 + k, at[i], n[i]) for i in range(46)]
        rows[3] = (rows[3][0], rows[3][1], np.array([np.nan, 0, 0]), rows[3][3])
        rows[4] = (rows[4][0], rows[4][1], rows[4][2], rows[4][3] * 0.05)
        frames.append(rows)
    flat = [(i, s, *map(float, x), *map(float, n)) for f in frames for i, s, x, n in f]
    points = spark.createDataFrame(flat, "point_id long, stamp long, x double, y double, z double, pnx double, pny double, pnz double")
    path = str(tmp_path / "frames")
    write_parts(points, path, [f"stamp = {10**15 + k}" for k in range(6)])
    for more in ([], [f"stamp = {10**15 + k}" for k in range(6, 11)]):  # a new driver goes on after six frames
        write_parts(points, path, more)
        fusion = FusionStream(spark, str(tmp_path / "state"), p)
        S.start(S.read_files(spark, path, points.schema), fusion.process, str(tmp_path / "cp")).awaitTermination()
    surfels, waiting, told = plain_frames(frames, p)
    assert fusion.last() == 10 and any(t[0] == "merged" for t in told) and sum(t[0] == "new" for t in told) > 3
    got = {r.idx: r for r in fusion.surfels().collect()}
    assert set(got) == set(surfels)
    for k, s in surfels.items():
        r = got[k]
        assert (r.point_count, r.observations, r.stamp) == (s["points"], s["observations"], s["stamp"])
        assert np.allclose([r.cx, r.cy, r.cz, r.nx, r.ny, r.nz, r.sum_sq, r.total_weight], [*s["center"], *s["normal"], s["sum_sq"], s["weight"]], atol=1e-9)
    assert sorted(r.point_id for r in fusion.waiting().collect()) == sorted(r[0] for r in waiting)
    # A flush leaves the state and may start or feed surfels of the frames since.
    cells = {}
    for r in waiting:
        cells.setdefault(tuple(np.floor(r[2] / 0.6).astype(int)), []).append(r)
    flushed = fusion.flush()
    assert flushed.count() >= len(surfels) and {r.idx for r in flushed.collect()} >= set(surfels)
    assert {r.idx for r in fusion.surfels().collect()} == set(surfels)


def test_streamed_map_prunes_with_each_batch(spark, tmp_path):
    """M15 on a stream: a shadowed voxel's sums go with the batch that shadows it, and may come back later."""
    from voxelloom.streaming import scans as S
    from voxelloom.streaming.drivers import SurfelMapStream

    pwn = fixture(spark, SF, "fx_pwn")
    path = str(tmp_path / "points")
    parts = ["scan_id <= 3", "scan_id in (4, 5)", "scan_id > 5"]
    write_parts(pwn, path, parts)
    stream = SurfelMapStream(spark, str(tmp_path / "map"), MAP)
    S.start(S.read_files(spark, path, pwn.schema), stream.process, str(tmp_path / "cp")).awaitTermination()
    state = None
    for part in parts:
        new = surfel.raw_moments(pwn.where(part), MAP)
        state = surfel.merge(state, new) if state is not None else new
        keep = surfel.shadow_prune(surfel.finalise(state, MAP), MAP).select("vx", "vy", "vz")
        state = spark.createDataFrame(state.join(keep, ["vx", "vy", "vz"], "left_semi").collect(), state.schema)
    show = ["vx", "vy", "vz", "count", "round(mx, 9) mx", "is_valid"]
    assert stream.versions()[-1] == 2 and equal(stream.surfels().selectExpr(*show), surfel.finalise(state, MAP).selectExpr(*show))
    assert stream.surfels().count() < surfel.raw_moments(pwn, MAP).count()
