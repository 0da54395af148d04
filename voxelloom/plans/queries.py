"""Registered queries of the mapping and planning operators; their SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.linalg import rounded as rnd
from ..functions.shared import checkpoint, shared_path
from ..operators import frontier, fusion2d, paths, planner, preprocess, surfel, visibility, voxel
from ..params import ScanParams, SurfelParams
from ..sources import poses, sinks
from ..sources.fixtures import fixture
from ..streaming import fusion, keyed, scans

SIZE = 0.3
SCAN = ScanParams(width=60, height=45)
HEIGHT = (0.0, 0.0, 1.0, 1.5)
MAP = SurfelParams(min_points=10)
CENTER = (2.0, 0.0, 1.5)
KEY = voxel.KEY


def _r(df, *names, digits=6, keep=()):
    return df.select(*keep, *[rnd(F.col(n), digits).alias(n) for n in names])


def _filtered(spark, d):
    return preprocess.filter_points(fixture(spark, d, "fx_points"), SCAN, HEIGHT)


def _grid(spark, d, ds=1):
    return preprocess.grid_downsample(_filtered(spark, d), ScanParams(width=60, height=45, ds=ds))


def _map(spark, d, p=MAP):
    """The surfel map, written once: it is the state table that queries read."""
    return checkpoint(surfel.surfels(fixture(spark, d, "fx_pwn"), p))


def _vps(spark, d):
    return fixture(spark, d, "fx_viewpoints")


def _visible(spark, d, occlusion=False):
    return visibility.visibility(_vps(spark, d), _map(spark, d), SIZE, occlusion=occlusion)


def _covered(spark, d):
    """What every tenth viewpoint sees stands for the coverage so far."""
    return visibility.visibility(_vps(spark, d).where("vp_id % 10 = 0"), _map(spark, d), SIZE).select(*KEY).distinct()


# --- preprocessing


def p1_p4_filter_project(spark, d):
    return _r(_filtered(spark, d), "r_sq", "yaw", "pitch", keep=("scan_id", "point_idx"))


def p5_grid_downsample(spark, d):
    return _r(_grid(spark, d), "x", "y", "z", "r_sq", keep=("scan_id", "u", "v", "point_idx"))


def p6_grid_blocks(spark, d):
    out = preprocess.grid_downsample_blocks(_filtered(spark, d), ScanParams(width=60, height=45, ds=3))
    return _r(out, "r_sq", keep=("scan_id", "u", "v", "point_idx"))


def p7_range_image(spark, d):
    return _r(preprocess.range_image(_grid(spark, d)), "range", keep=("scan_id", "u", "v"))


def _smooth(variant):
    def query(spark, d):
        out = preprocess.smooth(preprocess.range_image(_grid(spark, d)), SCAN, variant)
        return _r(out, "range_smooth", keep=("scan_id", "u", "v"))

    return query


def _normals(spark, d, keep_all=False):
    return preprocess.normals(preprocess.range_image(_grid(spark, d)), SCAN, keep_all)


def p11_p15_normals(spark, d):
    return _r(_normals(spark, d), "nx", "ny", "nz", "w", keep=("scan_id", "u", "v"))


def p14_normals_kept(spark, d):
    out = _normals(spark, d, True)
    return out.groupBy("scan_id").agg(F.count("*").alias("cells"), F.count("nx").alias("with_normal"))


def p16_pipeline(spark, d):
    out = preprocess.preprocess(fixture(spark, d, "fx_points"), SCAN, HEIGHT)
    return _r(out, "nx", "ny", "nz", "w", keep=("scan_id", "u", "v"))


def p17_to_world(spark, d):
    pts = fixture(spark, d, "fx_points").withColumn("a", F.col("scan_id") * 0.1).withColumn("tx", F.lit(0.0)).withColumn("ty", F.lit(0.0)).withColumn("tz", F.lit(1.5))
    return _r(preprocess.to_world(pts, "a", ("tx", "ty", "tz")), "x", "y", "z", keep=("scan_id", "point_idx"))


# --- map


def m2_m3_voxel_counts(spark, d):
    return voxel.with_key(fixture(spark, d, "fx_pwn"), SIZE).groupBy(*KEY).agg(F.count("*").alias("n"))


def m1_in_range(spark, d):
    out = voxel.in_range(fixture(spark, d, "fx_points"), 2.0, 2.5)
    return out.groupBy("scan_id").agg(F.count("*").alias("n"), rnd(F.sum("x"), 4).alias("sx"))


def m9_remove(spark, d):
    return voxel.remove(_map(spark, d), _half(spark, d)).select(*KEY)


def m5_corners(spark, d):
    out = voxel.corners(voxel.with_key(fixture(spark, d, "fx_pwn"), SIZE).select(*KEY).distinct(), SIZE)
    return _r(out, "cx", "cy", "cz", "lox", "hiz", keep=KEY)


def m10_moments(spark, d):
    return _r(_map(spark, d), "sum_w", "mx", "my", "mz", "sxx", "sxy", "sxz", "syy", "syz", "szz", keep=(*KEY, "count", "n_points"))


def m10_stream_sums(spark, d):
    """The same from a stream over the table's files, its sums kept in RocksDB and read from there."""
    path = shared_path(spark, "voxel-sums")
    keyed.stream_voxel_sums(fixture(spark, d, "fx_pwn", stream=True), path, MAP).awaitTermination()
    out = surfel.finalise(keyed.voxel_sums(spark, path), MAP)
    return _r(out, "sum_w", "mx", "my", "mz", "sxx", "sxy", "sxz", "syy", "syz", "szz", keep=(*KEY, "count", "n_points"))


def m4_cell_keys(spark, d):
    """Points by the keys of both formulas, M4's and M3's."""
    pts = voxel.with_key(voxel.with_cell_key(fixture(spark, d, "fx_pwn"), SIZE), SIZE, keys=("wx", "wy", "wz"))
    return pts.groupBy(*KEY, "wx", "wy", "wz").agg(F.count("*").alias("n"))


def m5_inside(spark, d):
    """How many points lie in the box of the cell that M4 tells, upper faces left out."""
    pts = voxel.with_cell_key(fixture(spark, d, "fx_pwn"), SIZE)
    return pts.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(voxel.inside(SIZE)).alias("inside"))


def m14_covariance(spark, d):
    return _r(surfel.normalized_covariance(_map(spark, d)), "cxx", "cxy", "cxz", "cyy", "cyz", "czz", keep=KEY)


def m12_m14_surfels(spark, d):
    return _r(_map(spark, d, SurfelParams()), "e0", "e1", "e2", keep=(*KEY, "count", "is_valid", "is_planar", "is_degenerate"))


def m11_normals(spark, d):
    return _r(_map(spark, d).where("is_valid"), "nx", "ny", "nz", digits=3, keep=KEY)


def m15_shadow_edges(spark, d):
    return surfel.shadow_edges(_map(spark, d), MAP)


def m15_shadow_prune(spark, d):
    return surfel.shadow_prune(_map(spark, d), MAP).select(*KEY, "is_valid")


def m6_merge_scans(spark, d):
    pwn = fixture(spark, d, "fx_pwn")
    out = surfel.finalise(surfel.merge(*[surfel.raw_moments(pwn.where(F.col("scan_id") % 2 == k), MAP) for k in (0, 1)]), MAP)
    return _r(out, "sum_w", "mx", "my", "mz", "sxx", "syy", "szz", digits=4, keep=(*KEY, "count"))


def m16_valid_keys(spark, d):
    return _map(spark, d).where("is_valid").select(*KEY, "count")


def m17_lookup(spark, d):
    out = voxel.lookup(_vps(spark, d).withColumn("x", F.lit(2.0)), _map(spark, d).select(*KEY, "is_valid", "count"), SIZE)
    return out.select("vp_id", *KEY, "is_valid", "count")


def m18_box(spark, d):
    return voxel.box_query(_map(spark, d).where("is_valid"), (1.8, -1.0, 0.5), (2.4, 1.0, 1.5), SIZE).select(*KEY)


def m19_radius(spark, d):
    out = voxel.radius_join(_vps(spark, d).select("vp_id", "x", "y", "z"), _map(spark, d).where("count > 0").select(*KEY), 2.5, SIZE)
    return out.groupBy("vp_id").agg(F.count("*").alias("n"), rnd(F.min("dist_sq")).alias("least"))


def m20_neighbours(spark, d):
    valid = _map(spark, d).where("is_valid").select(*KEY)
    return voxel.neighbour_join(valid, valid.withColumn("hit", F.lit(1))).groupBy(*KEY).agg(F.count("*").alias("n"))


def m20_faces(spark, d):
    valid = _map(spark, d).where("is_valid").select(*KEY)
    return voxel.neighbour_join(valid, valid.withColumn("hit", F.lit(1)), faces=True).groupBy(*KEY).agg(F.count("*").alias("n"))


def m21_prune_outside(spark, d):
    return voxel.prune_outside(_map(spark, d), (1.5, -1.0, 0.4), (2.2, 1.0, 2.0), SIZE).select(*KEY, "count")


def m22_statistics(spark, d):
    return voxel.statistics(_map(spark, d), SIZE)


# --- visibility and coverage


def v1_frustum_boxes(spark, d):
    return _r(visibility.frustum_box(_vps(spark, d)), "lox", "hix", "loy", "hiy", "loz", "hiz", keep=("vp_id",))


def v3_v5_direct(spark, d):
    return visibility.directly_visible(_vps(spark, d), _map(spark, d), SIZE).select("vp_id", *KEY)


def v4_visibility(spark, d):
    return _visible(spark, d)


def v6_occlusion(spark, d):
    return visibility.directly_visible(_vps(spark, d), _map(spark, d), SIZE, occlusion=True).select("vp_id", *KEY)


def v7_coverage(spark, d):
    out = visibility.coverage_score(_visible(spark, d), _covered(spark, d))
    return _r(out, "coverage", keep=("vp_id", "n_visible", "n_new"))


def v8_similar(spark, d):
    return visibility.similar(_vps(spark, d), 0.5, 0.2618)


def v9_collision(spark, d):
    return voxel.collisions(_vps(spark, d).withColumn("x", F.col("x") + 1.5), _map(spark, d), 0.8, SIZE, "vp_id")


def v10_distance(spark, d):
    return _r(voxel.surface_distance(_vps(spark, d), _map(spark, d), 2.0, SIZE, "vp_id"), "distance", keep=("vp_id",))


def _half(spark, d):
    """A covered half of the walls, so that a frontier runs through them."""
    return _map(spark, d).where("is_valid and vy < 0").select(*KEY)


def _frontiers(spark, d):
    return frontier.frontiers(_half(spark, d), _map(spark, d), SIZE, CENTER)


def _suggestions(spark, d):
    """Summaries of frontiers in clusters by layers of height."""
    front = _frontiers(spark, d).withColumns({"plan_id": F.lit(0).cast("long"), "cluster": F.floor(F.col("vz") / 3).cast("long")})
    return frontier.summaries(front)


def v11_frontiers(spark, d):
    return _r(_frontiers(spark, d), "dist", "score", keep=KEY)


def v13_clusters(spark, d):
    """Clusters of a frontier all over the walls: every fourth column of voxels is covered."""
    voxels = _map(spark, d)
    front = frontier.frontiers(voxels.where("is_valid and pmod(vy, 4) = 0").select(*KEY), voxels, SIZE, CENTER)
    return _r(frontier.summaries(frontier.cluster(front)), "priority", "cx", "cy", "cz", "vx", "vy", "vz", "yaw", keep=("cluster", "members"))


def v14_v15_suggestions(spark, d):
    return _r(_suggestions(spark, d), "priority", "cx", "cy", "cz", "nx", "vx", "vy", "vz", "yaw", keep=("cluster", "members"))


def v18_candidates(spark, d):
    return _r(planner.candidate_poses(_suggestions(spark, d)), "x", "y", "z", "yaw", keep=("cluster", "tier", "offset"))


def v18_choice(spark, d):
    """Of each suggestion's poses the one to go to."""
    best, _ = planner.best_per_cluster(planner.candidate_poses(_suggestions(spark, d)), _map(spark, d), _vps(spark, d).where("vp_id % 10 = 0"), SIZE)
    return _r(best, "x", "y", "z", "yaw", keep=("cluster", "tier", "offset", "n_visible"))


def v19_valid_viewpoints(spark, d):
    vps = _vps(spark, d).withColumn("z", F.col("z") - 0.15)
    return planner.valid_viewpoints(vps, _map(spark, d), _vps(spark, d).where("vp_id % 10 = 0"), SIZE).select("vp_id")


def v17_expansion_center(spark, d):
    return _r(frontier.expansion_center(_visible(spark, d), _covered(spark, d), SIZE), "cx", "cy", "cz")


def v20_selection(spark, d):
    # The hint keeps viewpoints, as many as the input has, off the driver.
    vps = _vps(spark, d).join(visibility.coverage_score(_visible(spark, d), _covered(spark, d)).hint("merge"), "vp_id")
    scored = planner.selection_scores(vps, (0.0, 0.0, 1.0), _vps(spark, d).where("vp_id in (1, 2, 3)"))
    return _r(scored, "score", keep=("vp_id",))


def v16_plan(spark, d):
    past = _vps(spark, d).where("vp_id % 10 = 0")
    out = planner.plan(_map(spark, d), _half(spark, d), (0.0, 0.0, 1.0), SIZE, past)
    return _r(out, "x", "y", "z", "yaw", "coverage", "score", keep=("step", "vp_id", "n_visible"))


def c1_observations(spark, d):
    return visibility.observe(_visible(spark, d))


def c1_stream_observations(spark, d):
    """The same from a stream of what viewpoints see, told twice, its sets kept in RocksDB and read from there."""
    seen, path = shared_path(spark, "seen"), shared_path(spark, "coverage")
    told = checkpoint(_visible(spark, d).withColumn("ts", F.timestamp_seconds(F.col("vp_id"))))
    for _ in range(2):
        told.write.mode("append").parquet(seen)
    keyed.stream_coverage(spark.readStream.schema(told.schema).parquet(seen), path).awaitTermination()
    return visibility.observe(keyed.coverage(spark, path))


def c2_visited_log(spark, d):
    vps = _vps(spark, d).withColumn("at", F.col("vp_id") * 0.5)
    log = planner.record_visited(vps.select("vp_id", "x", "y", "z", "yaw", F.lit("visited").alias("status"), F.col("at").alias("visited_at")).where("vp_id % 10 = 0"), vps, "at")
    return _r(log, "x", "y", "z", "yaw", "visited_at", keep=("vp_id", "status"))


def c4_local_coverage(spark, d):
    regions = _visible(spark, d).select(F.col("vp_id").alias("region_id"), *KEY)
    return _r(visibility.local_coverage(regions, _half(spark, d)), "ratio", keep=("region_id", "total"))


def c3_visited(spark, d):
    vps = _vps(spark, d)
    return planner.visited(vps, vps.where("vp_id % 10 = 0"))


def c5_coverage_ratio(spark, d):
    return _r(visibility.coverage_ratio(_covered(spark, d), _map(spark, d)), "coverage", "coverage_live", keep=("observed", "total"))


def i7_yaw_steps(spark, d):
    """Headings a quarter, half and three quarters of the way from each viewpoint's to its opposite's neighbour."""
    steps = F.explode(F.array(*[F.lit(t) for t in (0.25, 0.5, 0.75)])).alias("t")
    out = _vps(spark, d).select("vp_id", (F.col("yaw") * 6).alias("a"), (F.col("yaw") + 3.0).alias("b"), steps)
    return _r(out.withColumn("heading", planner.interpolate_yaw(F.col("a"), F.col("b"), F.col("t"))), "t", "heading", keep=("vp_id",))


def v21_multi_score(spark, d):
    seen = visibility.coverage_score(_visible(spark, d), _covered(spark, d))
    vps = seen.withColumns({"priority": F.col("vp_id") % 7 * 1.5, "max_priority": F.lit(9.0), "dist": F.col("vp_id") % 12 * 1.0, "overlap": F.col("vp_id") % 10 / 10})
    return _r(planner.multi_score(vps), "score", keep=("vp_id",))


def t5_rotations(spark, d):
    """Yaw to quaternion, to rotation, to quaternion and back to yaw."""
    q = L.quaternion_of_yaw(F.col("yaw"))
    rows = L.rotation_of_quaternion(*q)
    again = L.quaternion_of_rotation(rows)
    out = _vps(spark, d).select("vp_id", *[c.alias(n) for c, n in zip(L.rotate(rows, (F.lit(1.0), F.lit(2.0), F.lit(3.0))), "xyz", strict=True)], *[c.alias(n) for c, n in zip(again, ("qw", "qx", "qy", "qz"), strict=True)], L.determinant(rows).alias("det"), L.yaw_of_quaternion(*again).alias("yaw"))
    return _r(out, "x", "y", "z", "qw", "qx", "qy", "qz", "det", "yaw", keep=("vp_id",))


def i4_travel_order(spark, d):
    return _r(planner.travel_order(_vps(spark, d), (0.0, 0.0, 1.0), 0.0), "path_cost", keep=("vp_id", "rank"))


def i1_back_off(spark, d):
    vps = _vps(spark, d).withColumn("x", F.col("x") + 1.6)
    return _r(paths.back_off(vps, _map(spark, d), SIZE), "x", "y", "z", keep=("vp_id", "step"))


def i10_progress(spark, d):
    feedback = fixture(spark, d, "fx_scan_events").select(F.col("drone_id").alias("plan_id"), "ts", (F.col("scan_id") % 12).cast("int").alias("active_index"))
    index = spark.range(12).select((F.col("id")).cast("int").alias("seq"), (F.col("id") + 100).alias("vp_id"))
    plans = feedback.select("plan_id").distinct()
    return planner.progress_events(feedback, plans.crossJoin(F.broadcast(index)))


def i8_mission_states(spark, d):
    """Each drone's reports as those of a plan through the first viewpoints."""
    feedback = fixture(spark, d, "fx_scan_events").select(F.col("drone_id").alias("plan_id"), "ts", (F.col("scan_id") % 9).cast("int").alias("active_index"))
    index = spark.range(9).select(F.col("id").cast("int").alias("seq"), (F.col("id") + 1).alias("vp_id"))
    reached = checkpoint(planner.progress_events(feedback, feedback.select("plan_id").distinct().crossJoin(F.broadcast(index))))
    voxels = _map(spark, d)
    observed = planner.observed_at(reached, _vps(spark, d), voxels, SIZE)
    return _r(planner.mission_states(reached, observed, voxels), "coverage", keep=("plan_id", "visited", "covered", "total", "complete"))


# --- paths


def _legs(spark, d):
    """Viewpoints in order of id, five to a plan."""
    return _vps(spark, d).select(F.floor(F.col("vp_id") / 5).alias("plan_id"), (F.col("vp_id") % 5).cast("int").alias("seq"), "x", "y", "z", "yaw")


def r6_free_edges(spark, d):
    edges = paths.path_edges(_legs(spark, d).withColumn("x", F.col("x") + 1.2)).withColumn("edge_id", F.col("plan_id") * 10 + F.col("seq"))
    return paths.free_edges(edges, _map(spark, d), SIZE)


def r5_first_invalid(spark, d):
    return paths.first_invalid(_legs(spark, d).withColumn("x", F.col("x") + 1.2), _map(spark, d), SIZE)


def i5_headings(spark, d):
    path = _legs(spark, d).withColumn("viewpoint_idx", F.when(F.col("seq") % 2 == 0, F.col("seq")))
    return _r(paths.headings(path), "yaw", keep=("plan_id", "seq"))


def r1_tree_search(spark, d):
    legs = _vps(spark, d).select(F.col("vp_id").alias("leg_id"), *[F.col(a).alias(f"s{a}") for a in "xyz"], F.lit(3.6).alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    return _r(paths.plan_legs(legs, _map(spark, d), SIZE), "x", "y", "z", keep=("leg_id", "seq"))


def i2_mend_paths(spark, d):
    """Of three plans one stays as it is; in the others a point between two viewpoints is in the wall."""
    moved = F.when(F.col("seq") == F.col("plan_id") % 3 * 2 - 1, F.lit(2.0)).otherwise(F.col("x"))
    path = _legs(spark, d).withColumns({"x": moved, "yaw": F.lit(0.0), "viewpoint_idx": F.when(F.col("seq") % 2 == 0, F.col("seq"))})
    mended, states = paths.mend_paths(path, _map(spark, d), SIZE)
    counts = mended.groupBy("plan_id").agg(F.count("*").alias("points"))
    return states.join(counts, "plan_id", "left")


# --- tangent-plane surfels


def _points_b(spark, d):
    """All points; of those that share an id the least."""
    pid = (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 100 + F.col("scan_id")).alias("point_id")
    at = F.min(F.struct("x", "y", "z", *[F.col(f"n{a}").alias(f"pn{a}") for a in "xyz"])).alias("at")
    return fixture(spark, d, "fx_pwn").groupBy(pid).agg(at).select("point_id", "at.*")


def _surfels_b(spark, d):
    return fixture(spark, d, "fx_surfels_b")


def _framed_b(spark, d):
    """Surfels with covariances at angles to their tangents and means off their centres."""
    s = _surfels_b(spark, d).withColumns({"_c": F.cos(F.col("idx") % 7 * 0.3 + 0.1), "_s": F.sin(F.col("idx") % 7 * 0.3 + 0.1)})
    cov = {"cov_uu": F.col("l0") * F.col("_c") ** 2 + F.col("l1") * F.col("_s") ** 2, "cov_vv": F.col("l0") * F.col("_s") ** 2 + F.col("l1") * F.col("_c") ** 2, "cov_uv": (F.col("l0") - F.col("l1")) * F.col("_c") * F.col("_s")}
    sums = {"total_weight": F.lit(2.5), "sum_u": (F.col("idx") % 5 - 2) * 0.01, "sum_v": (F.col("idx") % 3 - 1) * 0.015}
    return s.withColumns(cov | sums).drop("_c", "_s").withColumns({"l0": F.lit(None).cast("double"), "l1": F.lit(None).cast("double")})


def b2_candidates(spark, d):
    return _r(fusion2d.candidates(_points_b(spark, d), _framed_b(spark, d)), "mahalanobis", "normal_dist", keep=("point_id", "idx"))


def b3_association(spark, d):
    return fusion2d.associate(_points_b(spark, d), _framed_b(spark, d)).select("point_id", rnd(F.col("mahalanobis")).alias("mahalanobis"))


def b10_eigenframe(spark, d):
    out = fusion2d.eigenframe(_framed_b(spark, d)).withColumn("planarity", (F.col("l1") - F.col("l0")) / F.col("l1"))
    return _r(out, "l0", "l1", "planarity", "mu", "mv", keep=("idx",))


def b6_tangents(spark, d):
    return _r(fusion2d.tangents(_surfels_b(spark, d)), "ux", "uy", "uz", "tx", "ty", "tz", keep=("idx",))


def b8_fusion(spark, d):
    a = fusion2d.associate(_points_b(spark, d), _surfels_b(spark, d)).withColumn("stamp", F.col("point_id") % 7)
    return _r(fusion2d.fuse_all(a, _surfels_b(spark, d)), "cx", "cy", "cz", "nx", "ny", "nz", "sum_sq", keep=("idx", "point_count", "observations"))


def b11_confidence(spark, d):
    s = _surfels_b(spark, d).withColumn("point_count", F.col("idx") % 90 + 3).withColumn("sum_sq", F.col("l0") * 0.1).withColumn("observations", F.col("idx") % 9 + 1)
    s = s.withColumns({f"sum_n{a}": F.col(f"n{a}") * F.col("point_count") * 0.98 for a in "xyz"})
    return _r(fusion2d.confidence(s), "planarity", "confidence", keep=("idx",))


def _waiting_b(spark, d):
    """The accumulator after one frame: the newest of the points without a surfel."""
    a = fusion2d.associate(_points_b(spark, d), _framed_b(spark, d)).where("idx is null").withColumn("stamp", F.col("point_id") % 100)
    return fusion.waiting_points(a.select("point_id", "stamp", "x", "y", "z", "pnx", "pny", "pnz"))


def b13_waiting(spark, d):
    return _waiting_b(spark, d).select("point_id", "stamp")


def b14_clusters(spark, d):
    # Cells are read three times: for sums, for the spread about them and for both together.
    return _r(fusion2d.clusters(checkpoint(_waiting_b(spark, d))), "cx", "cy", "cz", "nx", "ny", "nz", "spread", keep=("gx", "gy", "gz", "members"))


def b27_flush(spark, d):
    """Each waiting point after a flush: the seed that takes it and the surfel that the seed goes into."""
    seeds, points = fusion.coherent(checkpoint(_waiting_b(spark, d)))
    into = fusion2d.merge_targets(checkpoint(seeds), _surfels_b(spark, d)).select("seed_id", "idx")
    return points.join(into, "seed_id", "left").select("point_id", "seed_id", "idx")


def b16_merge_targets(spark, d):
    seeds = _surfels_b(spark, d).select(F.col("idx").alias("seed_id"), (F.col("cx") + 0.02).alias("cx"), (F.col("cy") + 0.013).alias("cy"), "cz", "nx", "ny", "nz")
    return fusion2d.merge_targets(seeds, _surfels_b(spark, d)).select("seed_id", "idx", rnd(F.col("score")).alias("score"))


def b18_capacity(spark, d):
    return fusion2d.capacity(_surfels_b(spark, d)).select(*KEY, "idx")


def _weighted_b(spark, d):
    s = _surfels_b(spark, d).withColumn("point_count", F.col("idx") % 90 + 3).withColumn("observations", F.col("idx") % 9 + 1)
    s = s.withColumn("total_weight", F.col("point_count") * 0.5 + 0.0137).withColumn("sum_sq", F.col("l0") * F.col("point_count"))
    return s.withColumns({f"sum_n{a}": F.col(f"n{a}") * F.col("point_count") for a in "xyz"})


def b17_create(spark, d):
    seeds = _surfels_b(spark, d).select(F.col("idx").alias("seed_id"), (F.col("cx") + F.when(F.col("idx") % 3 == 0, 5.0).otherwise(0.02)).alias("cx"), (F.col("cy") + 0.013).alias("cy"), "cz", "nx", "ny", "nz")
    return _r(fusion2d.create_surfels(seeds, _surfels_b(spark, d)).withColumn("idx", F.coalesce("idx", F.lit(-1))).fillna(0.0, ["l1", "total_weight", "sum_nx"]), "cx", "l1", "total_weight", "sum_nx", keep=("seed_id", "idx", "is_new"))


def b18_add_surfels(spark, d):
    out = fusion2d.add_surfels(_weighted_b(spark, d))
    return _r(out, "cx", "cy", "cz", "nx", "ny", "confidence", "total_weight", keep=("idx", "merged", "point_count", "observations"))


def b21_merge(spark, d):
    s = _weighted_b(spark, d)
    out = fusion2d.merge_surfels(fusion2d.merge_pairs(_surfels_b(spark, d), mode="intended"), s)
    return _r(out, "cx", "cy", "cz", "radius", "confidence", "total_weight", "sum_sq", keep=("a", "b", "point_count", "observations"))


def b22_merge_map(spark, d):
    s = _weighted_b(spark, d)
    out = fusion2d.merge_map(fusion2d.merge_pairs(_surfels_b(spark, d), mode="intended"), s)
    return _r(out, "cx", "cy", "cz", "radius", "confidence", "total_weight", "sum_sq", keep=("idx", "parts", "point_count", "observations", *KEY))


def b28_aspect(spark, d):
    return _r(fusion2d.aspect_ratio(_surfels_b(spark, d)), "aspect", keep=("idx",))


def b19_merge_pairs(spark, d):
    return fusion2d.merge_pairs(_surfels_b(spark, d), mode="intended")


def b23_b25_statistics(spark, d):
    s = _surfels_b(spark, d).withColumn("observations", F.col("idx") % 9 + 1)
    return fusion2d.map_statistics(fusion2d.decay(fusion2d.prune(s)))


# --- sources and sinks


def s5_pose_as_of(spark, d):
    out = poses.pose_as_of(fixture(spark, d, "fx_scan_events"), fixture(spark, d, "fx_pose_events"))
    return out.select("drone_id", "scan_id", "event_id", rnd(F.col("px")).alias("px"))


def s7_pose_kept(spark, d):
    out = poses.pose_as_of(fixture(spark, d, "fx_scan_events"), fixture(spark, d, "fx_pose_events"), how="keep")
    return out.agg(F.count("*").alias("scans"), F.count("pose_ts").alias("with_pose"))


def s7_stream_kept_pose(spark, d):
    """S7 from two streams of files in the order of time; a last row lets the watermark pass all others."""
    path, streams = shared_path(spark, "pose-streams"), []
    for name in ("fx_scan_events", "fx_pose_events"):
        rows = fixture(spark, d, name).withColumn("ts", F.col("ts").cast("timestamp"))
        end = rows.agg(F.max("ts").alias("last")).select(*[(F.col("last") + F.expr("interval 100 days")).alias("ts") if c == "ts" else F.lit(-1 if c in ("drone_id", "scan_id", "event_id") else 0).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        rows.repartitionByRange(4, "ts").write.parquet(f"{path}/{name}")
        for k in (0, 1):  # the watermark moves on after a batch
            end.withColumn("ts", F.col("ts") + F.expr(f"interval {k} days")).write.mode("append").parquet(f"{path}/{name}")
        streams.append(scans.read_files(spark, f"{path}/{name}", rows.schema, 4))
    scans.start_kept_poses(*streams, f"{path}/out", f"{path}/checkpoint", late="40 days").awaitTermination()
    out = spark.read.parquet(f"{path}/out").where("drone_id >= 0").fillna({"event_id": -1, "px": -1.0})
    return _r(out, "px", keep=("drone_id", "scan_id", "event_id"))


def s8_latest_pose(spark, d):
    out = poses.latest_pose(fixture(spark, d, "fx_pose_events"))
    return out.select("drone_id", "event_id", rnd(F.col("px")).alias("px"), rnd(F.col("yaw")).alias("yaw"))


def s9_surfel_markers(spark, d):
    out = sinks.surfel_markers(surfel.shadow_prune(_map(spark, d), MAP))
    return _r(out, "mx", "my", "mz", "qw", "qx", "qy", "qz", "scale_x", "scale_y", digits=4, keep=KEY)


def s10_coverage_markers(spark, d):
    return _r(sinks.coverage_markers(_map(spark, d), _covered(spark, d), SIZE), "x", "y", "z", "g", "alpha", keep=KEY)


def s11_view_cloud(spark, d):
    return _r(sinks.view_cloud(_visible(spark, d), _covered(spark, d), SIZE), "x", "y", "z", keep=("vp_id", "r", "g"))


def s12_fusion_markers(spark, d):
    return _r(sinks.fusion_markers(_surfels_b(spark, d)), "tx", "ty", "tz", "r", "g", keep=("idx",))


def s12_counted_markers(spark, d):
    out = sinks.fusion_markers(_surfels_b(spark, d).withColumn("point_count", F.col("idx") % 300), "point_count")
    return _r(out, "tx", "r", "g", "b", keep=("idx",))


def s12_normal_markers(spark, d):
    return _r(sinks.fusion_markers(_surfels_b(spark, d), "normal"), "tx", "r", "g", "b", keep=("idx",))


def s13_s14_clouds(spark, d):
    return sinks.cloud(_filtered(spark, d))


def s18_remaining_path(spark, d):
    active = _legs(spark, d).select("plan_id", (F.col("plan_id") % 5).cast("int").alias("active_index")).distinct()
    return _r(sinks.remaining_path(_legs(spark, d), active), "x", "y", "z", keep=("plan_id", "seq"))


def s17_active_goals(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    events = e.select(F.col("user_id").alias("drone_id"), "ts", F.col("event_id").alias("goal_id"), F.when(F.col("event_type") == "click", "cancel").otherwise("goal").alias("kind"), (F.col("event_id") % 4).alias("n_points"))
    return poses.active_goals(events, "drone_id").select("drone_id", "goal_id")


def s19_path_poses(spark, d):
    return _r(poses.path_poses(_legs(spark, d)), "qw", "qz", keep=("plan_id", "seq"))


def s20_scripted_flight(spark, d):
    return _r(poses.scripted_flight(spark), "x", "y", "z", "yaw", keep=("plan_id", "seq"))


def valid_surfels(spark, d):
    """The flagship query: which voxels hold a valid surfel, with its mean, normal and eigenvalues."""
    out = _map(spark, d, SurfelParams()).where("is_valid")
    return _r(out, "mx", "my", "mz", "e0", "e1", "e2", keep=(*KEY, "count"))


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in ("rnd", "fixture", "checkpoint", "shared_path")
} | {"p8_smooth_forward": _smooth("forward_only"), "p9_smooth_symmetric": _smooth("symmetric"), "p10_smooth_identity": _smooth("identity")}
