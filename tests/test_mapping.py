"""Queries against DuckDB, literal edge cases, and kernels against plain re-derivations."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from voxelloom.functions import linalg as L
from voxelloom.operators import frontier, fusion2d, paths, planner, preprocess, surfel, voxel
from voxelloom.params import PlannerParams, ScanParams, SurfelParams
from voxelloom.plans.oracles import ORACLE_SQL
from voxelloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["p5_grid_downsample", "p11_p15_normals", "m10_moments", "m15_shadow_prune", "m18_box", "v4_visibility", "v6_occlusion", "v11_frontiers", "v14_v15_suggestions", "v18_candidates", "v19_valid_viewpoints", "r5_first_invalid", "b3_association", "b16_merge_targets", "b17_create", "b18_add_surfels", "b21_merge", "c4_local_coverage", "m9_remove", "s5_pose_as_of", "s20_scripted_flight", "valid_surfels"]


def rows(df):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_scan_filters_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    pts = [(0, 0, nan, 0.0, 0.0), (0, 1, inf, 0.0, 0.0), (0, 2, 0.1, 0.0, 0.0), (0, 3, 10.0, 0.0, 0.0), (0, 4, 10.1, 0.0, 0.0), (0, 5, 0.1, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "scan_id int, point_idx int, x double, y double, z double")
    kept = preprocess.filter_points(df, ScanParams())
    assert sorted(r.point_idx for r in kept.collect()) == [2, 3, 5]
    assert [r.point_idx for r in preprocess.grid_downsample(kept, ScanParams()).collect()] == [2]  # nearest, then first


@pytest.mark.parametrize("name", ["p11_p15_normals", "p16_pipeline", "v4_visibility", "b3_association", "r5_first_invalid", "s9_surfel_markers", "m15_shadow_prune"])
def test_plans_compile_whole(spark, name):
    """No stage falls back to interpreted code: without the fallback a failure to compile is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def plain_smooth(image, variant, p):
    """Cell by cell, in place of windows: {(u, v): range}."""
    r, out = p.smooth_radius, dict(image)
    for _ in range(p.smooth_iters):
        for axis in (0, 1):
            new = {}
            for at, g in out.items():
                total = weight = 0.0
                for d in range(0 if variant == "forward_only" else -r, r + 1):
                    n = out.get((at[0] + d, at[1]) if axis == 0 else (at[0], at[1] + d))
                    if n is not None and abs(n - g) <= p.max_jump:
                        w = math.exp(-d * d / (2 * p.spatial_sigma**2)) * math.exp(-((n - g) ** 2) / (2 * p.depth_sigma**2))
                        total, weight = total + w * n, weight + w
                new[at] = g if variant == "forward_only" and at[axis] < r else total / weight
            out = new
    return out


@pytest.mark.parametrize("variant", ["forward_only", "symmetric", "identity"])
def test_smoothing_variants(spark, variant):
    """A flat scan and a step stay as they are; a rough one with holes equals the plain loops; scans don't mix."""
    rng = np.random.default_rng(2)
    p = ScanParams(width=9, height=7)
    scans = {0: {(u, v): 2.0 for u in range(6) for v in range(4)}, 1: {(u, v): 2.0 if u < 3 else 2.5 for u in range(6) for v in range(4)}}
    scans[2] = {(u, v): 2 + 0.08 * float(rng.random()) + (0.3 if u > 5 else 0) for u in range(9) for v in range(7) if rng.random() < 0.8}
    df = spark.createDataFrame([(s, u, v, g) for s, image in scans.items() for (u, v), g in image.items()], "scan_id int, u int, v int, range double")
    got = {(r.scan_id, r.u, r.v): r.range_smooth for r in preprocess.smooth(df, p, variant).collect()}
    want = {(s, *at): g for s, image in scans.items() for at, g in (image if variant == "identity" else plain_smooth(image, variant, p)).items()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    if variant == "symmetric":
        assert all(math.isclose(got[s, *at], g) for s in (0, 1) for at, g in scans[s].items())


def test_plane_normal_weight_gate_and_merge(spark):
    rng = np.random.default_rng(1)
    pts = [(2.1 + 0.0, float(y), float(z), -1.0, 0.0, 0.0, 1.0) for y, z in rng.uniform(0.31, 0.59, (60, 2))]
    pts += [(-0.01, -0.01, -0.01, -1.0, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(pts, "x double, y double, z double, nx double, ny double, nz double, w double")
    p = SurfelParams(min_points=50)
    out = {(r.vx, r.vy, r.vz): r for r in surfel.surfels(df, p).collect()}
    plane = out[7, 1, 1] if (7, 1, 1) in out else out[6, 1, 1]
    assert plane.is_valid and abs(plane.nx + 1) < 1e-9 and plane.e0 < 1e-9
    gated = out[-1, -1, -1]
    assert gated["count"] == 0 and gated.n_points == 1 and not gated.is_valid and gated.nx is None
    half = [surfel.raw_moments(df.where(f"y {op} 0.45"), p) for op in ("<", ">=")]
    both = {(r.vx, r.vy, r.vz): r for r in surfel.finalise(surfel.merge(*half), p).collect()}
    assert all(abs((both[k].mx or 0) - (v.mx or 0)) < 1e-12 and both[k]["count"] == v["count"] for k, v in out.items())


@pytest.mark.parametrize("toward,left", [(-1.0, {6, 8}), (1.0, {8})])
def test_three_layers_prune_in_key_order(spark, toward, left):
    rows_ = [(x, 0, 0, (x + 0.5) * 0.3, 0.15, 0.15, toward, 0.0, 0.0, True) for x in (6, 7, 8)]
    df = spark.createDataFrame(rows_, "vx int, vy int, vz int, mx double, my double, mz double, nx double, ny double, nz double, is_valid boolean")
    assert {r.vx for r in surfel.shadow_prune(df).collect()} == left


def test_long_chain_prunes_every_other(spark):
    rows_ = [(x, 0, 0, (x + 0.5) * 0.3, 0.15, 0.15, -1.0, 0.0, 0.0, True) for x in range(80)]
    df = spark.createDataFrame(rows_, "vx int, vy int, vz int, mx double, my double, mz double, nx double, ny double, nz double, is_valid boolean")
    assert {r.vx for r in surfel.shadow_prune(df).collect()} == set(range(0, 80, 2))


def plain_acting(edges):
    """In ascending order of the source: a marked one does nothing."""
    marked, out = set(), set()
    for u, v in sorted(edges):
        if u not in marked:
            marked.add(v)
            out.add((u, v))
    return out


def test_edges_act_in_order_in_few_rounds(spark, monkeypatch):
    """A chain of 80 in eight rounds, and forests of branches and chains in any direction."""
    rng = np.random.default_rng(6)
    forest = {}
    for k in range(3, 400):
        forest[k] = int(rng.integers(max(0, k - 9), k + 10)) if rng.random() < 0.7 else k + 1
    chain = {i: i + 1 for i in range(80)}
    comb = {i: i + 1 for i in range(0, 60)} | {1000 + i: i for i in range(0, 60, 7)} | {-1 - i: i for i in range(0, 60, 5)}
    rounds = []
    whole = surfel.checkpoint
    monkeypatch.setattr(surfel, "checkpoint", lambda df: (rounds.append(1), whole(df))[1])
    for edges in (chain, comb, {u: v for u, v in forest.items() if u != v}, {}):
        rounds.clear()
        df = spark.createDataFrame([(u, 0, 0, v, 0, 0) for u, v in edges.items()], "vx int, vy int, vz int, qx int, qy int, qz int")
        assert {(r.vx, r.qx) for r in surfel.acting(df).collect()} == plain_acting(edges.items())
        assert len(rounds) - 1 <= (8 if edges is chain else 12)


def test_full_voxel_merges_its_overflow(spark):
    """Six stay; one like them is taken in, one with another normal and one without an index are not; a lone surfel stays as it is."""
    like = [(i, 0.01 * i, 0.1, 0.1, 1.0, 0.0, 0.0, 0.01, 0.9 - 0.1 * i, 1.0 + i, 2, 1, 2.0, 0.0, 0.0) for i in range(7)]
    other = [(7, 0.2, 0.1, 0.1, 0.0, 1.0, 0.0, 0.01, 0.05, 1.0, 2, 1, 0.0, 2.0, 0.0), (8, 5.0, 0.1, 0.1, 0.0, 1.0, 0.0, 0.01, 0.01, 1.0, 2, 1, 0.0, 2.0, 0.0), (None, 0.0, 0.1, 0.1, 1.0, 0.0, 0.0, 0.01, 0.9, 1.0, 2, 1, 2.0, 0.0, 0.0)]
    names = "idx long, cx double, cy double, cz double, nx double, ny double, nz double, l1 double, confidence double, total_weight double, point_count long, observations long, sum_nx double, sum_ny double, sum_nz double"
    out = {r.idx: r for r in fusion2d.add_surfels(spark.createDataFrame(like + other, names)).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 5, 8} and [out[i].merged for i in (0, 4, 5, 8)] == [0, 0, 1, 0]
    assert math.isclose(out[5].cx, (6 * 0.05 + 7 * 0.06) / 13) and out[5].point_count == 4 and math.isclose(out[5].confidence, 0.4)
    assert fusion2d.add_surfels(spark.createDataFrame([], names)).count() == 0


@pytest.mark.parametrize("radius,size", [(2.5, 0.3), (0.2, 0.3), (0.9, 0.3), (1.0, 0.125)])
def test_block_index_equals_all_pairs(spark, radius, size):
    """Radius, nearest and their bounds against all pairs; a few rows a point, not one for each voxel of the ball."""
    rng = np.random.default_rng(int(radius * 100))
    keys = {tuple(map(int, k)) for k in rng.integers(-14, 15, (600, 3))}
    at = np.vstack([rng.uniform(-4, 4, (60, 3)), (np.array(sorted(keys))[:5] + 0.5) * size, [[90.0, 0, 0]]])
    voxels = spark.createDataFrame([(*k, 1) for k in sorted(keys)], "vx int, vy int, vz int, count long")
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(at)] + [(99, None, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {(r.id, r.vx, r.vy, r.vz): r.dist_sq for r in voxel.radius_join(points, voxels, radius, size).collect()}
    want = {(i, *k): d for i, q in enumerate(at) for k in keys if (d := float(((np.array(k) + 0.5) * size - q) @ ((np.array(k) + 0.5) * size - q))) <= radius**2}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    least = {}
    for k, d in want.items():
        least[k[0]] = min(d, least.get(k[0], math.inf))
    near = {r.id: r.dist_sq for r in voxel.nearest_voxel(points, voxels, radius, size, "id").collect()}
    assert set(near) == set(least) and all(math.isclose(near[i], d, abs_tol=1e-12) for i, d in least.items())
    assert voxel.near_blocks(points, radius, size).count() <= 27 * len(at)
    none = voxels.limit(0)
    assert voxel.radius_join(points, none, radius, size).count() == voxel.nearest_voxel(points, none, radius, size, "id").count() == 0


def test_empty_map_collides_and_blocks(spark):
    none = spark.createDataFrame([], "vx int, vy int, vz int, count long")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "vp_id long, x double, y double, z double")
    assert voxel.collisions(pts, none, 0.8, 0.3, "vp_id").first().in_collision
    path = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0)], "plan_id long, seq int, x double, y double, z double")
    assert paths.first_invalid(path, none, 0.3).first().first_invalid == -1


def plain_clusters(points, radius, least):
    """One by one in order: each free point leads the free points within radius of it."""
    free, out = sorted(points, key=lambda r: (round(r[0], 9), r[1])), []
    while free:
        at = free[0][2]
        mine = [r for r in free if math.dist(r[2], at) <= radius]
        free = [r for r in free if r not in mine]
        if len(mine) >= least:
            out.append({r[1] for r in mine})
    return out


def test_clusters_follow_their_leaders_in_order(spark):
    """Two plans of random points, a chain where every second point leads, ties of distance, and none."""
    rng = np.random.default_rng(4)
    rows_ = []
    for plan, n in ((0, 150), (1, 90)):
        keys = {tuple(map(int, k)) for k in rng.integers(0, 12, (n, 3))}
        rows_ += [(plan, *k, *[(c + 0.5) * 0.3 for c in k], float(rng.integers(0, 20)) / 10) for k in sorted(keys)]
    rows_ += [(2, k, 0, 0, (k + 0.5) * 0.3, 0.15, 0.15, 0.1 * k) for k in range(20)]
    names = "plan long, vx int, vy int, vz int, x double, y double, z double, dist double"
    for p in (PlannerParams(wavefront=9.0, cluster_radius=0.5, min_cluster=2), PlannerParams(wavefront=0.9, min_cluster=3)):
        got = {}
        for r in frontier.cluster(spark.createDataFrame(rows_, names), p, "plan").collect():
            got.setdefault((r.plan, r.cluster), set()).add((r.vx, r.vy, r.vz))
        for plan in (0, 1, 2):
            mine = [(r[7], r[1:4], r[4:7]) for r in rows_ if r[0] == plan]
            near = min(r[0] for r in mine)
            want = plain_clusters([r for r in mine if r[0] <= near + p.wavefront], p.cluster_radius, p.min_cluster)
            assert [got.get((plan, k)) for k in range(len(want))] == want and (plan, len(want)) not in got
    assert frontier.cluster(spark.createDataFrame([], names), PlannerParams(), "plan").count() == 0


def test_tree_search_goes_round_a_wall():
    wall = {(4, y, z) for y in range(-4, 5) for z in range(0, 8)}
    p = PlannerParams(rrt_margin=4.0)
    start, goal = np.array([-0.5, 0.0, 1.0]), np.array([3.2, 0.0, 1.0])
    path = paths.search(start, goal, wall, 0.3, p, 3)
    assert path is not None and np.allclose(path[0], start) and np.allclose(path[-1], goal) and len(path) > 2
    assert all(paths._free(paths._edge(a, b, 0.3), wall, 0.3, p.inflation) for a, b in zip(path, path[1:]))


def plain_search(start, goal, wall, size, p, seed):
    """R1-R3, R7 of one leg, a node at a time."""
    free = lambda a, b: paths._free(paths._edge(a, b, p.rrt_step), wall, size, p.inflation)
    if free(start, goal):
        return np.stack([start, goal])
    rng, nodes, parent = np.random.default_rng(seed), [start], [-1]
    lo, hi = np.minimum(start, goal) - p.rrt_margin, np.maximum(start, goal) + p.rrt_margin
    lo[2] = max(lo[2], p.min_z)
    for _ in range(p.rrt_iterations):
        target = goal if rng.random() < p.rrt_goal_bias else lo + (hi - lo) * rng.random(3)
        near = min(range(len(nodes)), key=lambda i: ((nodes[i] - target) ** 2).sum())
        step = target - nodes[near]
        length = np.sqrt((step**2).sum())
        new = target if length <= p.rrt_step else nodes[near] + step * (p.rrt_step / length)
        if free(nodes[near], new):
            nodes.append(new)
            parent.append(near)
            if np.sqrt(((goal - new) ** 2).sum()) <= 2 * p.rrt_step and free(new, goal):
                path, i = [goal], len(nodes) - 1
                while i >= 0:
                    path.append(nodes[i])
                    i = parent[i]
                return paths.simplify(np.array(path[::-1]), free)
    return None


def test_legs_searched_together_equal_plain_trees():
    """Found, unreachable, straight and unknown legs, and ends in collision, each as by itself; trees of many legs grow by one turn."""
    wall = {(4, y, z) for y in range(-4, 5) for z in range(0, 8)}
    for p in (PlannerParams(rrt_margin=4.0, rrt_iterations=300), PlannerParams(rrt_margin=9.0, rrt_iterations=120, rrt_goal_bias=0.6)):
        y = np.linspace(-1.5, 1.5, 9)
        starts, goals = np.array([[-0.5, v, 1.0] for v in y]), np.array([[3.2, -v, 1.2] for v in y])
        starts[6], goals[7], goals[8] = (1.3, 0.0, 1.0), (1.4, 0.3, 1.0), (-3.0, 0.0, 1.0)
        got = paths.search_all(starts, goals, paths.Solid(list(wall), 0.3), p, list(range(9)))
        want = [plain_search(a, b, wall, 0.3, p, i) for i, (a, b) in enumerate(zip(starts, goals))]
        assert [g is None for g in got] == [w is None for w in want] and all(np.allclose(g, w, atol=1e-9) for g, w in zip(got, want) if w is not None)
        assert got[6] is got[7] is None and len(got[8]) == 2
        assert p.rrt_margin == 9.0 or sum(g is not None and len(g) > 2 for g in got) > 2
    starts[0, 0] = np.nan
    assert paths.search_all(starts, goals, paths.Solid(list(wall), 0.3), p, list(range(9)))[0] is None
    assert paths.search_all(starts, goals, paths.Solid([], 0.3), p, list(range(9))) == [None] * 9


def test_nearest_nodes_are_exact():
    """R2: the first of nodes that are equally near, and nodes nearer to each other than single precision tells."""
    rng = np.random.default_rng(2)
    for nodes in (rng.integers(0, 4, (3, 200)).astype(float), 1e5 + rng.random((3, 200)) * 1e-3, np.repeat(rng.normal(0, 9, (3, 40)), 5, 1) + rng.normal(0, 1e-9, (3, 200))):
        targets = nodes[:, rng.integers(0, 200, 30)] + rng.integers(-1, 2, (3, 30)) * 20
        tree = paths._Nearest(nodes[:, :1].T, 200, 30)
        for n in (1, 60, 200):
            near, d2 = tree.find(0, nodes[:, :n], targets)
            want = ((targets[:, :, None] - nodes[:, None, :n]) ** 2).sum(0)
            assert near.tolist() == want.argmin(1).tolist() and np.allclose(d2, want.min(1), rtol=1e-12)


def test_groups_of_legs_equal_single_legs(spark):
    """Legs that share voxels are dealt into groups; a leg that is far from all voxels goes straight, on an empty map none does."""
    size, p = 0.3, PlannerParams(rrt_margin=4.0, rrt_iterations=150)
    wall = [(4, y, z, 9) for y in range(-4, 5) for z in range(0, 8)]
    voxels = spark.createDataFrame(wall, "vx int, vy int, vz int, count long")
    ends = [(i, -0.5, 0.01 * (i % 150) - 0.7, 1.0, 3.2, 0.1, 1.1) for i in range(300)] + [(600 + i, 90.0 * i, 50.0, 1.0, 90.0 * i + 2, 50.0, 1.0) for i in range(1, 4)]
    legs = spark.createDataFrame(ends, "leg_id long, sx double, sy double, sz double, gx double, gy double, gz double")
    out = paths.plan_legs(legs, voxels, size, p)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.leg_id, r.seq)):
        got.setdefault(r.leg_id, []).append((r.x, r.y, r.z))
    solid = paths.Solid([k[:3] for k in wall], size)
    want = {e[0]: paths.search(np.array(e[1:4]), np.array(e[4:]), solid, size, p, 7 + e[0]) for e in ends}
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want) and all(np.allclose(got[k], v) for k, v in want.items()) and len(want) > 5
    assert {601, 602, 603} <= set(got) and all(len(got[k]) == 2 for k in (601, 602, 603))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(legs#" in plan and "hashpartitioning(leg_id#" not in plan
    assert paths.plan_legs(legs, voxels.limit(0), size, p).count() == 0


def test_streamed_map_equals_batch(spark, tmp_path):
    from voxelloom.sources.fixtures import fixture
    from voxelloom.streaming.drivers import SurfelMapStream

    pwn = fixture(spark, SF, "fx_pwn")
    for i, part in ((0, 0), (1, 1), (2, 2), (2, 2)):  # a new driver each time; the last batch runs twice
        stream = SurfelMapStream(spark, str(tmp_path / "map"), SurfelParams(min_points=10), prune="never")
        stream.process(pwn.where(f"scan_id % 3 = {part}"), i)
    assert stream.versions() == [1, 2]
    whole = surfel.surfels(pwn, SurfelParams(min_points=10))
    got = stream.surfels().selectExpr("vx", "vy", "vz", "count", "round(mx, 9) mx", "is_valid")
    want = whole.selectExpr("vx", "vy", "vz", "count", "round(mx, 9) mx", "is_valid")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_quaternions_of_rotations_round_trip(spark):
    """Random rotations, half turns about each axis and the identity, through both formulas; mirror images have determinant -1."""
    rng = np.random.default_rng(7)
    quats = [q / np.linalg.norm(q) for q in rng.normal(0, 1, (200, 4))] + [np.eye(4)[k] for k in range(4)] + [np.array([1e-9, 0.6, 0.8, 0])]
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(quats)], "id long, qw double, qx double, qy double, qz double")
    rows_ = L.rotation_of_quaternion(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    mirror = (rows_[0], rows_[1], tuple(-c for c in rows_[2]))
    out = df.select("id", *[c.alias(f"q{i}") for i, c in enumerate(L.quaternion_of_rotation(rows_))], L.determinant(rows_).alias("det"), L.determinant(mirror).alias("mirror")).collect()
    for r in out:
        got, want = np.array([r.q0, r.q1, r.q2, r.q3]), quats[r.id]
        assert r.q0 >= 0 and min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert math.isclose(r.det, 1, abs_tol=1e-9) and math.isclose(r.mirror, -1, abs_tol=1e-9)


def test_ranks_by_ranges_equal_one_sort(spark):
    rng = np.random.default_rng(1)
    rows_ = [(int(i), float(rng.integers(0, 40))) for i in rng.permutation(500)] + [(1000, None)]
    df = spark.createDataFrame(rows_, "id long, cost double")
    got = {r.id: r.rank for r in planner.ranked(df, ["cost", "id"], "rank").collect()}
    order = sorted(rows_, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))  # nulls first, as Spark sorts
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    assert planner.ranked(df.limit(0), ["cost", "id"], "rank").count() == 0


def test_merged_maps_follow_chains_of_pairs(spark):
    """Chains, a ring, a star, repeated and null pairs; surfels alone stay as they are."""
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50)] + [(60, k) for k in range(61, 70)] + [(60, 61), (70, 70), (None, 3), (3, None)]
    parent = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            group = {a, b} | {x for g in (parent.get(a, {a}), parent.get(b, {b})) for x in g}
            for x in group:
                parent[x] = group
    got = {r.idx: r.root for r in fusion2d.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: min(g) for x, g in parent.items()}
    surfels = spark.createDataFrame([(i, 0.1 * i, 0.0, 0.05, 1e-4, 0.01 * i, float(i), i, 1, 0.5) for i in (1, 2, 3, 9)], "idx long, cx double, cy double, cz double, l1 double, confidence double, total_weight double, point_count long, observations long, sum_sq double")
    out = {r.idx: r for r in fusion2d.merge_map(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), surfels).collect()}
    assert set(out) == {1, 9} and out[1].parts == 3 and out[1].point_count == 6 and math.isclose(out[1].cx, (0.1 + 0.4 + 0.9) / 6)
    assert math.isclose(out[1].radius, max(0.01, (0.01 + max(abs(x - out[1].cx) for x in (0.2, 0.3))) * 0.6)) and out[9].cx == 0.1 * 9 and out[9].parts == 1
    pair = {r.a: r for r in fusion2d.merge_surfels(spark.createDataFrame([(1, 2)], "a long, b long"), surfels).collect()}[1]
    both = {r.idx: r for r in fusion2d.merge_map(spark.createDataFrame([(1, 2)], "a long, b long"), surfels).collect()}[1]
    assert all(math.isclose(pair[c], both[c]) for c in ("cx", "radius", "confidence", "total_weight"))


def test_entry_imports_without_optional_parts():
    assert os.path.exists(SF)
    import __spark_entry__ as e

    assert "valid_surfels" in e.queries() and "valid_surfels" in e.oracle_sql()


@pytest.mark.parametrize("name,module,step", [("r1_tree_search", paths, "plan_legs"), ("b8_fusion", fusion2d, "associate")])
def test_query_takes_its_whole_table(spark, monkeypatch, name, module, step):
    taken, whole = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda df, *a: (taken.append(df), whole(df.limit(1), *a))[1])
    QUERIES[name](spark, SF)
    table, key = ("supplier", ["s_suppkey"]) if name == "r1_tree_search" else ("lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    assert taken[0].count() == spark.read.parquet(f"{SF}/{table}.parquet").select(*key).distinct().count()


def test_chain_of_three_equals_plain_steps(spark, monkeypatch):
    """The chain's state (coverage, expansion centre, last position, penalty) kept in plain sets, each step's poses and views by the operators."""
    size, p, start = 0.3, PlannerParams(), (0.0, -5.0, 1.3)
    wall = [(8, y, z, 2.55, (y + 0.5) * size, (z + 0.5) * size, -1.0, 0.0, 0.0, True, 60) for y in range(-20, 21) for z in range(1, 9) if (7 * y + 3 * z) % 11]  # holes, so that no distances tie
    voxels = spark.createDataFrame(wall, "vx int, vy int, vz int, mx double, my double, mz double, nx double, ny double, nz double, is_valid boolean, count long")
    keys, poses = "vx int, vy int, vz int", "x double, y double, z double, yaw double"
    covered = {(8, y, z) for y in range(-20, -16) for z in range(1, 9) if y + z < -11}
    past = spark.createDataFrame([], "vp_id long, " + poses)
    got = planner.plan(voxels, spark.createDataFrame(sorted(covered), keys), start, size, past)
    seen, new, at, chain = set(covered), covered, start, []
    for _ in range(3):
        mid = (np.array(sorted(new)) + 0.5).mean(0) * size
        front = frontier.frontiers(spark.createDataFrame(sorted(seen), keys), voxels, size, tuple(mid), p)
        best, sees = planner.best_per_cluster(planner.candidate_poses(frontier.summaries(frontier.cluster(front, p), p), p), voxels, past, size, p)
        views = {}
        for r in sees.collect():
            views.setdefault(r.vp_id, set()).add((r.vx, r.vy, r.vz))
        options = []
        for r in best.collect():
            ratio = len(views[r.vp_id] - seen) / len(views[r.vp_id])
            score = 0.7 * ratio + 0.3 * (1 - min(math.dist((r.x, r.y, r.z), at) / 6, 1))
            score *= 0.2 if any(math.dist((r.x, r.y, r.z), q) <= 1 for q in chain) else 1
            if ratio >= p.min_new and score >= p.min_new:
                options.append((-score, r.vp_id, (r.x, r.y, r.z)))
        score, vp, at = min(options)
        chain.append(at)
        new = views[vp] - seen
        seen |= views[vp]
    rows_ = sorted(got.collect(), key=lambda r: r.step)
    assert [r.step for r in rows_] == [0, 1, 2]
    assert np.allclose([(r.x, r.y, r.z) for r in rows_], chain) and math.isclose(rows_[-1].score, -score, abs_tol=1e-9)
    used = []
    monkeypatch.setattr(planner, "plan", lambda *a: (used.append(a[5:]), got)[1])
    QUERIES["v16_plan"](spark, SF)
    assert all(q.max_viewpoints == PlannerParams().max_viewpoints for q in used[0])


def test_fusion_goes_on_from_the_stored_state(spark):
    rng = np.random.default_rng(5)
    n = 60
    at = rng.uniform(-0.05, 0.05, (n, 3)) * [1, 1, 0.1]
    pts = [(int(i % 2), 10**18 + int(i // 10), int(i), *map(float, q), 0.1, 0.0, 0.995) for i, q in enumerate(at)]
    points = spark.createDataFrame(pts, "idx long, stamp long, point_id long, x double, y double, z double, pnx double, pny double, pnz double")
    surfels = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.01, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "idx long, cx double, cy double, cz double, nx double, ny double, nz double")
    whole = fusion2d.fuse_all(points, surfels).toPandas().sort_values("idx")
    early, late = points.where(f"stamp < {10**18 + 3}"), points.where(f"stamp >= {10**18 + 3}")
    parts = fusion2d.fuse_all(late, fusion2d.fuse_all(early, surfels)).toPandas().sort_values("idx")
    assert whole.idx.tolist() == [0, 1] and whole.point_count.tolist() == [31, 31]
    assert whole.stamp.tolist() == parts.stamp.tolist() == [10**18 + 5] * 2
    assert np.allclose(whole.drop(columns="stamp").to_numpy(float), parts.drop(columns="stamp").to_numpy(float), rtol=1e-12, atol=1e-12)


def test_bad_paths_are_mended_to_the_next_viewpoint(spark):
    p, size = PlannerParams(rrt_margin=4.0), 0.3
    wall = {(4, y, z) for y in range(-4, 5) for z in range(0, 8)} | {(60, 0, 3)}
    voxels = spark.createDataFrame([(*k, 9) for k in sorted(wall)], "vx int, vy int, vz int, count long")
    line = lambda plan, xs, marks, y=0.0: [(plan, s, x, y, 1.0, 0.5, s if s in marks else None) for s, x in enumerate(xs)]
    rows_ = line(1, [-2.0, -0.5, 3.2, 4.5, 6.0], {0, 3, 4}) + line(2, [-2.0, -0.5, 3.2], {0}) + line(3, [-4.0, -3.0, -2.0], {2})
    rows_ += line(4, [16.5, 18.15], {1}, y=0.15)  # ends inside a voxel's reach: no leg gets there
    names = "plan_id long, seq int, x double, y double, z double, yaw double, viewpoint_idx int"
    mended, states = paths.mend_paths(spark.createDataFrame(rows_, names), voxels, size, PlannerParams(rrt_margin=4.0, rrt_iterations=200))
    told = {r.plan_id: (r.bad, r.state, r.erased) for r in states.collect()}
    assert told == {1: (1, "repaired", None), 2: (1, "replan", None), 3: (-1, "valid", None), 4: (0, "unreachable", 1)}
    got = {}
    for r in sorted(mended.collect(), key=lambda r: (r.plan_id, r.seq)):
        got.setdefault(r.plan_id, []).append(r)
    assert set(got) == {1, 3} and [r.seq for r in got[3]] == [0, 1, 2] and [r.seq for r in got[1]] == list(range(len(got[1])))
    at = [np.array([r.x, r.y, r.z]) for r in got[1]]
    assert all(paths._free(paths._edge(a, b, p.rrt_step), wall, size, p.inflation) for a, b in zip(at, at[1:]))
    assert at[0].tolist() == [-2.0, 0.0, 1.0] and at[-1].tolist() == [6.0, 0.0, 1.0] and at[-2].tolist() == [4.5, 0.0, 1.0]
    assert [r.viewpoint_idx for r in got[1]] == [0, *[None] * (len(at) - 2), 4] and got[1][-2].yaw == 0.5
    for a, b in zip(got[1][2:-2], got[1][3:-1]):
        assert math.isclose(a.yaw, math.atan2(b.y - a.y, b.x - a.x))
    none, no_states = paths.mend_paths(spark.createDataFrame([], names), voxels, size, p)
    assert none.count() == 0 and no_states.count() == 0
