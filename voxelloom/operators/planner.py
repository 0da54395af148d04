"""Candidate viewpoints, selection, chains, ordering and progress."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint, meet, spread
from ..params import CameraParams, PlannerParams
from . import frontier as FR
from . import visibility as VI
from .voxel import KEY, collisions, neighbours

# Offsets of a candidate on the world's axes (metres), and the step between distances.
OFFSETS = ((0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (-0.5, 0.0, 0.0), (0.0, 0.5, 0.0), (0.0, -0.5, 0.0), (0.0, 0.0, 0.3), (0.0, 0.0, -0.3))
DISTANCE_STEP = 0.5


def candidate_poses(summary: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Per cluster its suggestion (tier 0), then seven offsets at each distance from the optimal one to the nearest.

    summary(plan_id, cluster, c*, n*, v*, yaw). Every pose but the suggestion looks at the centroid.
    """
    poses = [(0, 0, 0.0, 0.0, 0.0, 0.0)]
    for tier in range(int((p.optimal - p.nearest) / DISTANCE_STEP + 1e-6) + 1):
        poses += [(tier + 1, i, p.optimal - tier * DISTANCE_STEP, *offset) for i, offset in enumerate(OFFSETS)]
    options = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("tier", "offset", "dist", "ox", "oy", "oz"), q, strict=True)]) for q in poses])
    flat = (F.col("nx"), F.col("ny"), F.col("nz") * 0.3)
    n = L.norm(flat)
    way = [F.when(n > 0.01, c / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(flat)]
    c = summary.withColumns({f"w{a}": w for a, w in zip("xyz", way, strict=True)}).withColumn("o", F.explode(options))
    first = F.col("o.tier") == 0
    c = c.withColumns({a: F.when(first, F.col(f"v{a}")).otherwise(F.col(f"c{a}") + F.col(f"w{a}") * F.col("o.dist") + F.col(f"o.o{a}")) for a in "xyz"})
    c = c.withColumn("yaw", F.when(first, F.col("yaw")).otherwise(F.atan2(F.col("cy") - F.col("y"), F.col("cx") - F.col("x"))))
    return c.select("plan_id", "cluster", F.col("o.tier").alias("tier"), F.col("o.offset").alias("offset"), "x", "y", "z", "yaw").withColumn("vp_id", F.col("cluster") * 100 + F.col("tier") * 10 + F.col("offset"))


def visited(viewpoints: DataFrame, past: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Ids of viewpoints near a visited one in place and heading."""
    size = p.revisit_m
    cell = {k: F.floor(F.col(a) / F.lit(size)).cast("int") for k, a in zip(KEY, "xyz", strict=True)}
    old = past.select("x", "y", "z", "yaw").withColumns(cell).select(*[F.col(k).alias(q) for k, q in zip(KEY, ("qx", "qy", "qz"), strict=True)], *[F.col(a).alias(f"o{a}") for a in ("x", "y", "z", "yaw")])
    j = neighbours(viewpoints.select("vp_id", "x", "y", "z", "yaw").withColumns(cell), itself=True).join(old, ["qx", "qy", "qz"])
    d = L.sub(L.vec(), L.vec("o"))
    return j.where((L.dot(d, d) <= size * size) & (L.yaw_difference(F.col("yaw"), F.col("oyaw")) <= math.radians(p.revisit_deg))).select("vp_id").distinct()


def record_visited(log: DataFrame, viewpoints: DataFrame, at: str) -> DataFrame:
    """The log with viewpoints(vp_id, x, y, z, yaw) put to it, visited at the time in column at; repeats stay."""
    row = [F.col(c) for c in ("vp_id", "x", "y", "z", "yaw")]
    return log.unionByName(viewpoints.select(*row, F.lit("visited").alias("status"), F.col(at).alias("visited_at")))


def valid_viewpoints(viewpoints: DataFrame, voxels: DataFrame, past: DataFrame, size: float, p: PlannerParams = PlannerParams()) -> DataFrame:
    """High enough, free of collisions and not visited yet."""
    high = viewpoints.where(F.col("z") >= p.min_z)
    hit = collisions(high, voxels, p.inflation, size, "vp_id").where("in_collision").select("vp_id")
    return high.join(hit, "vp_id", "left_anti").join(visited(high, past, p), "vp_id", "left_anti")


def best_per_cluster(poses: DataFrame, voxels: DataFrame, past: DataFrame, size: float, p: PlannerParams = PlannerParams(), c: CameraParams = CameraParams()) -> tuple[DataFrame, DataFrame]:
    """Of each cluster's valid poses that see something the first tier's most seeing one, and what it sees."""
    ok = checkpoint(valid_viewpoints(poses, voxels, past, size, p))
    seen = checkpoint(VI.visibility(ok, voxels, size, c, occlusion=True))
    counts = seen.groupBy("vp_id").agg(F.count("*").alias("n_visible"))
    w = Window.partitionBy("plan_id", "cluster").orderBy("tier", F.col("n_visible").desc(), "offset")
    best = ok.join(counts, "vp_id").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return best, seen


def selection_scores(viewpoints: DataFrame, at: tuple[float, float, float], chain: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """0.7 new ratio + 0.3 closeness, a fifth of it within a metre of the chain so far.

    viewpoints(vp_id, x, y, z, coverage); chain(x, y, z) is a plan's chain, max_viewpoints rows in plan().
    """
    d = tuple(F.col(a) - F.lit(float(v)) for a, v in zip("xyz", at, strict=True))
    score = 0.7 * F.col("coverage") + 0.3 * (1 - F.least(L.norm(d) / 6.0, F.lit(1.0)))
    # The chain is one bounded row beside each viewpoint, so viewpoints are read once and meet nothing by a shuffle.
    near = chain.agg(F.collect_list(F.struct("x", "y", "z")).alias("_chain"))
    away = lambda h: L.sub(L.vec(), tuple(h[a] for a in "xyz"))
    close = F.coalesce(F.exists("_chain", lambda h: L.dot(away(h), away(h)) <= 1.0), F.lit(False))
    out = viewpoints.crossJoin(F.broadcast(near))
    return out.withColumn("score", score * F.when(close, 0.2).otherwise(1.0)).drop("_chain")


def select_next(scored: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """The best viewpoint that is worth it; ties by id (a top-1)."""
    good = scored.where((F.col("coverage") >= p.min_new) & (F.col("score") >= p.min_new))
    return good.orderBy(F.col("score").desc(), "vp_id").limit(1)


def multi_score(viewpoints: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Weighted coverage, frontier and distance scores with an overlap penalty.

    viewpoints(coverage, priority, max_priority, dist, overlap).
    """
    a, b, c = p.weights
    frontier = F.when(F.col("max_priority") > 0, F.col("priority") / F.col("max_priority")).otherwise(0.0)
    total = a * F.col("coverage") + b * frontier + c * (1 - F.least(F.col("dist") / p.expansion, F.lit(1.0)))
    return viewpoints.withColumn("score", total * F.when(F.col("overlap") > 0.8, 0.5).when(F.col("overlap") > 0.5, 0.7).otherwise(1.0))


def travel_order(viewpoints: DataFrame, at: tuple[float, float, float], yaw: float) -> DataFrame:
    """I4: cost distance + turn, and the visiting order by it."""
    d = tuple(F.col(a) - F.lit(float(v)) for a, v in zip("xyz", at, strict=True))
    out = viewpoints.withColumn("path_cost", L.norm(d) + L.yaw_difference(F.col("yaw"), F.lit(float(yaw))))
    return ranked(out, ["path_cost", "vp_id"], "rank")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 1 on, without one task for all: ranges of the order are
    numbered each by itself, and begin after the rows of the ranges before them."""
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_own", own).join(F.broadcast(sizes.withColumn("_before", before).drop("n")), "_part")
    return out.withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def plan(voxels: DataFrame, covered: DataFrame, at: tuple[float, float, float], size: float, past: DataFrame, p: PlannerParams = PlannerParams(), c: CameraParams = CameraParams()) -> DataFrame:
    """Up to max_viewpoints viewpoints, each chosen on the coverage that the earlier ones leave.

    A step is near to the viewpoint before it, and spreads from the mean of what that one newly saw.
    Only past viewpoints count as visited; those of the chain lower the score (V20).
    The loop runs on the driver over the number of viewpoints; all its data stay in DataFrames that
    are checkpointed once a step.
    """
    chosen = None
    seen = checkpoint(covered.select(*KEY).distinct())
    visible, before = seen, seen.limit(0)
    for step in range(p.max_viewpoints):
        mid = FR.expansion_center(visible, before, size).first()
        front = FR.frontiers(seen, voxels, size, (mid.cx, mid.cy, mid.cz), p)
        poses = candidate_poses(FR.summaries(FR.cluster(front, p), p), p)
        best, sees = best_per_cluster(poses, voxels, past, size, p, c)
        cover = VI.coverage_score(sees, seen)
        chain = chosen if chosen is not None else best.limit(0)
        scored = selection_scores(best.join(cover.select("vp_id", "coverage"), "vp_id"), at, chain, p)
        top = checkpoint(select_next(scored, p).withColumn("step", F.lit(step)))
        found = top.first()
        if found is None:
            break
        at = (found.x, found.y, found.z)
        visible = sees.join(top.select("vp_id"), "vp_id", "left_semi").select(*KEY)
        before, seen = seen, checkpoint(seen.unionByName(visible).distinct())
        chosen = top if chosen is None else checkpoint(chosen.unionByName(top))
    return chosen if chosen is not None else top


def progress_events(feedback: DataFrame, viewpoint_index: DataFrame) -> DataFrame:
    """Viewpoints passed as the active index of a plan moves on.

    feedback(plan_id, ts, active_index); viewpoint_index(plan_id, seq, vp_id) of the path.
    """
    w = Window.partitionBy("plan_id").orderBy("ts")
    moved = feedback.withColumn("before", F.coalesce(F.lag("active_index").over(w), F.lit(0))).where("active_index > before")
    j = moved.join(viewpoint_index, "plan_id").where("seq >= before and seq < active_index")
    return j.groupBy("plan_id", "vp_id").agg(F.min("ts").alias("reached_at"))


def observed_at(reached: DataFrame, viewpoints: DataFrame, voxels: DataFrame, size: float, c: CameraParams = CameraParams()) -> DataFrame:
    """(plan_id, vx, vy, vz, observations, since) of reached(plan_id, vp_id, reached_at).

    What a reached viewpoint sees is told anew on the map as it is, not taken from when it was
    planned; each different viewpoint is seen through once, whatever the number of plans.
    """
    used = viewpoints.join(reached.select("vp_id").distinct(), "vp_id", "left_semi")
    seen = VI.visibility(used, voxels, size, c)
    # By plan, not by viewpoint: few viewpoints are few tasks, and what a plan sees need not be shuffled again.
    return meet(spread(reached, "plan_id"), checkpoint(seen), ["vp_id"]).groupBy("plan_id", *KEY).agg(F.count("*").alias("observations"), F.min("reached_at").alias("since"))


def mission_states(reached: DataFrame, observed: DataFrame, voxels: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """I8: per plan the viewpoints visited, voxels observed, their share of the valid surfels, and whether that completes it."""
    visited_ = reached.groupBy("plan_id").agg(F.count("*").alias("visited"))
    covered = observed.groupBy("plan_id").agg(F.count("*").alias("covered"))
    total = voxels.agg(F.count_if("is_valid").alias("total"))  # one row
    out = visited_.join(covered, "plan_id", "left").crossJoin(F.broadcast(total)).withColumn("covered", F.coalesce("covered", F.lit(0)))
    ratio = F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0)
    return out.withColumn("coverage", ratio).withColumn("complete", F.col("coverage") >= p.target_coverage)


def interpolate_yaw(a, b, t):
    """I7."""
    return L.wrap(a + L.wrap(b - a) * t)
