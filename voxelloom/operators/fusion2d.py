"""Tangent-plane surfels: association, confidence, accumulator clusters, merging, sequential fusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint, meet, spread
from ..params import FusionParams
from .voxel import KEY, neighbours, with_key

C = ("cx", "cy", "cz")


def tangents(surfels: DataFrame) -> DataFrame:
    """Reference axis z, or x where the normal is near z; u = n x ref, v = n x u."""
    n = L.vec("n")
    up = F.abs(n[2]) < 0.9
    ref = (F.when(up, 0.0).otherwise(1.0), F.lit(0.0), F.when(up, 1.0).otherwise(0.0))
    u = L.unit(L.cross(n, ref))
    out = surfels.withColumns({f"u{a}": c for a, c in zip("xyz", u, strict=True)})
    return out.withColumns({f"t{a}": c for a, c in zip("xyz", L.cross(n, L.vec("u")), strict=True)})


def eigenframe(surfels: DataFrame) -> DataFrame:
    """l0 <= l1, the unit axis (ax, ay) of l1 in tangent coordinates and the mean (mu, mv) of the tangent sums.

    From the covariance where surfels have it, with eigenvalues of 1e-8 at least; (-ay, ax) is the
    axis of l0. Where covariance, sums or weight are missing or null, l0 is along u, l1 along v and
    the mean 0.
    """
    have = set(surfels.columns)
    if not {"cov_uu", "cov_uv", "cov_vv"} <= have:
        out = surfels.withColumns({"ax": F.lit(0.0), "ay": F.lit(1.0)})
    else:
        known = F.col("cov_uu").isNotNull() & F.col("cov_uv").isNotNull() & F.col("cov_vv").isNotNull()
        low, high = L.eigenvalues2(F.col("cov_uu"), F.col("cov_uv"), F.col("cov_vv"))
        turn = F.when(known, F.atan2(2 * F.col("cov_uv"), F.col("cov_uu") - F.col("cov_vv")) / 2).otherwise(math.pi / 2)
        # The axis of a round covariance is any: u, as for a new surfel.
        out = surfels.withColumns({"l0": F.when(known, low).otherwise(F.col("l0")), "l1": F.when(known, high).otherwise(F.col("l1")), "ax": F.cos(turn), "ay": F.sin(turn)})
    if not {"sum_u", "sum_v", "total_weight"} <= have:
        return out.withColumns({"mu": F.lit(0.0), "mv": F.lit(0.0)})
    mean = lambda c: F.when(F.col("total_weight") > 1e-6, F.coalesce(F.col(c) / F.col("total_weight"), F.lit(0.0))).otherwise(0.0)
    return out.withColumns({"mu": mean("sum_u"), "mv": mean("sum_v")})


def candidates(points: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Pairs of points(point_id, x.., pnx..) and surfels(idx, cx.., nx.., l0, l1, ...) that may associate.

    Surfels near a voxel that has points are spread to the 27 voxels around their own and meet points by key; then the normals'
    angle, the distance along the normal and the squared Mahalanobis distance decide: in the frame of
    the covariance's eigenvectors, about the mean of the tangent coordinates (eigenframe); an axis of
    1e-8 or less counts nothing.
    """
    places = with_key(points, p.voxel).select(*KEY).distinct()
    live = neighbours(places, itself=True).select(F.col("qx").alias("vx"), F.col("qy").alias("vy"), F.col("qz").alias("vz")).distinct()
    s = with_key(surfels, p.voxel, C).join(live, KEY, "left_semi")
    s = eigenframe(tangents(s)).withColumnsRenamed(dict(zip(KEY, ("sx_", "sy_", "sz_"), strict=True)))
    own = ["idx", *C, "nx", "ny", "nz", *[f"{k}{a}" for k in "ut" for a in "xyz"], "l0", "l1", "ax", "ay", "mu", "mv"]
    s = neighbours(s.withColumnsRenamed(dict(zip(("sx_", "sy_", "sz_"), KEY, strict=True))).select(*KEY, *own), itself=True).drop(*KEY)
    q = with_key(points, p.voxel).select("point_id", "x", "y", "z", "pnx", "pny", "pnz", *KEY).withColumnsRenamed(dict(zip(KEY, ("qx", "qy", "qz"), strict=True)))
    j = meet(q, checkpoint(s), ["qx", "qy", "qz"])
    d = L.sub(L.vec(), tuple(F.col(c) for c in C))
    j = j.withColumn("normal_dist", L.dot(d, L.vec("n"))).withColumn("tu", L.dot(d, L.vec("u"))).withColumn("tv", L.dot(d, L.vec("t")))
    near = (F.abs(L.dot(L.vec("pn"), L.vec("n"))) >= math.cos(math.radians(p.normal_deg))) & (F.abs("normal_dist") <= p.normal_dist)
    j = j.where(near)
    u, v = F.col("tu") - F.col("mu"), F.col("tv") - F.col("mv")
    along, across = u * F.col("ax") + v * F.col("ay"), v * F.col("ax") - u * F.col("ay")
    part = lambda x, value: F.when(F.col(value) > 1e-8, x * x / F.col(value)).otherwise(0.0)
    j = j.withColumn("mahalanobis", part(across, "l0") + part(along, "l1"))
    return j.where(F.col("mahalanobis") < p.mahalanobis).select("point_id", "idx", "mahalanobis", "normal_dist", "tu", "tv")


def associate(points: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Each point with its nearest surfel, or null: those go to the accumulator (snapshot mode)."""
    best = candidates(points, surfels, p).groupBy("point_id").agg(F.min(F.struct("mahalanobis", "idx", "normal_dist", "tu", "tv")).alias("b"))
    return points.join(best, "point_id", "left").select(points["*"], "b.idx", "b.mahalanobis", "b.normal_dist", "b.tu", "b.tv")


def confidence(s: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Planarity and confidence of surfels(point_count, sum_sq, l0, l1, sum_nx.., observations)."""
    n = F.col("point_count")
    rms = F.when(n > 0, F.sqrt("sum_sq") / n).otherwise(0.0)
    fit = F.exp(-(rms * rms) / p.fit_sigma**2)
    mean = F.when(n > 0, L.norm(L.vec("sum_n")) / n).otherwise(0.0)
    temporal = (1 - p.temporal) + p.temporal * (1 - F.exp(-F.col("observations") / p.observations))
    area = math.pi * F.sqrt("l0") * F.sqrt("l1")
    value = (1 - F.exp(-n / p.support)) * fit * mean * temporal * (1 - F.exp(-area / p.area))
    return s.withColumn("planarity", F.when(F.col("l1") > 0, (F.col("l1") - F.col("l0")) / F.col("l1")).otherwise(0.0)).withColumn("confidence", value)


def clusters(points: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Coherent cells of the accumulator: centroid, mean normal, members.

    Two aggregates: sums, then the largest distance and the normals' spread about them.
    """
    edge = 2 * p.coherence
    cells = with_key(points, edge, keys=("gx", "gy", "gz"))
    g = ["gx", "gy", "gz"]
    sums = cells.groupBy(*g).agg(F.count("*").alias("members"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.sum(f"pn{a}").alias(f"s{a}") for a in "xyz"])
    sums = sums.where(F.col("members") >= p.min_cluster).withColumns({f"n{a}": c for a, c in zip("xyz", L.unit(L.vec("s")), strict=True)}).drop("sx", "sy", "sz")
    j = cells.join(sums, g)
    d = L.sub(L.vec(), tuple(F.col(c) for c in C))
    dot = L.dot(L.vec("pn"), L.vec("n"))
    spread = j.groupBy(*g).agg(F.max(L.dot(d, d)).alias("max_d2"), F.avg(1 - dot * dot).alias("spread"))
    out = sums.join(spread, g)
    return out.where((F.col("max_d2") <= edge * edge) & (F.col("spread") <= p.coherence))


def merge_targets(seeds: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """For seeds(seed_id, cx.., nx..) the best surfel to merge with, or null.

    Within 27 voxels, normals within the limit, centres within twice the surfel's radius and the
    merge distance; the best has the largest dot x confidence / (1 + distance), ties by index.
    """
    s = with_key(surfels.withColumn("radius", F.sqrt("l1")), p.voxel, C).select(*KEY, "idx", "radius", "confidence", *[F.col(f"c{a}").alias(f"o{a}") for a in "xyz"], *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"])
    q = with_key(seeds, p.voxel, C)
    # Both grow: the hint keeps Spark from sending the exploded seeds, which it takes for few, through the driver.
    named = s.withColumnsRenamed(dict(zip(KEY, ("qx", "qy", "qz"), strict=True))).hint("merge")
    j = neighbours(spread(q, "seed_id"), itself=True).drop(*KEY).join(named, ["qx", "qy", "qz"])
    d = L.norm(L.sub(L.vec("o"), tuple(F.col(c) for c in C)))
    dot = F.abs(L.dot(L.vec("n"), L.vec("m")))
    j = j.withColumn("dist", d).withColumn("dot", dot).where((F.col("dot") >= p.merge_dot) & (F.col("dist") <= 2 * F.col("radius") + p.merge_dist))
    score = F.col("dot") * F.col("confidence") / (1 + F.col("dist"))
    best = j.groupBy("seed_id").agg(F.max(F.struct(score.alias("score"), (-F.col("idx")).alias("neg"))).alias("b"))
    return seeds.select("seed_id").join(best.hint("merge"), "seed_id", "left").select("seed_id", (-F.col("b.neg")).alias("idx"), F.col("b.score").alias("score"))


def merge_pairs(surfels: DataFrame, p: FusionParams = FusionParams(), mode: str = "as_reference") -> DataFrame:
    """Pairs of one voxel that should merge. as_reference: each surfel with itself only, so
    nothing merges though pairs are counted; intended: a < b."""
    s = with_key(surfels.withColumn("radius", F.sqrt("l1")), p.voxel, C)
    if mode == "as_reference":
        w = Window.partitionBy(*KEY)
        rank = F.row_number().over(w.orderBy("idx"))
        return s.withColumn("later", F.count("*").over(w) - rank).where("later > 0").select(F.col("idx").alias("a"), F.col("idx").alias("b"))
    # Both sides rename the same columns in the same order, so that one shuffle serves them.
    side = lambda k: s.select(*KEY, F.col("idx").alias(k), *[F.col(c).alias(f"{k}{c}") for c in ("radius", *C, "nx", "ny", "nz")])
    j = side("a").join(side("b"), KEY).where("a < b")
    d = L.norm(L.sub(L.vec("ac"), L.vec("bc")))
    return j.where((F.abs(L.dot(L.vec("an"), L.vec("bn"))) >= p.merge_dot) & (d <= F.col("aradius") + F.col("bradius") + p.merge_dist)).select("a", "b")


def capacity(surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """The most confident surfels of each voxel, at most per_voxel."""
    w = Window.partitionBy(*KEY).orderBy(F.col("confidence").desc(), "idx")
    return with_key(surfels, p.voxel, C).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.per_voxel).drop("rank")


def alike(d: tuple, n: tuple, m: tuple, reach, p: FusionParams):
    """Whether surfels with normals n and m, d apart, should merge; reach is the sum of their radii."""
    return (F.abs(L.dot(n, m)) >= p.merge_dot) & (L.norm(d) <= reach + p.merge_dist)


SUMS = ("total_weight", "point_count", "observations")


def add_surfels(surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """surfels(idx, c*, n*, l1, confidence, total_weight, point_count, observations, sum_n*) into voxels of limited room.

    The per_voxel most confident surfels of a voxel stay (ties by idx). Every other joins the stayer
    it resembles most, |dot| / (1 + 10 distance), ties by idx, if the two should merge; else it is
    rejected, as it is weaker than all that stay. A merge is a sum: weighted centre, summed normals
    and counts, greatest confidence; so the order in which surfels arrive doesn't matter. merged
    counts those taken in. Null indices or centres meet nothing and are dropped.
    """
    s = with_key(surfels.where("idx is not null and cx is not null and cy is not null and cz is not null"), p.voxel, C).withColumn("radius", F.sqrt("l1"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("confidence").desc(), "idx"))
    top = s.withColumn("rank", rank).where(F.col("rank") <= p.per_voxel).drop("rank")
    own = [*SUMS, "confidence", *C, *[f"sum_n{a}" for a in "xyz"]]
    stay = top.select(*KEY, F.col("idx").alias("target"), F.col("radius").alias("other"), *[F.col(f"{k}{a}").alias(f"b{k}{a}") for k in "cn" for a in "xyz"])
    j = s.join(top.select("idx"), "idx", "left_anti").join(stay, KEY)
    d = L.sub(L.vec("c"), L.vec("bc"))
    j = j.where(alike(d, L.vec("n"), L.vec("bn"), F.col("radius") + F.col("other"), p))
    like = F.abs(L.dot(L.vec("n"), L.vec("bn"))) / (1 + 10 * L.norm(d))
    best = j.groupBy("idx").agg(F.max(F.struct(like.alias("like"), (-F.col("target")).alias("neg"), *own)).alias("b"))
    parts = top.select("idx", F.lit(0).alias("merged"), *own).unionByName(best.select((-F.col("b.neg")).alias("idx"), F.lit(1).alias("merged"), *[F.col(f"b.{c}").alias(c) for c in own]))
    w = F.col("total_weight")
    sums = [*[F.sum(c).alias(c) for c in ("merged", *SUMS, *[f"sum_n{a}" for a in "xyz"])], F.max("confidence").alias("confidence"), *[F.sum(F.col(c) * w).alias(c) for c in C]]
    out = parts.groupBy("idx").agg(*sums).withColumns({c: F.col(c) / w for c in C})
    return out.withColumns({f"n{a}": c for a, c in zip("xyz", L.unit(L.vec("sum_n")), strict=True)})


def merge_surfels(pairs: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """pairs(a, b): surfel a after taking in surfel b, with the key of the voxel it is in then.

    A pair of a surfel with itself changes nothing and gives no row; each pair is told by itself.
    """
    cols = ["idx", *C, "l1", "confidence", *SUMS, "sum_sq"]
    one = surfels.select(F.col("idx").alias("a"), *cols[1:])
    two = surfels.select(*[F.col(c).alias(f"b_{c}") for c in cols]).withColumnRenamed("b_idx", "b")
    j = pairs.where("a <> b").select("a", "b").join(one, "a").join(two, "b")
    part = F.col("b_total_weight") / (F.col("total_weight") + F.col("b_total_weight"))
    j = j.withColumns({c: F.col(c) + part * (F.col(f"b_{c}") - F.col(c)) for c in C})
    radius = F.greatest(F.sqrt("l1"), F.sqrt("b_l1"))
    radius = F.greatest(radius, (radius + L.norm(L.sub(L.vec("c"), L.vec("b_c")))) * 0.6)
    j = j.withColumn("radius", radius).withColumn("confidence", F.greatest("confidence", "b_confidence")).withColumns({c: F.col(c) + F.col(f"b_{c}") for c in (*SUMS, "sum_sq")})
    return with_key(j.select("a", "b", *C, "radius", "confidence", *SUMS, "sum_sq"), p.voxel, C)


def components(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (idx, root): the smallest index that pairs reach from each index in them.

    Each index points at its least neighbour if that is smaller, which makes trees, and pointers
    double until they are at the roots. Then the links are told between roots, and only those between
    two trees go on, so all links are shuffled but once for each end. A root that no other points at
    has a smaller neighbour in the next round, so two rounds leave half of the roots at most. Null ends
    and pairs of a surfel with itself count nothing; an empty table gives an empty result.
    """
    links, whole = checkpoint(pairs.where("a is not null and b is not null and a <> b").select("a", "b")), None
    while True:
        # Both ends in one pass, so that a task sends one row an index. The filter, which a join would add on one side, lets both share that shuffle.
        ends = links.selectExpr("inline(array(struct(a as idx, b as near), struct(b as idx, a as near)))").where("idx is not null")
        trees = ends.groupBy("idx").agg(F.min("near").alias("near")).select("idx", F.least("idx", "near").alias("root"))
        moving = True
        while moving:
            up = trees.select(F.col("idx").alias("root"), F.col("root").alias("far"))
            now = checkpoint(trees.join(up, "root").select("idx", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")))
            trees, moving = now.select("idx", "root"), not now.where("moved").isEmpty()
        whole = trees if whole is None else _onward(whole, trees)
        # A link to the other end's own root is within the tree.
        one = links.join(trees.withColumnsRenamed({"idx": "b", "root": "to"}), "b").where("a <> to").select("a", "to")
        two = one.join(trees.withColumnsRenamed({"idx": "a", "root": "from"}), "a").where("from <> to")
        links = checkpoint(two.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct())
        if links.isEmpty():
            return whole


def _onward(whole: DataFrame, trees: DataFrame) -> DataFrame:
    """(idx, root) with the roots of later trees(idx, root); a root that has no links any more stays."""
    up = trees.select(F.col("idx").alias("root"), F.col("root").alias("far"))
    return checkpoint(whole.join(up, "root", "left").select("idx", F.coalesce("far", "root").alias("root")))


def merge_map(pairs: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """B19-B22 on a map: surfels after all pairs(a, b) are merged, merges of merges too, each with the voxel it is in then.

    The surfels that pairs connect become the one of the smallest index: weighted centre, sums of
    weights, counts and distances, greatest confidence, a radius that reaches 0.6 of the way to the
    farthest of those taken in (B21's rule for a pair). Those taken in are gone, all others stay as
    they are. One aggregate, in which a component of any size is one row per task first.
    """
    whole = surfels.select("idx", *C, "l1", "confidence", *SUMS, "sum_sq").join(components(pairs), "idx", "left")
    whole = checkpoint(whole.withColumns({"paired": F.col("root").isNotNull(), "root": F.coalesce("root", "idx")}))  # read four times
    w = F.col("total_weight")
    sums = [*[F.sum(c).alias(c) for c in (*SUMS, "sum_sq")], F.max("confidence").alias("confidence"), F.max(F.sqrt("l1")).alias("radius"), F.count("*").alias("parts"), *[F.sum(F.col(c) * w).alias(f"m{c}") for c in C]]
    summed = lambda rows: rows.groupBy("root").agg(*sums).withColumns({f"m{c}": F.col(f"m{c}") / w for c in C})
    centres = summed(whole.where("paired")).where("parts > 1").select("root", *[f"m{c}" for c in C])
    others = whole.where("root <> idx").select("root", *C).join(centres, "root")
    far = others.groupBy("root").agg(F.max(L.norm(tuple(F.col(c) - F.col(f"m{c}") for c in C))).alias("far"))
    own = whole.where("root = idx").select("root", *C)  # a surfel alone keeps its very centre
    out = summed(whole).join(far, "root", "left").join(own, "root")
    out = out.withColumns({c: F.when(F.col("parts") > 1, F.col(f"m{c}")).otherwise(F.col(c)) for c in C})
    out = out.withColumn("radius", F.greatest("radius", F.coalesce((F.col("radius") + F.col("far")) * 0.6, F.lit(0.0))))
    return with_key(out.select(F.col("root").alias("idx"), *C, "radius", "confidence", *SUMS, "sum_sq", "parts"), p.voxel, C)


def create_surfels(seeds: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """B17, B14's second half, B27: seeds(seed_id, c*, n*) with the surfel that takes their points (idx), or started anew.

    A seed without a target starts as B7 does: one point, weight 1, a round of init_radius. Those go
    through add_surfels; the points of the others go through fuse_all under idx.
    """
    new = F.col("idx").isNull()
    first = lambda v: F.when(new, F.lit(v))
    out = seeds.join(merge_targets(seeds, surfels, p).select("seed_id", "idx"), "seed_id")
    out = out.withColumns({"is_new": new, "l0": first(p.init_radius**2), "l1": first(p.init_radius**2), "total_weight": first(1.0), "point_count": first(1), "observations": first(1), "sum_sq": first(0.0)})
    return out.withColumns({f"sum_n{a}": F.when(new, F.col(f"n{a}")) for a in "xyz"})


def aspect_ratio(surfels: DataFrame) -> DataFrame:
    """sqrt(l0 / l1), 0 where l1 isn't positive."""
    return surfels.withColumn("aspect", F.when(F.col("l1") > 0, F.sqrt(F.col("l0") / F.col("l1"))).otherwise(0.0))


def prune(surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Without surfels of low confidence that were observed often enough."""
    return surfels.where(~((F.col("confidence") < p.min_confidence) & (F.col("observations") >= p.min_observations)))


def decay(surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """B24."""
    return surfels.withColumn("confidence", F.col("confidence") * p.decay)


def map_statistics(surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Counts and means over mature surfels, all surfels and occupied voxels."""
    mature = F.sqrt("l1") >= p.min_radius
    s = with_key(surfels, p.voxel, C)
    return s.agg(
        F.count("*").alias("total"), F.count_if(mature).alias("mature"), F.countDistinct(*KEY).alias("voxels"),
        L.rounded(F.avg(F.when(mature, F.col("confidence")))).alias("mean_confidence"), L.rounded(F.avg(F.when(mature, F.sqrt("l1")))).alias("mean_radius"),
    )


# --- sequential fusion -----------------------------------------------------------------------


def fuse(state: dict, points: np.ndarray, point_normals: np.ndarray, stamps: np.ndarray, p: FusionParams) -> dict:
    """Fold points, in order, into one surfel; its frame moves, so sums don't merge."""
    c, n = np.array(state["center"], float), np.array(state["normal"], float)
    u, v = _basis(n)
    w, count, seen, last = state["weight"], state["points"], state["observations"], state["stamp"]
    sum_n, sum_t, sum_o, sq = (np.array(state[k], float) for k in ("sum_normals", "sum_tangent", "sum_outer", "sum_sq"))
    cov = np.array(state["covariance"], float)
    for x, pn, t in zip(points, point_normals, stamps, strict=True):
        d = x - c
        a, h = np.array([d @ u, d @ v]), d @ n
        sq = sq + h * h
        c = c + p.center_rate * p.weight / (w + p.weight) * (a[0] * u + a[1] * v)
        sum_n = sum_n + p.weight * pn
        if seen % 5 == 0:
            mean = sum_n / max(np.linalg.norm(sum_n), 1e-30)
            n = n + p.normal_rate * (mean - n)
            n = n / np.linalg.norm(n)
            u, v = _basis(n)
        sum_t, sum_o, w, count = sum_t + p.weight * a, sum_o + p.weight * np.outer(a, a), w + p.weight, count + 1
        if count % 5 == 0 and count >= 3:
            m = sum_t / w
            cov = sum_o / w - np.outer(m, m) + 1e-6 * np.eye(2)
        if t != last:
            seen += 1
        last = t
    return {"center": c, "normal": n, "weight": w, "points": count, "observations": seen, "stamp": last, "sum_normals": sum_n, "sum_tangent": sum_t, "sum_outer": sum_o, "sum_sq": float(sq), "covariance": cov}


def _basis(n: np.ndarray):
    ref = np.array([0.0, 0.0, 1.0]) if abs(n[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
    u = np.cross(n, ref)
    u = u / np.linalg.norm(u)
    return u, np.cross(n, u)


def new_state(center, normal, radius: float, stamp: int) -> dict:
    """B7."""
    return {"center": np.array(center, float), "normal": np.array(normal, float), "weight": 1.0, "points": 1, "observations": 1, "stamp": stamp, "sum_normals": np.array(normal, float), "sum_tangent": np.zeros(2), "sum_outer": np.zeros((2, 2)), "sum_sq": 0.0, "covariance": radius**2 * np.eye(2)}


STATE = ("sum_u", "sum_v", "sum_uu", "sum_uv", "sum_vv", "cov_uu", "cov_uv", "cov_vv")
FUSED = "idx long, cx double, cy double, cz double, nx double, ny double, nz double, l0 double, l1 double, point_count long, observations long, total_weight double, sum_sq double, sum_nx double, sum_ny double, sum_nz double, stamp long, " + ", ".join(f"{c} double" for c in STATE)
KEPT = [c.split()[0] for c in FUSED.split(", ")]


def stored_state(row) -> dict:
    """The state that a row of FUSED holds."""
    suu, suv, svv, cuu, cuv, cvv = (float(row[c]) for c in STATE[2:])
    return {
        "center": row[list(C)].to_numpy(float), "normal": row[["nx", "ny", "nz"]].to_numpy(float), "weight": float(row.total_weight), "points": int(row.point_count), "observations": int(row.observations), "stamp": int(row.stamp),
        "sum_normals": row[["sum_nx", "sum_ny", "sum_nz"]].to_numpy(float), "sum_tangent": row[["sum_u", "sum_v"]].to_numpy(float), "sum_outer": np.array([[suu, suv], [suv, svv]]), "sum_sq": float(row.sum_sq), "covariance": np.array([[cuu, cuv], [cuv, cvv]]),
    }


def fuse_all(associated: DataFrame, surfels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """B1, B8 in snapshot mode: the points of each surfel in the order (stamp, point_id).

    associated(idx, stamp, point_id, x.., pnx..). surfels(idx, c*, n*) with the columns of FUSED go on
    from the state they hold, so batches one after another, each associated by its caller, add up;
    without those columns, or where they are null, a surfel starts as new (B7). Surfels without
    points give no row. One surfel's points make a group: those of one batch on one patch, bounded
    by the scan grid.
    """
    held = [c for c in KEPT if c not in ("idx", *C, "nx", "ny", "nz", "l0", "l1")]
    whole = set(held) <= set(surfels.columns)
    start = surfels.select("idx", F.struct(*C, "nx", "ny", "nz", *(held if whole else [])).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stamp", "point_id"])
        f = pd.Series(pdf["s"].iloc[0], dtype=object)
        if whole and not f[held].isna().any():
            s = stored_state(f)
        else:
            s = new_state(f[list(C)].to_numpy(float), f[["nx", "ny", "nz"]].to_numpy(float), p.init_radius, int(pdf["stamp"].iloc[0]))
        s = fuse(s, pdf[["x", "y", "z"]].to_numpy(float), pdf[["pnx", "pny", "pnz"]].to_numpy(float), pdf["stamp"].to_numpy(), p)
        e, o, cov = np.maximum(np.linalg.eigvalsh(s["covariance"]), 1e-8), s["sum_outer"], s["covariance"]
        sums = [*s["sum_tangent"], o[0, 0], o[0, 1], o[1, 1], cov[0, 0], cov[0, 1], cov[1, 1]]
        return pd.DataFrame([[pdf["idx"].iloc[0], *s["center"], *s["normal"], *e, s["points"], s["observations"], s["weight"], s["sum_sq"], *s["sum_normals"], int(s["stamp"]), *sums]], columns=KEPT)

    points = associated.where("idx is not null").select("idx", "stamp", "point_id", "x", "y", "z", "pnx", "pny", "pnz")
    return points.join(start, "idx").groupBy("idx").applyInPandas(run, FUSED)
