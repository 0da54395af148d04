"""Surfels as mergeable moments per voxel, their eigen-decomposition, validity and pruning.

State rows hold count, sum_w, the mean offset from the voxel centre and the scatter about it. Two
states merge by sums, so a micro-batch is a partial aggregate and a map update one more aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint
from ..params import SurfelParams
from .voxel import KEY, center, with_key

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
SUMS = ["count", "n_points", "sum_w", "wx", "wy", "wz", *[f"w{p}" for p in PAIRS], "wnx", "wny", "wnz"]


def moment_terms(pwn: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """Each point's voxel and what it adds to the voxel's SUMS, weighted, about the voxel's centre.

    pwn(x, y, z, nx, ny, nz, w). A point whose weight isn't over the gate adds to n_points only.
    """
    d = with_key(pwn, p.voxel)
    d = d.withColumns({f"d{a}": F.col(a) - c for a, c in zip("xyz", center(p.voxel), strict=True)})
    on = F.col("w") > p.min_weight
    w = F.when(on, F.col("w")).otherwise(0.0)
    terms = {"count": F.when(on, 1).otherwise(0).cast("long"), "n_points": F.lit(1).cast("long"), "sum_w": w}
    terms |= {f"w{a}": w * F.col(f"d{a}") for a in "xyz"}
    terms |= {f"w{a}{b}": w * F.col(f"d{a}") * F.col(f"d{b}") for a, b in PAIRS}
    terms |= {f"wn{a}": w * F.col(f"n{a}") for a in "xyz"}
    return d.select(*KEY, *[c.alias(n) for n, c in terms.items()])


def raw_moments(pwn: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """Weighted sums per voxel of points with weight over the gate.

    count has the points used, n_points all of them; a voxel of rejected points stays with count 0.
    Partial aggregation makes a hot voxel one row per task.
    """
    return moment_terms(pwn, p).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])


def merge(*states: DataFrame) -> DataFrame:
    """M6-M9: one map out of several: raw sums add up."""
    out = states[0].select(*KEY, *SUMS)
    for s in states[1:]:
        out = out.unionByName(s.select(*KEY, *SUMS))
    return out.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])


FINAL = ["count", "n_points", "sum_w", "mx", "my", "mz", "sxx", "sxy", "sxz", "syy", "syz", "szz", "nx", "ny", "nz", "e0", "e1", "e2"]
FLAGS = ["is_valid", "is_planar", "is_degenerate"]


def finalise(moments: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """Mean, scatter, eigenvalues, normal and flags of each voxel.

    The covariance is scatter / (sum_w - 1) where sum_w > 1, else the scatter; negative eigenvalues
    are cut to 0. The normal is the eigenvector of the smallest eigenvalue, turned towards the mean
    measured normal; below min_points it is null and the surfel invalid. Arrow batches of voxel
    rows, already aggregated, go through one stacked decomposition.
    """
    types = {c: "long" for c in ("count", "n_points")}
    schema = ", ".join([*(f"{k} int" for k in KEY), *(f"{c} {types.get(c, 'double')}" for c in FINAL), *(f"{c} boolean" for c in FLAGS)])

    def run(batches):
        for pdf in batches:
            yield _finalise(pdf, p)

    return moments.select(*KEY, *SUMS).mapInPandas(run, schema)


def _finalise(pdf: pd.DataFrame, p: SurfelParams) -> pd.DataFrame:
    w = pdf["sum_w"].to_numpy(float)
    some = w > 0
    safe = np.where(some, w, 1.0)
    first = pdf[["wx", "wy", "wz"]].to_numpy(float)
    mean = np.where(some[:, None], first / safe[:, None] + (pdf[KEY].to_numpy() + 0.5) * p.voxel, np.nan)
    second = pdf[[f"w{q}" for q in PAIRS]].to_numpy(float)
    i, j = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 1, 2, 2])
    scatter = np.where(some[:, None], second - first[:, i] * first[:, j] / safe[:, None], np.nan)
    count = pdf["count"].to_numpy()
    ok = (count >= p.min_points) & (w >= p.epsilon)
    cov = np.zeros((len(pdf), 3, 3))
    cov[:, i, j] = cov[:, j, i] = np.where(ok[:, None], np.nan_to_num(scatter) / np.where(w > 1, w - 1, 1)[:, None], 0)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, 0)
    normal = vectors[:, :, 0]
    measured = pdf[["wnx", "wny", "wnz"]].to_numpy(float)
    normal = np.where((normal * measured).sum(1, keepdims=True) < 0, -normal, normal)
    thin = np.where(values[:, 1] > p.epsilon, values[:, 0] / np.where(values[:, 1] > 0, values[:, 1], 1) < p.planarity * p.max_ratio, True)
    valid = ok & (values.max(1, initial=0) <= p.max_eigenvalue) & ((values > p.epsilon).sum(1) >= 2) & thin
    shown = lambda x: np.where(ok[:, None], x, np.nan)
    out = pd.DataFrame(np.column_stack([mean, scatter, shown(normal), shown(values)]), columns=FINAL[3:]).astype(object)
    out = out.where(out.notna(), None)  # missing is null, not NaN
    head = pdf[[*KEY, "count", "n_points", "sum_w"]].reset_index(drop=True)
    flags = pd.DataFrame({"is_valid": valid, "is_planar": ok & (values[:, 0] < p.planarity * values[:, 1]), "is_degenerate": ok & (values[:, 1] < p.degeneracy * values[:, 2])})
    return pd.concat([head, out, flags], axis=1)


def normalized_covariance(surfels_: DataFrame) -> DataFrame:
    """Cxx .. czz: scatter / (sum_w - 1) where sum_w > 1, else the scatter."""
    n = F.when(F.col("sum_w") > 1, F.col("sum_w") - 1).otherwise(1.0)
    return surfels_.withColumns({f"c{q}": F.col(f"s{q}") / n for q in PAIRS})


def surfels(pwn: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """M8: points with normals to the surfel map, before shadow pruning."""
    return finalise(raw_moments(pwn, p), p)


def shadow_edges(valid: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """(vx, vy, vz) of a valid surfel and (qx, qy, qz) of the one it may remove.

    The target is the valid surfel of the voxel at mean - normal x size, with a normal that agrees
    and a mean behind the surfel's plane.
    """
    a = valid.where("is_valid").select(*KEY, "mx", "my", "mz", "nx", "ny", "nz")
    behind = {q: F.floor((F.col(f"m{c}") - F.col(f"n{c}") * p.voxel) / F.lit(p.voxel)).cast("int") for q, c in zip(("qx", "qy", "qz"), "xyz", strict=True)}
    a = a.withColumns(behind).where("not (qx = vx and qy = vy and qz = vz)")
    b = valid.where("is_valid").select(F.col("vx").alias("qx"), F.col("vy").alias("qy"), F.col("vz").alias("qz"), *[F.col(f"{k}{c}").alias(f"b{k}{c}") for k in "mn" for c in "xyz"])
    j = a.join(b, ["qx", "qy", "qz"])
    same = L.dot(L.vec("n"), L.vec("bn")) >= p.shadow_dot
    back = L.dot(L.vec("n"), L.sub(L.vec("bm"), L.vec("m"))) < 0
    return j.where(same & back).select(*KEY, "qx", "qy", "qz")


def acting(edges: DataFrame) -> DataFrame:
    """The edges(vx, vy, vz, qx, qy, qz), one a source at most, that act when sources do so in ascending order.

    An edge acts unless its source is marked by an acting edge of a smaller source. Those edges make
    trees towards greater keys, in which a node acts if none of its children does. A node with one
    undecided child, while its others don't act, is the opposite of that child: it keeps a pointer
    and a parity, and a pointer to a node that has one itself jumps on, so that the steps of a chain
    double each round; leaves and branches are decided from below. Rounds grow with the logarithm of
    the longest chain, whatever the branches.
    """
    key, to = F.struct(*KEY).alias("k"), F.struct(*[F.col(q).alias(k) for q, k in zip(("qx", "qy", "qz"), KEY, strict=True)]).alias("to")
    rows = edges.select(key, to)
    up = rows.where("k < to").join(rows.select(F.col("k").alias("to")), "to", "left_semi").select("k", F.col("to").alias("up"))
    kind = rows.schema["k"].dataType
    t = rows.join(up, "k", "left").select("k", "to", "up", F.lit(None).cast("boolean").alias("acts"), F.lit(None).cast(kind).alias("ptr"), F.lit(None).cast("boolean").alias("odd"))
    t = checkpoint(t)
    while True:
        kids = t.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.max(F.coalesce("acts", F.lit(False))).alias("any"), F.count_if(F.col("acts").isNull()).alias("open"), F.min(F.when(F.col("acts").isNull(), F.col("k"))).alias("only"))
        s = t.join(kids, "k", "left").withColumn("acts", F.coalesce("acts", F.when(F.col("any"), False).when(F.coalesce("open", F.lit(0)) == 0, True)))
        one = F.col("acts").isNull() & (F.col("open") == 1)
        s = s.withColumns({"ptr": F.when(one, F.coalesce("ptr", "only")), "odd": F.when(one, F.coalesce("odd", F.lit(True)))}).select(t.columns)
        ahead = s.select(F.col("k").alias("ptr"), F.col("acts").alias("_acts"), F.col("ptr").alias("_ptr"), F.col("odd").alias("_odd"))
        j = s.join(ahead, "ptr", "left")
        jump = F.col("_ptr").isNotNull()
        told = F.coalesce("acts", F.col("_acts") != F.col("odd"))
        t = checkpoint(j.select("k", "to", "up", told.alias("acts"), F.when(jump, F.col("_ptr")).otherwise(F.col("ptr")).alias("ptr"), F.when(jump, F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd")))
        if t.where("acts is null").isEmpty():
            return t.where("acts").select("k.*", *[F.col(f"to.{k}").alias(q) for q, k in zip(("qx", "qy", "qz"), KEY, strict=True)])


def shadow_prune(surfels_: DataFrame, p: SurfelParams = SurfelParams()) -> DataFrame:
    """The map without shadowed surfels: those that an acting shadow edge points at.

    Voxels act in ascending order of key, and one that is already marked does nothing.
    """
    marked = acting(shadow_edges(surfels_, p)).select(F.col("qx").alias("vx"), F.col("qy").alias("vy"), F.col("qz").alias("vz")).distinct()
    return surfels_.join(marked, KEY, "left_anti")
