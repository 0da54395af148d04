"""Frontiers of the covered surface, their clusters and view suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint
from ..params import PlannerParams
from .voxel import KEY, center, neighbours

Q = ["qx", "qy", "qz"]


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(k).alias(q) for k, q in zip(KEY, Q, strict=True)])


def expansion_center(visible: DataFrame, covered: DataFrame, size: float) -> DataFrame:
    """One row (cx, cy, cz): mean centre of new visible voxels, else of all visible, else origin."""
    old = covered.select(*KEY).distinct().withColumn("old", F.lit(1))
    rows = visible.select(*KEY).distinct().join(old, KEY, "left")
    new = F.col("old").isNull()
    return rows.agg(*[F.coalesce(F.avg(F.when(new, c)), F.avg(c), F.lit(0.0)).alias(f"c{a}") for a, c in zip("xyz", center(size), strict=True)])


def frontiers(covered: DataFrame, surfels: DataFrame, size: float, around: tuple | None = None, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Valid, uncovered voxels beside covered ones, within reach of a point.

    Returns the key, voxel centre, surfel normal, dist to `around` and score: the count of uncovered
    valid neighbours, plus 1.
    """
    covered = covered.select(*KEY).distinct()
    valid = surfels.where("is_valid").select(*KEY, "nx", "ny", "nz")
    near = neighbours(covered).select(*[F.col(q).alias(k) for k, q in zip(KEY, Q, strict=True)]).distinct()
    open_ = valid.join(covered, KEY, "left_anti")
    out = near.join(open_, KEY)
    out = out.withColumns({a: c for a, c in zip("xyz", center(size), strict=True)})
    at = around or (0.0, 0.0, 0.0)
    d = tuple(F.col(a) - F.lit(float(v)) for a, v in zip("xyz", at, strict=True))
    out = out.withColumn("dist", L.norm(d)).where(F.col("dist") <= p.expansion)
    counts = neighbours(out.select(*KEY)).join(_named(open_), Q, "left_semi").groupBy(*KEY).agg(F.count("*").alias("open"))
    return out.join(counts, KEY, "left").withColumn("score", F.coalesce("open", F.lit(0)) + F.lit(1.0)).drop("open")


def _order(prefix: str = ""):
    """The order in which points lead: by distance, equal to 1e-9, then by key."""
    return F.struct(F.round(F.col(f"{prefix}dist"), 9).alias("dist"), *[F.col(f"{prefix}{k}").alias(k) for k in KEY])


def leaders(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Of points(plan_id, vx, vy, vz, x, y, z, dist) those that lead, and all near pairs (plan_id, a, b), a before b.

    Taken in order, a point leads unless an earlier leader is within radius of it. So a point leads
    as soon as no earlier point in reach is undecided or leads, and what is in reach of a leader is
    decided too: rounds of joins on the near pairs, each for all points of all plans at once, until
    none is left. The first undecided point of every neighbourhood is decided in each round. Pairs
    meet by cells as wide as the radius.
    """
    cells = points.select("plan_id", _order().alias("at"), "x", "y", "z", *[F.floor(F.col(c) / F.lit(radius)).cast("int").alias(k) for c, k in zip("xyz", KEY, strict=True)])
    other = cells.select("plan_id", F.col("at").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[F.col(k).alias(q) for k, q in zip(KEY, Q, strict=True)])
    d = L.sub(L.vec("b"), L.vec())
    pairs = neighbours(cells, itself=True).join(other, ["plan_id", *Q]).where((F.col("at") < F.col("b")) & (L.dot(d, d) <= radius * radius))
    pairs = checkpoint(pairs.select("plan_id", F.col("at").alias("a"), "b"))
    free = cells.select("plan_id", "at")
    found = None
    left = pairs  # between undecided points
    while True:
        new = checkpoint(free.join(left.select("plan_id", F.col("b").alias("at")), ["plan_id", "at"], "left_anti"))
        found = new if found is None else found.unionByName(new)
        first = new.withColumnRenamed("at", "a")
        taken = left.join(first, ["plan_id", "a"], "left_semi").select("plan_id", F.col("b").alias("at"))
        free = checkpoint(free.join(new.unionByName(taken), ["plan_id", "at"], "left_anti"))
        if free.isEmpty():
            return found, pairs
        open_ = free.select("plan_id", F.col("at").alias("a"))
        left = checkpoint(left.join(open_, ["plan_id", "a"], "left_semi").join(open_.withColumnRenamed("a", "b"), ["plan_id", "b"], "left_semi").select("plan_id", "a", "b"))


def cluster(frontier: DataFrame, p: PlannerParams = PlannerParams(), plan_col: str | None = None) -> DataFrame:
    """Frontiers of the nearest band with their cluster.

    Points lead in the order of their distance, equal to 1e-9, then key (leaders); a point belongs to
    the first leader within cluster_radius. Clusters under min_cluster keep their members from others
    but are dropped. Clusters of a plan are numbered by their leaders' order: one row a cluster.
    """
    f = frontier if plan_col else frontier.withColumn("plan_id", F.lit(0).cast("long"))
    f = f.withColumnRenamed(plan_col, "plan_id") if plan_col else f
    nearest = f.groupBy("plan_id").agg(F.min("dist").alias("near"))
    band = checkpoint(f.join(nearest, "plan_id").where(F.col("dist") <= F.col("near") + p.wavefront).drop("near"))
    lead, pairs = leaders(band, p.cluster_radius)
    lead = lead.withColumnRenamed("at", "a")
    member = pairs.join(lead, ["plan_id", "a"], "left_semi").groupBy("plan_id", F.col("b").alias("at")).agg(F.min("a").alias("a"))
    member = checkpoint(member.unionByName(lead.select("plan_id", F.col("a").alias("at"), "a")))
    large = member.groupBy("plan_id", "a").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_cluster)
    number = (F.row_number().over(Window.partitionBy("plan_id").orderBy("a")) - 1).cast("long")
    named = member.join(large.withColumn("cluster", number), ["plan_id", "a"]).select("plan_id", "at", "cluster")
    out = band.withColumn("at", _order()).join(named, ["plan_id", "at"]).drop("at")
    return out.withColumnRenamed("plan_id", plan_col) if plan_col else out


def summaries(clustered: DataFrame, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Centroid, mean normal, priority, and the suggested position and yaw of each cluster."""
    s = clustered.groupBy("plan_id", "cluster").agg(
        F.count("*").alias("members"), F.sum("score").alias("priority"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"]
    )
    s = s.withColumns({f"n{a}": v for a, v in zip("xyz", L.unit(L.vec("s")), strict=True)}).drop("sx", "sy", "sz")
    flat = (F.col("nx"), F.col("ny"), F.col("nz") * 0.3)
    n = L.norm(flat)
    way = [F.when(n < 0.1, F.lit(1.0 if i == 0 else 0.0)).otherwise(c / n) for i, c in enumerate(flat)]
    s = s.withColumns({f"v{a}": F.col(f"c{a}") + w * p.optimal for a, w in zip("xyz", way, strict=True)})
    return s.withColumn("yaw", F.atan2(F.col("cy") - F.col("vy"), F.col("cx") - F.col("vx")))
