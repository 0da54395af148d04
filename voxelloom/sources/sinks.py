"""Marker and cloud tables for viewers (S9-S14, S18): projections that any writer can store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..operators.surfel import PAIRS, normalized_covariance
from ..operators.voxel import KEY, center
from ..params import FusionParams


#: A direction that no axis of a surface is likely to be square to; it tells the sign of axes.
SIDE = (0.2672612419124244, 0.5345224838248488, 0.8017837257372732)


def _towards(v, way=SIDE):
    """v or -v, whichever points the way."""
    turn = F.when(L.dot(v, tuple(F.lit(c) for c in way)) < 0, -1.0).otherwise(1.0)
    return tuple(c * turn for c in v)


def surfel_markers(surfels: DataFrame) -> DataFrame:
    """Flat ellipse of each valid surfel: place, orientation, scale, coloured by its normal.

    The orientation qw..qz turns x to the axis of the middle eigenvalue, y to that of the largest and
    z to the normal; an axis points to SIDE, but y turns where the three would make a mirror image.
    Scales are twice the standard deviations, of 1e-6 of variance at least.
    """
    rows = normalized_covariance(surfels.where("is_valid"))
    cov = [F.col(f"c{q}") for q in PAIRS]
    rows = rows.withColumns({f"_b{a}": c for a, c in zip("xyz", _towards(L.eigenvector3(*cov, F.col("e2"))), strict=True)})
    rows = rows.withColumns({f"_a{a}": c for a, c in zip("xyz", _towards(L.unit(L.cross(L.vec("n"), L.vec("_b")))), strict=True)})
    turn = F.when(L.determinant((L.vec("_a"), L.vec("_b"), L.vec("n"))) < 0, -1.0).otherwise(1.0)
    columns = (L.vec("_a"), tuple(c * turn for c in L.vec("_b")), L.vec("n"))
    q = L.quaternion_of_rotation(tuple(zip(*columns, strict=True)))
    scale = [(2 * F.sqrt(F.greatest(F.col(e), F.lit(1e-6)))).alias(s) for e, s in (("e1", "scale_x"), ("e2", "scale_y"))]
    colour = [((F.col(f"n{a}") + 1) / 2).alias(c) for a, c in zip("xyz", "rgb", strict=True)]
    return rows.select(*KEY, "mx", "my", "mz", *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)], *scale, F.lit(0.005).alias("scale_z"), *colour)


def coverage_markers(surfels: DataFrame, observed: DataFrame, size: float) -> DataFrame:
    """Green and opaque if observed, else black and faint."""
    seen = observed.select(*KEY).distinct().withColumn("seen", F.lit(True))
    out = surfels.where("is_valid").select(*KEY).join(seen, KEY, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    at = {a: c for a, c in zip("xyz", center(size), strict=True)}
    return out.withColumns(at).withColumn("g", F.when(F.col("seen"), 1.0).otherwise(0.0)).withColumn("alpha", F.when(F.col("seen"), 0.8).otherwise(0.4))


def view_cloud(visible: DataFrame, observed: DataFrame, size: float) -> DataFrame:
    """Centres of visible voxels; yellow if observed before, else green."""
    seen = observed.select(*KEY).distinct().withColumn("seen", F.lit(True))
    out = visible.join(seen, KEY, "left")
    at = {a: c for a, c in zip("xyz", center(size), strict=True)}
    return out.withColumns(at).withColumn("r", F.when(F.coalesce("seen", F.lit(False)), 255).otherwise(0)).withColumn("g", F.lit(255)).drop("seen")


def fusion_markers(surfels: DataFrame, mode: str = "confidence", p: FusionParams = FusionParams()) -> DataFrame:
    """Mature surfels with a colour by confidence, point_count (full at 200) or normal, and a 0.1 m normal."""
    value = {"confidence": F.least(F.lit(1.0), F.col("confidence")), "point_count": F.least(F.lit(1.0), F.col("point_count") / 200) if "point_count" in surfels.columns else F.lit(0.0), "normal": F.lit(None).cast("double")}[mode]
    out = surfels.where(F.sqrt("l1") >= p.min_radius)
    if mode == "normal":
        colour = {c: F.abs(F.col(f"n{a}")) for c, a in zip("rgb", "xyz", strict=True)}
    else:
        colour = {"r": 1 - value, "g": value, "b": F.lit(0.0)}
    tip = {f"t{a}": F.col(f"c{a}") + 0.1 * F.col(f"n{a}") for a in "xyz"}
    return out.withColumns(colour | tip).select("idx", "cx", "cy", "cz", "tx", "ty", "tz", "r", "g", "b")


def remaining_path(path: DataFrame, active: DataFrame) -> DataFrame:
    """Waypoints that a plan still has before it."""
    return path.join(active, "plan_id").where("seq >= active_index").select("plan_id", "seq", "x", "y", "z")


def cloud(points: DataFrame) -> DataFrame:
    """Plain positions."""
    return points.select("scan_id", *[L.rounded(F.col(a)).alias(a) for a in "xyz"])
