"""Frustum visibility with occlusion, coverage scores and bookkeeping.

Viewpoints meet surfels by an equi-join on coarse blocks of keys that the frustum's box covers, then
by the exact tests, so the pairs made are those in reach, not viewpoints x surfels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint, meet, spread
from ..params import CameraParams
from .voxel import KEY, center, neighbours

BLOCK = 32
REACH = [f"reach{i}" for i in range(6)]


def frustum_box(viewpoints: DataFrame, c: CameraParams = CameraParams()) -> DataFrame:
    """V1: bounding box of the eight corners of each viewpoint's frustum (no roll or pitch)."""
    cos, sin = F.cos("yaw"), F.sin("yaw")
    out = viewpoints
    for axis, fwd, right in (("x", cos, sin), ("y", sin, -cos)):
        ends = [F.col(axis) + fwd * d + right * (d * c.tan_h * s) for d in (c.min_range, c.max_range) for s in (-1, 1)]
        out = out.withColumn(f"lo{axis}", F.least(*ends)).withColumn(f"hi{axis}", F.greatest(*ends))
    return out.withColumn("loz", F.col("z") - c.max_range * c.tan_v).withColumn("hiz", F.col("z") + c.max_range * c.tan_v)


def planes(c: CameraParams = CameraParams()):
    """V1: six inward planes in camera axes: (forward, right, up) coefficients and offset, scaled to 1."""
    h, v = math.hypot(1, c.tan_h), math.hypot(1, c.tan_v)
    return (
        (1.0, 0.0, 0.0, -c.min_range),
        (-1.0, 0.0, 0.0, c.max_range),
        (c.tan_h / h, 1 / h, 0.0, 0.0),
        (c.tan_h / h, -1 / h, 0.0, 0.0),
        (c.tan_v / v, 0.0, 1 / v, 0.0),
        (c.tan_v / v, 0.0, -1 / v, 0.0),
    )


def _camera(d, cos, sin):
    """A way in the world's axes as forward, right and up of a camera with that cosine and sine of its yaw."""
    return d[0] * cos + d[1] * sin, d[0] * sin - d[1] * cos, d[2]


def _inside(q, c: CameraParams, reach=(0.0,) * 6):
    out = F.lit(True)
    for (a, b, d, e), r in zip(planes(c), reach, strict=True):
        out = out & (q[0] * a + q[1] * b + q[2] * d + e + r >= 0)
    return out


def point_in_frustum(p, eye, yaw, c: CameraParams = CameraParams()):
    """V2."""
    return _inside(_camera(L.sub(p, eye), F.cos(yaw), F.sin(yaw)), c)


def reaches(half: float, cos, sin, c: CameraParams = CameraParams()):
    """V3: how far a voxel's corners reach from its centre along each plane's normal."""
    return [half * (F.abs(cos * a + sin * b) + F.abs(sin * a - cos * b) + abs(d)) for a, b, d, _ in planes(c)]


def voxel_in_frustum(q, reach, c: CameraParams = CameraParams()):
    """V3: the corner of the voxel (centre q in the camera's axes) that is furthest along each plane's normal lies inside it."""
    return _inside(q, c, reach)


def surfel_visible(q, d2, facing, c: CameraParams = CameraParams()):
    """V5: in range, facing the camera within the incidence limit, and (q in the camera's axes) inside the frustum."""
    near = d2.between(c.min_range**2, c.max_range**2) & (facing > 0) & (facing * facing >= d2 * c.cos2_incidence)
    return near & _inside(q, c)


def _eye(prefix: str = "e"):
    return tuple(F.col(prefix + a) for a in "xyz")


def candidates(viewpoints: DataFrame, surfels: DataFrame, size: float, c: CameraParams = CameraParams(), margin: int = 0) -> DataFrame:
    """Valid surfels within the key box of each viewpoint's frustum: (vp_id, ex, ey, ez, yaw, surfel, boxed).

    margin widens the box by that many keys; boxed tells whether a surfel is in the box as it was.
    """
    boxes = frustum_box(viewpoints.select("vp_id", "x", "y", "z", "yaw"), c)
    keys = [(F.floor if e == "lo" else F.ceil)(F.col(f"{e}{a}") / F.lit(size)).cast("int").alias(f"k{e}{a}") for a in "xyz" for e in ("lo", "hi")]
    reach = [r.alias(f"reach{i}") for i, r in enumerate(reaches(size / 2, F.cos("yaw"), F.sin("yaw"), c))]
    boxes = spread(boxes.select("vp_id", *[F.col(a).alias(f"e{a}") for a in "xyz"], "yaw", F.cos("yaw").alias("cos"), F.sin("yaw").alias("sin"), *reach, *keys), "vp_id")
    for a in "xyz":
        lo, hi = F.floor((F.col(f"klo{a}") - margin) / BLOCK).cast("int"), F.floor((F.col(f"khi{a}") + margin) / BLOCK).cast("int")
        boxes = boxes.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    s = surfels.where("is_valid").select(*KEY, "mx", "my", "mz", "nx", "ny", "nz")
    s = s.withColumns({f"b{a}": F.floor(F.col(k) / BLOCK).cast("int") for a, k in zip("xyz", KEY, strict=True)})
    out = meet(boxes, s, ["bx", "by", "bz"])
    boxed = F.lit(True)
    for a, k in zip("xyz", KEY, strict=True):
        out = out.where(F.col(k).between(F.col(f"klo{a}") - margin, F.col(f"khi{a}") + margin))
        boxed = boxed & F.col(k).between(F.col(f"klo{a}"), F.col(f"khi{a}"))
    return out.select("vp_id", "ex", "ey", "ez", "yaw", "cos", "sin", *REACH, *KEY, "mx", "my", "mz", "nx", "ny", "nz", boxed.alias("boxed"))


def _looked_at(pairs: DataFrame, size: float, c: CameraParams) -> DataFrame:
    """V3, V5: the pairs whose surfel passes V5; direct tells whether the voxel is in the key box and passes V3 too.

    Each camera coordinate is computed once a pair: written into every plane's test they make methods
    that Java doesn't compile.
    """
    cos, sin, to = F.col("cos"), F.col("sin"), L.sub(_eye(), L.vec("m"))
    mean, mid = _camera(L.sub(L.vec("m"), _eye()), cos, sin), _camera(L.sub(center(size), _eye()), cos, sin)
    seen = dict(zip(("qx", "qy", "qz", "wx", "wy", "wz"), (*mean, *mid), strict=True)) | {"d2": L.dot(to, to), "facing": L.dot(L.vec("n"), to)}
    out = L.once(pairs, seen).where(surfel_visible(L.vec("q"), F.col("d2"), F.col("facing"), c))
    out = out.withColumn("direct", F.col("boxed") & voxel_in_frustum(L.vec("w"), [F.col(r) for r in REACH], c))
    return out.select(*[n for n in pairs.columns if n not in ("cos", "sin", "boxed", *REACH)], "direct")


def directly_visible(viewpoints: DataFrame, surfels: DataFrame, size: float, c: CameraParams = CameraParams(), occlusion: bool = False) -> DataFrame:
    """V3, V5, V6: (vp_id, key) seen without the dilation of V4."""
    pairs = _looked_at(candidates(viewpoints, surfels, size, c), size, c).where("direct").drop("direct")
    if occlusion:
        hidden = occluded(pairs, surfels, size)
        pairs = pairs.join(hidden, ["vp_id", *KEY], "left_anti")
    return pairs


def ray_cells(pairs: DataFrame, size: float) -> DataFrame:
    """V6: keys (qx, qy, qz) at steps of size / 2 from the eye, short of the target."""
    d = L.sub(L.vec("m"), _eye())
    out = L.once(pairs, {"dist": L.norm(d)}).withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("dist") / (size / 2)).cast("int") - 1))))
    t = F.col("step") * (size / 2)
    out = out.where(t < F.col("dist"))
    at = tuple(e + x / F.col("dist") * t for e, x in zip(_eye(), d, strict=True))
    return out.withColumns({q: F.floor(v / F.lit(size)).cast("int") for q, v in zip(("qx", "qy", "qz"), at, strict=True)})


def occluded(pairs: DataFrame, surfels: DataFrame, size: float) -> DataFrame:
    """V6: (vp_id, key) whose ray meets another valid surfel's voxel."""
    cells = ray_cells(pairs, size).where("not (qx = vx and qy = vy and qz = vz)").select("vp_id", *KEY, "qx", "qy", "qz")
    solid = surfels.where("is_valid").select(F.col("vx").alias("qx"), F.col("vy").alias("qy"), F.col("vz").alias("qz"))
    return meet(cells, solid, ["qx", "qy", "qz"]).select("vp_id", *KEY).distinct()


def visibility(viewpoints: DataFrame, surfels: DataFrame, size: float, c: CameraParams = CameraParams(), occlusion: bool = False) -> DataFrame:
    """V4: (vp_id, vx, vy, vz): seen voxels and those neighbours of theirs that pass V5.

    What passes V5 has its mean in the frustum, so its voxel is in the frustum's key box or beside
    it. So those are told first, and only the few that aren't seen directly look for a seen neighbour.
    """
    pairs = _looked_at(candidates(viewpoints, surfels, size, c, margin=1), size, c)
    seen, rest = pairs.where("direct"), pairs.where("not direct")
    if occlusion:
        hidden = checkpoint(occluded(seen, surfels, size))
        rest = rest.select("vp_id", *KEY).unionByName(hidden)
        seen = seen.join(hidden, ["vp_id", *KEY], "left_anti")
    seen = seen.select("vp_id", *KEY)
    named = seen.withColumnsRenamed(dict(zip(KEY, ("qx", "qy", "qz"), strict=True)))
    more = neighbours(rest.select("vp_id", *KEY)).join(named, ["vp_id", "qx", "qy", "qz"], "left_semi").select("vp_id", *KEY)
    return seen.unionByName(more).distinct()


def coverage_score(visible: DataFrame, observed: DataFrame) -> DataFrame:
    """V7: per viewpoint the visible and the new voxels, and their ratio."""
    flag = observed.select(*KEY).distinct().withColumn("old", F.lit(1))
    out = visible.join(flag, KEY, "left").groupBy("vp_id").agg(F.count("*").alias("n_visible"), F.count_if(F.col("old").isNull()).alias("n_new"))
    return out.withColumn("coverage", F.col("n_new") / F.col("n_visible"))


def similar(viewpoints: DataFrame, metres: float, radians: float) -> DataFrame:
    """Pairs a < b that lie within metres and radians; by cells of the distance, not by all pairs.

    Viewpoints of one pose make a class: classes meet by cells, and only then their members, dealt by
    id, so that a crowded cell is no task of its own.
    """
    pose = ["x", "y", "z", "yaw"]
    members = viewpoints.select("vp_id", *pose)
    cells = checkpoint(members.groupBy(*pose).agg(F.min("vp_id").alias("class"))).withColumns({k: F.floor(F.col(a) / F.lit(metres)).cast("int") for k, a in zip(KEY, "xyz", strict=True)})
    other = cells.select(F.col("class").alias("class_b"), F.col("yaw").alias("yaw_b"), *[F.col(a).alias(f"b{a}") for a in "xyz"], *[F.col(k).alias(q) for k, q in zip(KEY, ("qx", "qy", "qz"), strict=True)])
    pairs = meet(neighbours(spread(cells, "class"), itself=True), other, ["qx", "qy", "qz"])
    d = L.sub(L.vec(), L.vec("b"))
    near = (L.dot(d, d) <= metres * metres) & (L.yaw_difference(F.col("yaw"), F.col("yaw_b")) <= radians)
    near = checkpoint(pairs.where(near).select("class", "class_b"))
    same = [F.col(a).eqNullSafe(F.col(f"c{a}")) for a in pose]
    named = members.join(cells.select("class", *[F.col(a).alias(f"c{a}") for a in pose]), same).select("vp_id", "class")
    named = checkpoint(named)
    left = meet(spread(named.withColumnRenamed("vp_id", "vp_a"), "vp_a"), near, ["class"])
    right = named.select(F.col("vp_id").alias("vp_b"), F.col("class").alias("class_b"))
    return meet(left, right, ["class_b"], most=1_000_000).where("vp_a < vp_b").select("vp_a", "vp_b")


def observe(visible: DataFrame) -> DataFrame:
    """How often each voxel was observed."""
    return visible.groupBy(*KEY).agg(F.count("*").alias("observations"))


def local_coverage(regions: DataFrame, observed: DataFrame) -> DataFrame:
    """C4: per region_id of regions(region_id, vx, vy, vz) the share of its different voxels that are observed."""
    keys = observed.select(*KEY).distinct().withColumn("hit", F.lit(1.0))
    j = regions.select("region_id", *KEY).distinct().join(keys, KEY, "left")
    return j.groupBy("region_id").agg(F.count("*").alias("total"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("ratio"))


def coverage_ratio(observed: DataFrame, surfels: DataFrame) -> DataFrame:
    """Observed keys over valid surfels, and the same of keys that still are valid surfels."""
    keys = observed.select(*KEY).distinct()
    valid = surfels.where("is_valid").select(*KEY)
    n, o = valid.agg(F.count("*").alias("total")), keys.agg(F.count("*").alias("observed"))
    live = keys.join(valid, KEY, "left_semi").agg(F.count("*").alias("live"))
    one = o.crossJoin(n).crossJoin(live)  # three single rows
    ratio = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return one.select("observed", "total", ratio("observed").alias("coverage"), ratio("live").alias("coverage_live"))
