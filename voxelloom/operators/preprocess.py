"""Scan preprocessing: filters, spherical grid, range image, smoothing, normals and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..params import ScanParams


def filter_points(points: DataFrame, p: ScanParams = ScanParams(), height: tuple | None = None) -> DataFrame:
    """Finite points in range, above ground and in view, with r_sq, yaw and pitch.

    points(scan_id, point_idx, x, y, z, ...); height is (r20, r21, r22, tz), the sensor pose's third
    row, as numbers or column names; without it there is no ground filter. Empty scans give no rows.
    """
    x, y, z = L.vec()
    # Coordinates and angles are used many times over; written out into each use they cost more than all else.
    out = L.once(points, dict(zip("xyz", (x, y, z), strict=True)))
    out = out.where(L.finite(x, y, z)).withColumn("r_sq", L.dot((x, y, z), (x, y, z)))
    out = out.where(F.col("r_sq").between(p.min_range**2, p.max_range**2))
    if p.ground_filter and height is not None:
        h = [F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in height]
        out = out.where(h[0] * x + h[1] * y + h[2] * z + h[3] >= p.ground_z_min)
    out = L.once(out, {"yaw": F.atan2(y, x), "pitch": F.atan2(z, F.sqrt(x * x + y * y))})
    return out.where(F.col("yaw").between(-p.hfov / 2, p.hfov / 2) & F.col("pitch").between(-p.vfov / 2, p.vfov / 2))


def _cells(filtered: DataFrame, p: ScanParams, ds: int) -> DataFrame:
    u = ((F.col("yaw") + p.hfov / 2) * ((p.width - 1) / p.hfov) / ds + 0.5).cast("int")
    v = ((F.col("pitch") + p.vfov / 2) * ((p.height - 1) / p.vfov) / ds + 0.5).cast("int")
    return filtered.withColumn("u", u).withColumn("v", v)


def _nearest(cells: DataFrame, order: list[str]) -> DataFrame:
    """Arg-min per (scan_id, u, v) by a struct: partial and final hash aggregation, no sort of a scan."""
    best = cells.groupBy("scan_id", "u", "v").agg(F.min(F.struct(*order, "x", "y", "z")).alias("b"))
    return best.select("scan_id", "u", "v", "b.point_idx", "b.x", "b.y", "b.z", "b.r_sq")


def grid_downsample(filtered: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """P5: the nearest point of each grid cell; of equal ranges the first point."""
    cells = _cells(filtered, p, p.ds).where((F.col("u") < p.grid_w) & (F.col("v") < p.grid_h))
    return _nearest(cells, ["r_sq", "point_idx"])


def grid_downsample_blocks(filtered: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """Nearest point at full resolution, then of each ds x ds block; ties by row, then column."""
    full = _nearest(_cells(filtered, p, 1).where((F.col("u") < p.width) & (F.col("v") < p.height)), ["r_sq", "point_idx"])
    blocks = full.withColumnsRenamed({"u": "u1", "v": "v1"})
    blocks = blocks.withColumn("u", F.floor(F.col("u1") / p.ds).cast("int")).withColumn("v", F.floor(F.col("v1") / p.ds).cast("int"))
    return _nearest(blocks, ["r_sq", "v1", "u1", "point_idx"])


def range_image(grid: DataFrame) -> DataFrame:
    """Range of each cell that exists; a missing row is an invalid cell."""
    return grid.withColumn("range", F.sqrt("r_sq"))


def _weigh(axis: str, p: ScanParams):
    """Adds a neighbour (i, at) to the sums of a cell."""

    def add(acc, n):
        step, gap = (n["i"] - F.col(axis)).cast("double"), n["at"] - F.col("range_smooth")
        w = F.when(F.abs(gap) <= p.max_jump, F.exp(-(step * step) / (2 * p.spatial_sigma**2)) * F.exp(-(gap * gap) / (2 * p.depth_sigma**2))).otherwise(0.0)
        return F.struct((acc["total"] + w * n["at"]).alias("total"), (acc["weight"] + w).alias("weight"))

    return add


def smooth(ranges: DataFrame, p: ScanParams = ScanParams(), variant: str = "forward_only") -> DataFrame:
    """Adds range_smooth: bilateral means along rows, then columns, smooth_iters times.

    Each pass is a window over the cells of a line whose index lies within smooth_radius: a neighbour
    weighs by its steps and by its range's difference, and not at all beyond max_jump. Cells that
    don't exist weigh nothing. forward_only looks only to later columns and rows and leaves the first
    smooth_radius alone; symmetric looks both ways; identity returns its input. All passes keep a scan
    where it is, so there is one shuffle by scan at most.
    """
    out = ranges.withColumn("range_smooth", F.col("range").cast("double"))
    if variant == "identity":
        return out
    r, back = p.smooth_radius, 0 if variant == "forward_only" else -p.smooth_radius
    out = out.repartition("scan_id")
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))
    for _ in range(p.smooth_iters):
        for axis, line in (("u", "v"), ("v", "u")):
            frame = Window.partitionBy("scan_id", line).orderBy(axis).rangeBetween(back, r)
            out = out.withColumn("_near", F.collect_list(F.struct(F.col(axis).alias("i"), F.col("range_smooth").alias("at"))).over(frame))

            mean = F.aggregate("_near", zero, _weigh(axis, p), lambda acc: F.when(acc["weight"] > 1e-6, acc["total"] / acc["weight"]))
            mean = F.coalesce(mean, F.col("range_smooth"))
            if variant == "forward_only":
                mean = F.when(F.col(axis) < r, F.col("range_smooth")).otherwise(mean)
            out = out.withColumn("range_smooth", mean).drop("_near")
    return out


def normals(grid: DataFrame, p: ScanParams = ScanParams(), keep_all: bool = False) -> DataFrame:
    """Normal, sin of the tangents' angle and measurement weight.

    Needs range (gates neighbours, P11) and x, y, z (differences, P12). The four neighbours come
    from lag and lead along rows and columns, kept only if their index differs by one. keep_all
    leaves cells without a normal with nulls (P14).
    """
    here = F.struct("u", "v", "range", "x", "y", "z")
    along = Window.partitionBy("scan_id", "v").orderBy("u")
    across = Window.partitionBy("scan_id", "u").orderBy("v")
    g = grid.withColumn("l", F.lag(here).over(along)).withColumn("r", F.lead(here).over(along))
    g = g.withColumn("t", F.lag(here).over(across)).withColumn("b", F.lead(here).over(across))

    def ok(n: str, axis: str, step: int):
        near = (F.col(f"{n}.{axis}") == F.col(axis) + step) & (F.abs(F.col(f"{n}.range") - F.col("range")) <= p.max_jump)
        return F.coalesce(near, F.lit(False))

    def tangent(back: str, fore: str, axis: str, c: str):
        lo, hi, mid = F.col(f"{back}.{c}"), F.col(f"{fore}.{c}"), F.col(c)
        return F.when(ok(back, axis, -1) & ok(fore, axis, 1), hi - lo).when(ok(fore, axis, 1), hi - mid).when(ok(back, axis, -1), mid - lo)

    tangents = {f"tu{c}": tangent("l", "r", "u", c) for c in "xyz"} | {f"tv{c}": tangent("t", "b", "v", c) for c in "xyz"}
    g = L.once(g, tangents).drop("l", "r", "t", "b")
    tu, tv, pos = L.vec("tu"), L.vec("tv"), L.vec()
    g = L.once(g, {f"c{c}": v for c, v in zip("xyz", L.cross(tu, tv), strict=True)})
    g = L.once(g, {"len": L.norm(L.vec("c"))})
    good = F.coalesce(F.col("len") >= 1e-6, F.lit(False))
    flip = F.when(F.lit(p.orient) & (L.dot(L.vec("c"), pos) > 0), -1.0).otherwise(1.0)
    sin = F.when(good, F.col("len") / (L.norm(tu) * L.norm(tv)))
    g = L.once(g, {f"n{c}": F.when(good, flip * F.col(f"c{c}") / F.col("len")) for c in "xyz"} | {"sin_theta": sin})
    cos = F.abs(L.dot(L.vec("n"), L.unit(pos)))
    weight = 1 / (1 + p.range_alpha * L.dot(pos, pos)) * F.pow(cos, 1.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sin_theta")))
    g = g.withColumn("w", weight)
    out = g.select(*grid.columns, "nx", "ny", "nz", "sin_theta", "w")
    return out if keep_all else out.where("nx is not null")


def preprocess(points: DataFrame, p: ScanParams = ScanParams(), height: tuple | None = None, variant: str = "forward_only") -> DataFrame:
    """Points to points with normals; neighbours are gated by smoothed ranges, positions stay raw."""
    ranges = range_image(grid_downsample(filter_points(points, p, height), p))
    gated = smooth(ranges, p, variant if p.smooth_iters > 0 else "identity")
    return normals(gated.withColumn("range", F.col("range_smooth")), p)


def to_world(points: DataFrame, yaw: str, t: tuple[str, str, str], with_normals: bool = False) -> DataFrame:
    """Rigid transform by a pose with a yaw and a translation; normals turn and are scaled to 1."""
    p = L.add(L.rotate_yaw(L.vec(), F.col(yaw)), tuple(F.col(c) for c in t))
    out = points.withColumns(dict(zip("xyz", p, strict=True)))
    if with_normals:
        n = L.unit(L.rotate_yaw(L.vec("n"), F.col(yaw)))
        out = out.withColumns({f"n{c}": v for c, v in zip("xyz", n, strict=True)})
    return out
