"""Voxel keys, spatial queries and neighbour joins.

All joins are equi-joins on integer keys: a neighbourhood becomes an exploded set of keys of bounded
size, a radius one of blocks of voxels, that meets the map by key, never a nested loop over pairs.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L

KEY = ["vx", "vy", "vz"]


def with_key(df: DataFrame, size: float, names=("x", "y", "z"), keys=KEY) -> DataFrame:
    """M3: floor(p / size)."""
    return df.withColumns({k: F.floor(F.col(n) / F.lit(size)).cast("int") for k, n in zip(keys, names, strict=True)})


def with_cell_key(df: DataFrame, size: float, names=("x", "y", "z"), keys=KEY) -> DataFrame:
    """M4: floor(p * (1 / size)) in single precision: on a cell's border it may tell the neighbour of M3's key."""
    inverse = F.lit(float(np.float32(1) / np.float32(size))).cast("float")
    return df.withColumns({k: F.floor(F.col(n).cast("float") * inverse).cast("int") for k, n in zip(keys, names, strict=True)})


def inside(size: float, names=("x", "y", "z"), keys=KEY):
    """M5: whether a point lies in the box of a voxel, whose upper faces belong to the next."""
    out = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        out = out & (F.col(n) >= F.col(k) * F.lit(size)) & (F.col(n) < (F.col(k) + 1) * F.lit(size))
    return out


def center(size: float, keys=KEY):
    """M5: (key + 0.5) size."""
    return tuple((F.col(k) + 0.5) * size for k in keys)


def corners(df: DataFrame, size: float) -> DataFrame:
    """M5: centre, smallest and largest corner of each voxel."""
    for i, k in enumerate(KEY):
        c = "xyz"[i]
        df = df.withColumn(f"c{c}", (F.col(k) + 0.5) * size).withColumn(f"lo{c}", F.col(k) * F.lit(size)).withColumn(f"hi{c}", (F.col(k) + 1) * size)
    return df


def neighbours(keys: DataFrame, reach: int = 1, faces: bool = False, itself: bool = False) -> DataFrame:
    """All columns of keys with the neighbour's key in qx, qy, qz."""
    out, q = keys, ("qx", "qy", "qz")
    for n, k in zip(q, KEY, strict=True):
        out = out.withColumn(n, F.explode(F.sequence(F.col(k) - reach, F.col(k) + reach)))
    d = [F.abs(F.col(n) - F.col(k)) for n, k in zip(q, KEY, strict=True)]
    if not itself:
        out = out.where(d[0] + d[1] + d[2] > 0)
    if faces:
        out = out.where(d[0] + d[1] + d[2] <= 1)
    return out


def neighbour_join(left: DataFrame, right: DataFrame, how: str = "inner", **kw) -> DataFrame:
    """Each row of left with the rows of right (keys renamed) in neighbouring voxels."""
    around = neighbours(left, **kw)
    named = right.withColumnsRenamed(dict(zip(KEY, ("qx", "qy", "qz"), strict=True)))
    return around.join(named, ["qx", "qy", "qz"], how)


BLOCK = ["bx", "by", "bz"]


def block_side(radius: float, size: float) -> int:
    """Voxels a block's side: as long as the radius, so that a ball meets at most 27 blocks."""
    return max(1, math.ceil(radius / size))


def with_block(voxels: DataFrame, side: int) -> DataFrame:
    """The upper level of the index: the block of each voxel."""
    return voxels.withColumns({b: F.floor(F.col(k) / F.lit(side)).cast("int") for b, k in zip(BLOCK, KEY, strict=True)})


def near_blocks(points: DataFrame, radius: float, size: float, names=("x", "y", "z")) -> DataFrame:
    """points with every block (bx, by, bz) that comes within radius, some 20 a point whatever the voxels' size."""
    width = block_side(radius, size) * size
    out = points
    for b, n in zip(BLOCK, names, strict=True):
        out = out.withColumn(b, F.explode(F.sequence(F.floor((F.col(n) - radius) / F.lit(width)).cast("int"), F.floor((F.col(n) + radius) / F.lit(width)).cast("int"))))
    gap = [F.greatest(F.lit(0.0), F.col(b) * F.lit(width) - F.col(n), F.col(n) - (F.col(b) + 1) * F.lit(width)) for b, n in zip(BLOCK, names, strict=True)]
    return out.where(L.dot(gap, gap) <= radius * radius * (1 + 1e-9))


def radius_join(points: DataFrame, voxels: DataFrame, radius: float, size: float, names=("x", "y", "z")) -> DataFrame:
    """Points with every voxel whose centre is within radius; adds dist_sq. points' columns stay.

    A two-level index: points meet blocks, then the voxels of these; the distance decides inside the
    join, so only near pairs leave it. Points with null coordinates meet nothing.
    """
    near = near_blocks(points, radius, size, names)
    voxels = with_block(voxels.select(*KEY, *[c for c in voxels.columns if c not in KEY and c not in points.columns]), block_side(radius, size))
    d = L.sub(center(size), tuple(F.col(n) for n in names))
    met = near.alias("p").join(voxels.alias("v"), [F.col(f"p.{b}") == F.col(f"v.{b}") for b in BLOCK] + [L.dot(d, d) <= radius * radius])
    return met.drop(*BLOCK).withColumn("dist_sq", L.dot(d, d))


def nearest_voxel(points: DataFrame, voxels: DataFrame, most: float, size: float, id_col: str) -> DataFrame:
    """(id, dist_sq) of points(id, x, y, z) to the nearest voxel centre, where that is within `most`.

    Blocks know the box of their voxels' centres. A point's distance to that box is a lower bound, to
    its far corner an upper one; only blocks whose lower bound doesn't pass the point's least upper
    bound are opened.
    """
    side = block_side(most, size)
    inside = with_block(voxels.select(*KEY), side)
    at = dict(zip("xyz", center(size), strict=True))
    boxes = inside.groupBy(*BLOCK).agg(*[f(at[a]).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    j = near_blocks(points.select(id_col, "x", "y", "z"), most, size).join(boxes, BLOCK)
    under = [F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}")) for a in "xyz"]
    over = [F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}"))) for a in "xyz"]
    j = j.select(id_col, "x", "y", "z", *BLOCK, L.dot(under, under).alias("low"), L.dot(over, over).alias("high"))
    j = j.withColumn("bound", F.min("high").over(Window.partitionBy(id_col))).where((F.col("low") <= F.col("bound") * (1 + 1e-9)) & (F.col("low") <= most * most * (1 + 1e-9)))
    d = L.sub(center(size), L.vec())
    near = j.join(inside, BLOCK).groupBy(id_col).agg(F.min(L.dot(d, d)).alias("dist_sq"))
    return near.where(F.col("dist_sq") <= most * most)


def box_query(surfels: DataFrame, lo, hi, size: float) -> DataFrame:
    """Rows whose key lies within the keys of a box, ends included; range predicates that reach the scan."""
    bounds = [(math.floor(a / size), math.floor(b / size)) for a, b in zip(lo, hi, strict=True)]
    cond = F.lit(True)
    for k, (a, b) in zip(KEY, bounds, strict=True):
        cond = cond & F.col(k).between(a, b)
    return surfels.where(cond)


def lookup(points: DataFrame, surfels: DataFrame, size: float) -> DataFrame:
    """Each point with the surfel of its voxel; without one the surfel's columns are null."""
    keyed = with_key(points, size)
    return keyed.join(surfels.select(*KEY, *[c for c in surfels.columns if c not in keyed.columns]), KEY, "left")


def remove(surfels: DataFrame, keys: DataFrame) -> DataFrame:
    """M9: the map without the voxels of keys(vx, vy, vz)."""
    return surfels.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def in_range(points: DataFrame, nearest: float, farthest: float) -> DataFrame:
    """M1: points(x, y, z) of the sensor's frame within its range, ends included; null or NaN places are out."""
    return points.where(L.dot(L.vec(), L.vec()).between(nearest * nearest, farthest * farthest))


def prune_outside(voxels: DataFrame, lo, hi, size: float) -> DataFrame:
    """Voxels whose centre lies in the box, ends included."""
    cond = F.lit(True)
    for c, a, b in zip(center(size), lo, hi, strict=True):
        cond = cond & c.between(float(a), float(b))
    return voxels.where(cond)


def statistics(surfels: DataFrame, size: float) -> DataFrame:
    """One row of counts and the bounding box of voxel centres."""
    c = dict(zip("xyz", center(size), strict=True))
    return surfels.agg(
        F.count("*").alias("num_voxels"),
        F.count_if("is_valid").alias("num_valid"),
        F.count_if(~F.col("is_valid")).alias("num_invalid"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_points"),
        *[L.rounded(f(c[a])).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )


def collisions(points: DataFrame, voxels: DataFrame, radius: float, size: float, id_col: str) -> DataFrame:
    """V9: (id, in_collision): an occupied voxel's centre within radius; with an empty map always true."""
    occupied = voxels.where("count > 0").select(*KEY)
    hit = radius_join(points.select(id_col, "x", "y", "z"), occupied, radius, size).select(id_col).distinct().withColumn("hit", F.lit(True))
    empty = occupied.agg((F.count("*") == 0).alias("empty"))  # one row
    out = points.select(id_col).join(hit, id_col, "left").crossJoin(F.broadcast(empty))
    return out.select(id_col, (F.coalesce("hit", F.lit(False)) | F.col("empty")).alias("in_collision"))


def surface_distance(points: DataFrame, voxels: DataFrame, most: float, size: float, id_col: str) -> DataFrame:
    """Distance to the nearest occupied voxel less half a voxel, at least 0, at most `most`."""
    least = nearest_voxel(points, voxels.where("count > 0"), most, size, id_col)
    out = points.select(id_col).join(least, id_col, "left")
    dist = F.least(F.lit(most), F.greatest(F.lit(0.0), F.sqrt("dist_sq") - size / 2))
    return out.select(id_col, F.coalesce(dist, F.lit(most)).alias("distance"))
