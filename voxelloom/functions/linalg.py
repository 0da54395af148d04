"""Column arithmetic on vectors, rotations and small symmetric matrices; all in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vec(prefix: str = "", names=("x", "y", "z")) -> tuple[Column, ...]:
    return tuple(F.col(prefix + n) for n in names)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a, s):
    return tuple(x * s for x in a)


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a):
    """A zero vector stays zero."""
    n = norm(a)
    return tuple(F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in a)


def wrap(angle: Column) -> Column:
    """To (-pi, pi], by whole turns."""
    return angle - F.lit(2 * math.pi) * F.round(angle / F.lit(2 * math.pi))


def yaw_difference(a: Column, b: Column) -> Column:
    return F.abs(wrap(a - b))


def quaternion_of_yaw(yaw: Column):
    """(qw, qx, qy, qz)"""
    return F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2)


def yaw_of_quaternion(qw, qx, qy, qz) -> Column:
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def rotate_yaw(p, yaw: Column):
    c, s = F.cos(yaw), F.sin(yaw)
    return c * p[0] - s * p[1], s * p[0] + c * p[1], p[2]


def rotation_of_quaternion(qw, qx, qy, qz):
    """Nine columns, row by row."""
    return (
        (1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qw * qz), 2 * (qx * qz + qw * qy)),
        (2 * (qx * qy + qw * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qw * qx)),
        (2 * (qx * qz - qw * qy), 2 * (qy * qz + qw * qx), 1 - 2 * (qx * qx + qy * qy)),
    )


def determinant(rows) -> Column:
    return dot(rows[0], cross(rows[1], rows[2]))


def quaternion_of_rotation(rows):
    """(qw, qx, qy, qz), qw >= 0, of nine columns of a rotation, row by row: by the largest of its four squares.

    The square of that part is a fourth at least, so nothing is lost to cancellation.
    """
    (a, b, c), (d, e, f), (g, h, i) = rows
    squares = (1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i)
    top = F.greatest(*squares)
    scaled = ((top, h - f, c - g, d - b), (h - f, top, b + d, c + g), (c - g, b + d, top, f + h), (d - b, c + g, f + h, top))
    parts = []
    for k in range(4):
        value = F.when(squares[0] == top, scaled[0][k]).when(squares[1] == top, scaled[1][k]).when(squares[2] == top, scaled[2][k]).otherwise(scaled[3][k])
        parts.append(value / (2 * F.sqrt(top)))
    sign = F.when(parts[0] < 0, -1.0).otherwise(1.0)
    return tuple(q * sign for q in parts)


def rotate(rows, p):
    return tuple(dot(r, p) for r in rows)


def finite(*columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def eigenvector3(xx, xy, xz, yy, yz, zz, value):
    """Unit vector of a single eigenvalue of a symmetric 3 x 3 matrix: the longest cross product of two rows of A - value I."""
    r0, r1, r2 = (xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)
    products = [cross(r0, r1), cross(r0, r2), cross(r1, r2)]
    lengths = [dot(p, p) for p in products]
    best = F.greatest(*lengths)
    chosen = [F.when(lengths[0] == best, products[0][i]).when(lengths[1] == best, products[1][i]).otherwise(products[2][i]) for i in range(3)]
    return tuple(F.when(best > 0, c / F.sqrt(best)).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(chosen))


def eigenvalues2(a, b, d, floor: float = 1e-8):
    """Ascending eigenvalues of [[a, b], [b, d]]."""
    half, root = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    return F.greatest(F.lit(floor), half - root), F.greatest(F.lit(floor), half + root)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, whatever their uses.

    The optimizer writes the expression of a column into each of its uses, and long formulas outgrow
    what can be compiled; it doesn't do so across an explode, here of one struct a row.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*[c for c in df.columns if c not in columns], one).select("*", "_once.*").drop("_once")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
