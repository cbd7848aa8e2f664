"""Small vector algebra over columns; everything stays inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
TINY = 1e-12


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, least: float = TINY) -> Vec:
    n = F.greatest(norm(a), F.lit(least))
    return a[0] / n, a[1] / n, a[2] / n


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def rotate(m: list[list], p: Vec) -> Vec:
    return tuple(m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] for i in range(3))  # type: ignore[return-value]


def transform(m: list[list], t: tuple, p: Vec) -> Vec:
    """R p + t; matrix entries are numbers or columns."""
    return tuple(c + t[i] for i, c in enumerate(rotate(m, p)))  # type: ignore[return-value]


def inverse_transform(m: list[list], t: tuple, p: Vec) -> Vec:
    """R' (p - t)."""
    return rotate([list(r) for r in zip(*m)], (p[0] - t[0], p[1] - t[1], p[2] - t[2]))


def yaw(angle: float) -> list[list[float]]:
    c, s = math.cos(angle), math.sin(angle)
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def slerp(a: list[Column], b: list[Column], f: Column) -> list[Column]:
    """Shortest spherical interpolation; nearly equal quaternions interpolate linearly."""
    d0 = reduce(lambda s, ab: s + ab[0] * ab[1], zip(a[1:], b[1:]), a[0] * b[0])
    sign, d = F.when(d0 < 0, -1.0).otherwise(1.0), F.least(F.abs(d0), F.lit(1.0))
    angle = F.acos(d)
    near = d > 0.9995
    s = F.when(near, F.lit(1.0)).otherwise(F.sin(angle))
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / s)
    wb = F.when(near, f).otherwise(F.sin(f * angle) / s) * sign
    q = [wa * x + wb * y for x, y in zip(a, b)]
    n = F.sqrt(reduce(lambda s, c: s + c, [c * c for c in q]))
    return [c / n for c in q]


def ray_basis(d: Vec) -> tuple[Vec, Vec]:
    """Two axes across a unit direction; x and y if the direction is none."""
    steep = F.abs(d[2]) > 0.9
    ref = F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0)
    u = unit(cross(d, ref))
    v = cross(d, u)
    none = F.isnan(u[0]) | F.isnan(u[1]) | F.isnan(u[2]) | (dot(u, u) < 0.5)
    pick = lambda axis, plain: tuple(F.when(none, x).otherwise(c) for c, x in zip(axis, plain))
    return pick(u, (1.0, 0.0, 0.0)), pick(v, (0.0, 1.0, 0.0))


def symmetric_eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """Ascending eigenvalues of a symmetric 3x3 matrix in closed form (no UDF).

    With the mean of the diagonal taken off, the characteristic polynomial is t^3 - 3 a t - 2 b, whose
    three real roots are 2 sqrt(a) cos(w + 2 pi k / 3) for cos(3 w) = b / a^1.5.
    """
    mean = (xx + yy + zz) / 3
    a = ((xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)) / 18 + (xy * xy + xz * xz + yz * yz) / 3
    dx, dy, dz = xx - mean, yy - mean, zz - mean
    b = (dx * dy * dz + 2 * xy * xz * yz - dx * yz * yz - dy * xz * xz - dz * xy * xy) / 2
    ratio = F.coalesce(F.try_divide(b, F.sqrt(a) * a), F.lit(1.0))
    w = F.acos(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0))) / 3
    return [mean + 2 * F.sqrt(a) * F.cos(w + k * 2 * math.pi / 3) for k in (1, -1, 0)]


def matrix_quaternion(m: list[list[Column]]) -> list[Column]:
    """Unit quaternion (x, y, z, w >= 0) of a rotation matrix: of its four forms the one with the largest part.

    Each part's square is known from the diagonal; the other three follow from that part and sums or
    differences across the diagonal.
    """
    squares = [1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2], 1 + m[0][0] + m[1][1] + m[2][2]]
    plus = {(i, j): m[i][j] + m[j][i] for i, j in ((0, 1), (0, 2), (1, 2))}
    minus = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    forms = [
        [squares[0], plus[0, 1], plus[0, 2], minus[0]],
        [plus[0, 1], squares[1], plus[1, 2], minus[1]],
        [plus[0, 2], plus[1, 2], squares[2], minus[2]],
        [*minus, squares[3]],
    ]
    largest = F.greatest(*squares)
    out = []
    for part in range(4):
        c = forms[3][part]
        for form in (2, 1, 0):
            c = F.when(squares[form] == largest, forms[form][part]).otherwise(c)
        w = forms[3][3]
        for form in (2, 1, 0):
            w = F.when(squares[form] == largest, forms[form][3]).otherwise(w)
        out.append(F.when(w < 0, -c).otherwise(c) / (2 * F.sqrt(largest)))
    return out


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))
