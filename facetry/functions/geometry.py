"""Column helpers for points, directions, angles and rigid transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def dist(x1, y1, z1, x2, y2, z2) -> Column:
    dx, dy, dz = _c(x1) - _c(x2), _c(y1) - _c(y2), _c(z1) - _c(z2)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def dot3(a, b) -> Column:
    return _c(a[0]) * _c(b[0]) + _c(a[1]) * _c(b[1]) + _c(a[2]) * _c(b[2])


def cross3(a, b) -> tuple[Column, Column, Column]:
    ax, ay, az = map(_c, a)
    bx, by, bz = map(_c, b)
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def sub3(a, b) -> tuple[Column, Column, Column]:
    return tuple(_c(p) - _c(q) for p, q in zip(a, b))


def norm3(a) -> Column:
    return F.sqrt(dot3(a, a))


def unit3(a, eps: float = 1e-6) -> tuple[Column, Column, Column]:
    """Direction of ``a``; vectors shorter than ``eps`` are divided by 1."""
    n = norm3(a)
    n = F.when(n < eps, F.lit(1.0)).otherwise(n)
    return tuple(_c(p) / n for p in a)


def angle_at(a, b, c) -> Column:
    """Angle a-b-c in radians."""
    u, v = sub3(a, b), sub3(c, b)
    cosine = dot3(u, v) / (norm3(u) * norm3(v))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def angle_deviation(a, b, c, ideal: float) -> Column:
    return F.abs(angle_at(a, b, c) - F.lit(ideal))


def dihedral(a, b, c, d) -> Column:
    b0, b1, b2 = sub3(a, b), sub3(c, b), sub3(d, c)
    n1 = norm3(b1)
    axis = tuple(p / n1 for p in b1)
    v = tuple(p - dot3(b0, axis) * q for p, q in zip(b0, axis))
    w = tuple(p - dot3(b2, axis) * q for p, q in zip(b2, axis))
    return F.atan2(dot3(cross3(axis, v), w), dot3(v, w))


def plane_deviation(a, b, c, d) -> Column:
    phi = F.abs(dihedral(a, b, c, d))
    return F.least(phi, F.lit(PI) - phi)


def angle_penalty(deviation: Column, width: float = PI / 3) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.pow(deviation / F.lit(width), F.lit(2.0)))


def wrap_angle(theta) -> Column:
    """Into [0, 2*pi)."""
    return F.pmod(_c(theta), F.lit(2 * PI))


ROTATION = tuple(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
SHIFT = ("tx", "ty", "tz")


def apply_transform(p, t, shift: bool = True) -> tuple[Column, Column, Column]:
    """R p + t with ``t`` a struct column of r11..r33, tx, ty, tz; ``shift=False`` for normals."""
    t = _c(t)
    out = []
    for i, s in zip((1, 2, 3), SHIFT):
        row = sum(t[f"r{i}{j}"] * _c(v) for j, v in zip((1, 2, 3), p))
        out.append(row + t[s] if shift else row)
    return tuple(out)


def compose_transforms(outer, inner) -> Column:
    """outer after inner."""
    a, b = _c(outer), _c(inner)
    cells = []
    for i in (1, 2, 3):
        for j in (1, 2, 3):
            cells.append(sum(a[f"r{i}{k}"] * b[f"r{k}{j}"] for k in (1, 2, 3)).alias(f"r{i}{j}"))
    for i, s in zip((1, 2, 3), SHIFT):
        cells.append((sum(a[f"r{i}{k}"] * b[u] for k, u in zip((1, 2, 3), SHIFT)) + a[s]).alias(s))
    return F.struct(*cells)


def transform_struct(values: dict[str, float]) -> Column:
    return F.struct(*[F.lit(float(values[n])).alias(n) for n in (*ROTATION, *SHIFT)])


def uniform_from_hash(*cols, seed: int = 0) -> Column:
    """Reproducible number in [0, 1), the same in every retry of a task."""
    return F.pmod(F.xxhash64(*[_c(c) for c in cols], F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def rotation_from_uniforms(u1, u2, u3) -> dict[str, Column]:
    """Uniform random rotation: the matrix of a unit quaternion drawn evenly from the 3-sphere."""
    low, high = F.sqrt(1 - _c(u1)), F.sqrt(_c(u1))
    first, second = _c(u2) * 2 * PI, _c(u3) * 2 * PI
    w, x, y, z = high * F.cos(second), low * F.sin(first), low * F.cos(first), high * F.sin(second)
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )
    return {f"r{i + 1}{j + 1}": rows[i][j] for i in range(3) for j in range(3)}


def shift_outward(p, n, amount: float = 0.25) -> tuple[Column, Column, Column]:
    return tuple(_c(a) + F.lit(amount) * _c(b) for a, b in zip(p, n))


def flip3(n) -> tuple[Column, Column, Column]:
    return tuple(-_c(a) for a in n)
