"""Column helpers for fingerprint vectors (widened to double before any arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def vec_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def vec_dist(a, b) -> Column:
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def pad(a, size: int, fill: float = 0.0) -> Column:
    """Exactly ``size`` entries: cut, or filled at the end."""
    a = _c(a)
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)


def gather(a, index) -> Column:
    """Entries of ``a`` at 0-based positions ``index``."""
    return F.transform(_c(index), lambda i: F.get(_c(a), i.cast("int")))


def reshape2d(flat, n_cols) -> Column:
    """A flat value list as rows of ``n_cols``."""
    flat = _c(flat)
    rows = F.floor(F.size(flat) / F.lit(n_cols)).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(flat, i * n_cols + 1, n_cols))).otherwise(
        F.array().cast("array<array<double>>")
    )
