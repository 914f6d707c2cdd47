"""Vector arithmetic as Catalyst column expressions (PRJ3, PRJ4, PRJ5, PRJ6).

Vectors are ARRAY<DOUBLE>. Every reduction folds left to right starting from
the first term, so a SQL oracle written `a0 + a1 + ...` gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vsum(v) -> Column:
    """Sum of the components, left to right."""
    v = col(v)
    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), v[0], lambda acc, x: acc + x)


def vadd(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def vscale(v, s) -> Column:
    s = col(s) if isinstance(s, str) else (s if isinstance(s, Column) else F.lit(s))
    return F.transform(col(v), lambda x: x * s)


def vdiv(v, s) -> Column:
    s = col(s) if isinstance(s, str) else (s if isinstance(s, Column) else F.lit(s))
    return F.transform(col(v), lambda x: x / s)


def vsquare(v) -> Column:
    """Element-wise square (PRJ3): the per-point contribution to CF2X."""
    return F.transform(col(v), lambda x: x * x)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance (PRJ6)."""
    return vsum(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def centroid(cf1x="cf1x", n="n") -> Column:
    """cf1x / n for n > 0, NULL otherwise (PRJ4)."""
    n = col(n)
    return F.when(n > 0, vdiv(cf1x, n.cast("double")))


def rmsd_multi(cf1x="cf1x", cf2x="cf2x", n="n") -> Column:
    """RMSD of a micro-cluster with n > 1 (PRJ5):

        sqrt(max(0, sum(cf2x)/n - sum(cf1x^2)/n^2))

    The radicand is clamped at 0: cancellation can make it slightly negative.
    """
    nd = col(n).cast("double")
    rad = vsum(cf2x) / nd - vsum(vsquare(cf1x)) / (nd * nd)
    return F.sqrt(F.greatest(rad, F.lit(0.0)))


def dim_sums(features: str, dims: int, prefix: str) -> list[Column]:
    """One `sum` per dimension: stays inside the codegen'd hash aggregate."""
    return [F.sum(F.col(features)[i]).alias(f"{prefix}_{i}") for i in range(dims)]


def pack(prefix: str, dims: int) -> Column:
    return F.array(*[F.col(f"{prefix}_{i}") for i in range(dims)])


def unpack(v: str, dims: int, prefix: str | None = None) -> list[Column]:
    prefix = prefix or v
    return [F.col(v)[i].alias(f"{prefix}_{i}") for i in range(dims)]
