"""Recency stamp and recency-based deletion (VAR1, VAR2; the disabled variants).

stamp = mean tick cf1t/n when n < 2m, else the (1 - m/(2n)) quantile of
Normal(mean tick, sd tick), with sd = sqrt(cf2t/n - mean^2). The quantile
function is the published rational approximation of Acklam, written as a
column expression (no UDF).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the inverse
# normal CDF (Acklam), in their published order.
A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549671010429972e+00, 4.374664141464968e+00, 2.938163982698783e+00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00]
P_LOW = 0.02425


def _horner(coefs: list[float], x: F.Column) -> F.Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_norm(p: F.Column) -> F.Column:
    """Inverse standard normal CDF for 0 < p < 1."""
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lo = _horner(C, q_lo) / (_horner(D, q_lo) * q_lo + F.lit(1.0))
    q_c = p - F.lit(0.5)
    r = q_c * q_c
    mid = _horner(A, r) * q_c / (_horner(B, r) * r + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    hi = -_horner(C, q_hi) / (_horner(D, q_hi) * q_hi + F.lit(1.0))
    return F.when(p < F.lit(P_LOW), lo).when(p <= F.lit(1.0 - P_LOW), mid).otherwise(hi)


def recency_stamp(mcs: DataFrame, m: int) -> DataFrame:
    """VAR1: add `stamp` (NULL for empty clusters)."""
    n = F.col("n").cast("double")
    mean = F.col("cf1t") / n
    sd = F.sqrt(F.greatest(F.col("cf2t") / n - mean * mean, F.lit(0.0)))
    p = F.lit(1.0) - F.lit(float(m)) / (F.lit(2.0) * n)
    stamp = (F.when(F.col("n") <= 0, F.lit(None).cast("double"))
             .when(F.col("n") < F.lit(2 * m), mean)
             .otherwise(mean + sd * inv_norm(p)))
    return mcs.withColumn("stamp", stamp)


def recency_keep(mcs: DataFrame, m: int, now: int, delta: int) -> DataFrame:
    """VAR2: a cluster is safe to delete when n = 0 or stamp < now - delta."""
    st = recency_stamp(mcs, m)
    return st.withColumn("keep", (F.col("n") > 0) & (F.col("stamp") >= F.lit(now - delta)))


def inv_norm_np(p: float) -> float:
    """The same approximation for one probability (used by the model step)."""
    import math

    def horner(cs, x):
        acc = cs[0]
        for c in cs[1:]:
            acc = acc * x + c
        return acc
    if p < P_LOW:
        q = math.sqrt(-2.0 * math.log(p))
        return horner(C, q) / (horner(D, q) * q + 1.0)
    if p <= 1.0 - P_LOW:
        q = p - 0.5
        r = q * q
        return horner(A, r) * q / (horner(B, r) * r + 1.0)
    q = math.sqrt(-2.0 * math.log(1.0 - p))
    return -horner(C, q) / (horner(D, q) * q + 1.0)


def stamp_np(n: int, cf1t: int, cf2t: int, m: int) -> float:
    """VAR1 for one micro-cluster."""
    import math
    if n <= 0:
        return float("-inf")
    mean = cf1t / n
    if n < 2 * m:
        return mean
    sd = math.sqrt(max(cf2t / n - mean * mean, 0.0))
    return mean + sd * inv_norm_np(1.0 - m / (2.0 * n))
