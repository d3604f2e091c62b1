"""Dense vector math on ARRAY<DOUBLE> columns as native higher-order expressions (VEC-1…8).

Model-sized state (centres, cluster masses) enters as literal arrays, so assignment and soft
assignment are row-local: no shuffle and no N×K intermediate rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def vsum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def sq_norm(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v)


# Per-row statistics are passed into the element lambdas through ``aggregate(..., finish)``:
# a lambda that referenced an outer expression would re-evaluate it for every element.

def l2_normalize(x) -> Column:
    """VEC-1: x / ‖x‖₂; a zero vector gives null."""
    xc = _c(x)
    return F.aggregate(xc, F.lit(0.0), lambda a, v: a + v * v,
                       lambda ss: F.when(ss > 0, F.transform(xc, lambda v: v / F.sqrt(ss))))


def layer_norm(x, eps: float = 0.0, ddof: int = 0) -> Column:
    """VEC-2 (eps = 0, population std, null when the std is 0) and VEC-3 (eps > 0, ddof 0 or 1):
    (x − mean) / (std + eps), two passes (mean, then squared deviations)."""
    xc = _c(x)
    n = F.size(xc).cast("double")

    def with_mean(total):
        m = total / n
        return F.aggregate(
            xc, F.lit(0.0), lambda a, v: a + (v - m) * (v - m),
            lambda ss: F.when(F.sqrt(ss / (n - F.lit(float(ddof)))) + F.lit(float(eps)) > 0,
                              F.transform(xc, lambda v: (v - m) / (F.sqrt(ss / (n - F.lit(float(ddof)))) + F.lit(float(eps))))))
    return F.aggregate(xc, F.lit(0.0), lambda a, v: a + v, with_mean)


def identity_transform(x) -> Column:
    """VEC-4."""
    return _c(x)


def sq_distance(x, c) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)


def euclidean_distance(x, c) -> Column:
    """VEC-5."""
    return F.sqrt(sq_distance(x, c))


def cosine_similarity(x, y) -> Column:
    """VEC-6: dot product of the normalised vectors (null if either is zero)."""
    nx, ny = F.sqrt(sq_norm(x)), F.sqrt(sq_norm(y))
    return F.when((nx > 0) & (ny > 0), dot(x, y) / (nx * ny))


def nearest_center(x, centers: Column) -> Column:
    """JOIN-7: struct(dist2, center_id) of the nearest centre; ties go to the lowest id."""
    cand = F.transform(centers, lambda c, j: F.struct(sq_distance(x, c).alias("dist2"), j.alias("center_id")))
    return F.array_min(cand)


def student_t_assignment(x, centers: Column, alpha: float = 1.0) -> Column:
    """VEC-7: u_j = (1 + ‖x − c_j‖²/α)^(−(α+1)/2), q = u / Σu."""
    power = (alpha + 1.0) / 2.0
    u = F.transform(centers, lambda c: F.pow(F.lit(1.0) + sq_distance(x, c) / F.lit(alpha), F.lit(-power)))
    return normalize_sum(u)


def normalize_sum(arr) -> Column:
    """Divide an array by its sum (sum computed once per row)."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, v: a + v,
                       lambda s: F.transform(_c(arr), lambda v: v / s))


def target_distribution(q, mass: Column) -> Column:
    """VEC-8: p_ij ∝ q_ij² / f_j, renormalised per row; ``mass`` = Σ_i q_ij (a literal K-vector)."""
    return normalize_sum(F.zip_with(_c(q), mass, lambda a, f: a * a / f))


def argmax(arr) -> Column:
    """TOP-4: zero-based index of the largest element, ties → lowest index."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# Fixed small table: ln(n!) for n < 16 computed exactly; beyond that the Stirling series
# (error < 1e-14 at n = 16).
_LNFACT_SMALL = [math.lgamma(n + 1.0) for n in range(16)]


def ln_factorial(n) -> Column:
    """ln(n!) for a non-negative integer column (Spark SQL has no lgamma)."""
    nc = _c(n).cast("double")
    small = F.element_at(F.array(*[F.lit(v) for v in _LNFACT_SMALL]), _c(n).cast("int") + 1)
    big = (nc * F.log(nc) - nc + 0.5 * F.log(F.lit(2 * math.pi) * nc)
           + 1.0 / (12.0 * nc) - 1.0 / (360.0 * F.pow(nc, 3)) + 1.0 / (1260.0 * F.pow(nc, 5))
           - 1.0 / (1680.0 * F.pow(nc, 7)))
    return F.when(nc < 16, small).otherwise(big)
