"""Small shared helpers: literal arrays of model-sized state."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def literal_matrix(rows) -> Column:
    """K×D model state (centres, weights) as a literal ARRAY<ARRAY<DOUBLE>>."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def literal_vector(vals) -> Column:
    return F.array(*[F.lit(float(v)) for v in vals])


def as_double_array(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("array<double>")
