"""Vector arithmetic as Column expressions, and numpy twins for Arrow batches.

Everything is computed in double precision. Vectors are arrays of float or double.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "l2")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine; an error for a zero vector, as writes of one are refused."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.raise_error(F.lit("cosine of a zero vector")))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(l2sq(a, b))


def distance(a: str | Column, b: str | Column, metric: str) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric is {metric!r}, not one of {METRICS}")
    return cosine_distance(a, b) if metric == "cosine" else l2_distance(a, b)


def normalise(a: str | Column) -> Column:
    """v / |v| as doubles; an error for a zero or non-finite vector."""
    a = _col(a)
    size = norm(a)
    sound = (size > 0) & ~F.isnan(size) & (size < F.lit(float("inf")))
    return F.when(sound, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.raise_error(F.lit("a vector is zero or not finite")))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def centroids(frame: DataFrame, group: str, vector: str, metric: str = "l2") -> DataFrame:
    """group and centroid, the mean vector (a unit one for cosine). One shuffle of sums per dimension."""
    long = frame.select(group, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return out.withColumn("centroid", normalise("centroid")) if metric == "cosine" else out


def page_bound(gap: Column, metric: str) -> Column:
    """Least distance of a member from a query `gap` (chord for cosine) beyond a page's radius."""
    gap = F.greatest(gap, F.lit(0.0))
    return gap * gap / 2 if metric == "cosine" else gap * gap


def sketch8(a: str | Column) -> Column:
    """Signed bytes of a unit vector: clamp(round(127 v))."""
    return F.transform(_col(a), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127).cast("int"))))


def residual4(a: str | Column, centroid: str | Column) -> Column:
    """4-bit codes of the residual against a centroid: peak scaled to 7. struct(peak, codes)."""
    rest = F.zip_with(_col(a), _col(centroid), lambda x, y: x.cast("double") - y.cast("double"))
    peak = F.array_max(F.transform(rest, F.abs))
    codes = F.transform(rest, lambda x: F.when(peak > 0, F.round(x / peak * 7)).otherwise(0).cast("int"))
    return F.struct(peak.alias("peak"), codes.alias("codes"))


def estimated_l2sq(query: str | Column, centroid: str | Column, a: str | Column) -> Column:
    """Squared distance from 4-bit codes: the query's and the vector's distance to the centroid,
    and the angle between their residuals as the codes tell it, corrected by how far the codes
    are from the residual."""
    minus = lambda x, y: F.zip_with(_col(x), _col(y), lambda p, q: p.cast("double") - q.cast("double"))
    far, own = minus(query, centroid), minus(a, centroid)
    codes = residual4(a, centroid)["codes"]
    along = dot(codes, own)  # codes over residual: both scales cancel in the quotient below
    angle = F.when(along > 0, dot(codes, far) * dot(own, own) / along).otherwise(0.0)
    return F.greatest(dot(far, far) + dot(own, own) - 2 * angle, F.lit(0.0))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def units(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    sizes = np.sqrt((rows * rows).sum(1, keepdims=True))
    if not np.isfinite(sizes).all() or (sizes == 0).any():
        raise ValueError("a vector is zero or not finite")
    return rows / sizes


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two matrices; units() rows are expected for cosine."""
    if metric == "cosine":
        return 1 - queries @ rows.T
    square = (queries * queries).sum(1)[:, None] - 2 * queries @ rows.T + (rows * rows).sum(1)
    return np.sqrt(np.maximum(square, 0))


def estimate_memory(dimensions: int, vectors: int, overhead_bytes: int = 64, amplification: float = 1.5) -> dict[str, int]:
    """Bytes that `vectors` vectors take: raw floats, one code byte a dimension, fixed columns, with spare room."""
    if dimensions <= 0 or vectors < 0:
        raise ValueError("dimensions must be positive and vectors not negative")
    raw, codes, fixed = 4 * dimensions * vectors, dimensions * vectors, overhead_bytes * vectors
    return {"vector_bytes": raw, "screening_bytes": codes, "fixed_bytes": fixed, "total_bytes": int((raw + codes + fixed) * amplification)}
