"""Vectors as arrays of floats."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(ArrayType(FloatType()))
def _decoded(blobs: pd.Series, dimensions: pd.Series) -> pd.Series:
    fits = lambda b, d: b is not None and d == d and d is not None and d > 0 and len(b) == 4 * d
    return pd.Series([np.frombuffer(b, "<f4") if fits(b, d) else None for b, d in zip(blobs, dimensions)])


def from_f32le(blob: Column, dimensions: Column) -> Column:
    """Little-endian 32-bit floats; NULL unless there are exactly `dimensions` (more than 0) of them."""
    return _decoded(blob, dimensions)


@F.pandas_udf(BinaryType())
def _encoded(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def to_f32le(vector: Column) -> Column:
    return _encoded(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within 0 and 2; 1 if a side is NULL, empty, of another dimension or without length."""
    length = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length > 0)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / F.when(length > 0, length)))).otherwise(F.lit(1.0))


def vector_mean(vector: Column, dimension: int) -> Column:
    """Aggregate: the mean of vectors by position, in double precision, as floats; NULL for no vector."""
    return F.when(F.count(vector) > 0, F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")).cast("float") for i in range(dimension)]))
