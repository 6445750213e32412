"""Vector expressions for columns and matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two vector columns; zero when either has no length."""
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix, scaled to length one; zero vectors stay zero."""
    vectors = list(vectors)
    matrix = np.concatenate(vectors).astype(np.float64, copy=False).reshape(len(vectors), -1)
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
