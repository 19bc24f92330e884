"""Vector columns for the operators on embeddings: usable rows, equal lengths, integer matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """True where a vector is there and holds neither null nor non-finite components."""
    v = F.col(col)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def doubles(col: str) -> Column:
    return F.transform(col, lambda x: x.cast("double"))


def usual_width(rows: DataFrame, col: str) -> tuple[int, int]:
    """The length that most vectors have (ties to the smaller) and how many have it; (0, 0) without rows."""
    first = rows.groupBy(F.size(col).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return (first["w"], first["n"]) if first else (0, 0)


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<double> column of equal lengths as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scaled_floor(x: np.ndarray, scale: float, most: int) -> np.ndarray:
    """floor(scale * x) as longs; values beyond ``most`` in size become ``most``."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    return np.where(np.abs(y) >= most, np.sign(y).astype(np.int64) * most, np.clip(y, -most, most).astype(np.int64))
