"""A stated set of queries meets all rows: blocks of queries with units of rows.

Units (a tree, an index segment) and blocks of queries are rows with a binary column each.  Both are
dealt into groups of a bounded number, and every group of units meets every group of blocks in a
task of its own, so that a task holds ``UNITS`` units and ``BLOCKS`` blocks whatever the tables hold.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS, BLOCKS = 16, 8


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def grouped(df: DataFrame, key: str, together: int) -> tuple[DataFrame, int]:
    """``df`` with its group, and the number of groups; ``df`` is counted: pass a kept table."""
    n = max(1, -(-df.count() // together))
    return df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def meet(units: tuple[DataFrame, int], blocks: tuple[DataFrame, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over each group of units with each group of blocks (both from ``grouped``)."""
    (rows, n_rows), (asks, n_asks) = units, blocks
    left = rows.withColumnRenamed("_group", "_g").withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    right = asks.withColumnRenamed("_group", "_h").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    return left.groupBy("_g", "_h").cogroup(right.groupBy("_g", "_h")).applyInArrow(run, schema)
