"""Spans that contain a point, by dyadic cover: an equi-join in place of all pairs of a file.

A span is the disjoint union of few blocks ``level, place`` (bytes place << level up to the next), at
most two a level; a point lies in one block of each level.  So a span meets a point in exactly one
key if it contains it, else in none: n spans and m points cost (n + m) log n rows, plus the pairs
that hold, and the keys of one large file are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels for offsets below 2 ** 31.
LEVELS = 31


def cover(start: Column, end: Column) -> Column:
    """Blocks (level, place) of the bytes start .. end, end exclusive; none for an empty span."""
    start, end = start.cast("long"), end.cast("long")

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        lo, hi = F.call_function("shiftright", start + size - 1, level), F.call_function("shiftright", end, level)
        first = F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("place")))
        last = F.when((lo < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("place")))
        return F.array(first, last)

    top = F.floor(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")
    blocks = F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top + 1), at))))
    return F.when(end > start, blocks).otherwise(F.slice(blocks, 1, 0))


def stabs(point: Column) -> Column:
    """The block of each level that holds a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda v: F.struct(v.alias("level"), F.call_function("shiftright", point.cast("long"), v).alias("place")))


def containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of points (file_id, at, ...) with each of spans (file_id, start_byte, end_byte, ...) whose
    bytes, its end included, hold ``at``; other columns must have different names.

    Only blocks that both sides have are joined.
    """
    keyed = spans.withColumn("_b", F.explode(cover(F.col("start_byte"), F.col("end_byte") + 1))).select("*", F.col("_b.level").alias("_level"), F.col("_b.place").alias("_place")).drop("_b")
    asked = points.withColumn("_b", F.explode(stabs(F.col("at")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.place").alias("_place")).drop("_b")
    return asked.join(keyed, ["file_id", "_level", "_place"]).drop("_level", "_place")
