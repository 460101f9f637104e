"""Range and interval joins by time cells.

An interval is entered in every cell it touches and a point in its own, so the join is an equi-join on (key, cell) followed
by the exact predicate; a pair that meets in several cells is kept in the first cell both touch. A hot key is split over
its cells. The cell width should be about the usual length of an interval: longer intervals cost entries, never results.

Defined results: intervals with a null key or end, or that end before they start, meet nothing; ends are inclusive;
repeated rows meet as often as they are given; empty sides give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, key: str, start: str, end: str, width: int, prefix: str) -> DataFrame:
    kept = df.filter(F.col(key).isNotNull() & (F.col(end) >= F.col(start)))
    first, last = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
    return kept.withColumn(f"{prefix}first", first).withColumn("cell", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """Pairs of intervals of one key that share an instant; the sides' other columns must differ in name."""
    a = _cells(left, key, l_start, l_end, width, "_l")
    b = _cells(right, key, r_start, r_end, width, "_r")
    met = a.join(b, [key, "cell"]).filter(
        (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)) & (F.col("cell") == F.greatest("_lfirst", "_rfirst"))
    )
    return met.drop("cell", "_lfirst", "_rfirst")


def points_in(points: DataFrame, intervals: DataFrame, key: str, width: int, at: str, start: str, end: str) -> DataFrame:
    """Points with each interval of their key that holds them."""
    a = points.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("cell", F.floor(F.col(at) / width).cast("long"))
    b = _cells(intervals, key, start, end, width, "_r")
    return a.join(b, [key, "cell"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("cell", "_rfirst")
