"""Rolling counts over time per key, safe for a key that holds a large share of all rows.

A window partition is not a key but a (key, time block): each row is also entered in the block before its own when it can
be reached from there, so a frame of up to the block's length is complete inside one block; only a row's own entry is kept.
The hottest key is thereby split over all its blocks, and the extra rows are at most one per row (``BLOCK`` frames a block).

Defined results: rows with a null key or time are left out; tied timestamps see each other with ``ties='all'`` and are
counted from their place in the order with ``ties='index'``; repeated rows count as they are; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Length of a time block in frames.
BLOCK = 8


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def _blocks(df: DataFrame, key: str, ts: str, frame_us: int) -> DataFrame:
    width = frame_us * BLOCK
    own = F.floor(F.col("_t") / F.lit(width)).cast("long")
    reached = F.floor((F.col("_t") - F.lit(frame_us)) / F.lit(width)).cast("long")
    timed = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_t", micros(F.col(ts)))
    return timed.withColumn("_own", own).withColumn("_block", F.explode(F.array_distinct(F.array(own, reached))))


def forward_counts(df: DataFrame, key: str, ts: str, frame_s: int, tie_break: str, ties: str = "all", name: str = "n_window") -> DataFrame:
    """Each row with the number of its key's rows in ``[ts, ts + frame]``, both ends included."""
    frame_us = frame_s * 1_000_000
    part = W.partitionBy(key, "_block").orderBy("_t")
    count = F.count(F.lit(1)).over(part.rangeBetween(0, frame_us))
    if ties == "index":
        place = W.partitionBy(key, "_block").orderBy("_t", tie_break)
        count = count - (F.row_number().over(place) - F.rank().over(part))
    return (
        _blocks(df, key, ts, frame_us).withColumn(name, count.cast("long")).filter("_block = _own").drop("_t", "_own", "_block")
    )


def peak_counts(df: DataFrame, key: str, ts: str, frame_s: int, tie_break: str, ties: str = "all") -> DataFrame:
    """Per key the largest and the mean rolling count: ``key, peak, mean_count, n_rows``."""
    counted = forward_counts(df.select(key, ts, tie_break), key, ts, frame_s, tie_break, ties)
    return counted.groupBy(key).agg(F.max("n_window").alias("peak"), F.avg("n_window").alias("mean_count"), F.count(F.lit(1)).alias("n_rows"))


def first_over(df: DataFrame, key: str, ts: str, value: str, least: float, tie_break: str) -> DataFrame:
    """Per key the first row in time whose value reaches ``least``; found by an aggregate, without sorting a key's rows."""
    order = F.struct(F.col(ts).alias("ts"), F.col(tie_break).alias("id"), F.col(value).alias("value"))
    return df.filter(F.col(value) >= least).groupBy(key).agg(F.min(order).alias("f")).select(key, F.col("f.ts").alias("ts"), F.col("f.id").alias(tie_break), F.col("f.value").alias(value))


def runs(df: DataFrame, key: str, at: str, tie: str, gap: int, name: str) -> DataFrame:
    """``df`` with ``name``: the first ``at`` (a whole number) of the row's run, rows of a key not more than ``gap`` apart.

    Starts are looked up inside (key, block) and carried over from earlier blocks, whose number follows from the time covered.
    Rows with a null key or ``at`` are left out.
    """
    width = gap * BLOCK
    of = lambda c: F.floor(c / F.lit(width)).cast("long")
    known = df.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    blocked = known.withColumn("_own", of(F.col(at))).withColumn("_block", F.explode(F.array_distinct(F.array(of(F.col(at)), of(F.col(at) + F.lit(gap))))))
    order = W.partitionBy(key, "_block").orderBy(at, tie)
    before = F.lag(at).over(order)
    marked = blocked.withColumn("_start", F.when(before.isNull() | (F.col(at) - before > gap), F.col(at))).filter("_own = _block")
    within = cut(marked.withColumn("_inside", F.last("_start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_start", "_own"))
    last = within.groupBy(key, "_block").agg(F.max("_inside").alias("_last"))
    carried = last.select(key, "_block", F.last("_last", ignorenulls=True).over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    return within.join(carried, [key, "_block"]).withColumn(name, F.coalesce("_inside", "_carried")).drop("_block", "_inside", "_carried")
