"""Pairing records with the nearest record in time of the same subject.

The right side's timestamps become nearest-neighbour intervals: each call owns the instants nearer to it than to its
neighbours, bounded by the midpoints to them and by the tolerance. The intervals of a subject do not overlap, so a left
timestamp meets at most one. The range join runs over an interval index partitioned by (subject, time cell): a call is
entered in every cell its tolerance reaches, so all calls that can own an instant of a cell are in that cell and the
neighbours can be taken inside it. A hot subject is thereby split over its cells; no partition holds a whole subject.
The window and the join share one partitioning: each side is shuffled once.

Defined results: ties in distance go to the earlier right row, equal timestamps to the smallest right id; rows with a null
subject, null id or null timestamp pair with nothing; repeated rows count once; one right row may serve several left
rows; an empty side gives no rows. Extra columns are dropped before the join, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rolling import micros

#: Width of a time cell, as a multiple of the tolerance: a call lies in at most 1 + 2 / CELLS cells on average.
CELLS = 8


def nearest_in_time(
    left: DataFrame, right: DataFrame, tolerance_s: int, left_id: str, right_id: str, subject: str = "subject", at: str = "at"
) -> DataFrame:
    """``(left_id, right_id, gap_us)`` of each left row that has a right row of its subject within the tolerance."""
    reach = tolerance_s * 1_000_000
    width = reach * CELLS
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    keyed = lambda df, key: df.select(F.col(subject).alias("s"), F.col(key).alias(key), micros(F.col(at)).alias("t")).dropna()

    calls = (
        keyed(right, right_id)
        .withColumn("cell", F.explode(F.sequence(cell(F.col("t") - reach), cell(F.col("t") + reach))))
        .repartition("s", "cell")
        .groupBy("s", "cell", "t").agg(F.min(right_id).alias(right_id))
    )
    order = W.partitionBy("s", "cell").orderBy("t")
    owned = calls.withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)}).select(
        "s", "cell", F.col("t").alias("rt"), right_id,
        # twice the bounds, so that midpoints stay whole: low < 2 t <= high
        F.greatest(2 * (F.col("t") - reach) - 1, F.col("t") + F.coalesce("before", F.col("t") - 4 * reach)).alias("low"),
        F.least(2 * (F.col("t") + reach), F.col("t") + F.coalesce("after", F.col("t") + 4 * reach)).alias("high"),
    )
    asked = keyed(left, left_id).withColumn("cell", cell(F.col("t"))).withColumnRenamed("t", "lt")
    met = asked.join(owned, ["s", "cell"]).filter((2 * F.col("lt") > F.col("low")) & (2 * F.col("lt") <= F.col("high")))
    # copies of a left row, and left rows of several subjects, keep the nearest of all
    best = F.min(F.struct(F.abs(F.col("lt") - F.col("rt")).alias("gap"), F.col("rt"), F.col(right_id))).alias("best")
    return met.groupBy(left_id).agg(best).select(left_id, F.col(f"best.{right_id}").alias(right_id), F.col("best.gap").alias("gap_us"))
