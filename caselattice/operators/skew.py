"""Joins with a table of one row per key where some key may hold a large share of all rows.

A key is hot when it holds more than ``1 / HOT`` of the rows, so there are at most ``HOT`` hot keys: their rows of the other
side are broadcast, a size that follows from the share and not from the data. The rest is joined by (key, slot), where rows of hot
keys are dealt over slots nobody answers, so no task receives a hot key.

Defined results: a left join; null keys match nothing and keep their rows; an empty side gives nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are hot; also the largest number of hot keys.
HOT, SLOTS = 500, 4_096


def join_counted(rows: DataFrame, known: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``known`` (one row per ``key``, its number of rows in ``n``); ``total`` counts ``rows``."""
    values = [c for c in known.columns if c not in (key, n)]
    most = max(1, total // HOT)
    hot = known.filter(F.col(n) > most).select(F.col(key).alias("_hot"), F.struct(*values).alias("_h"))
    dealt = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left").withColumn(
        "_slot", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(SLOTS)).cast("int"))
    )
    rest = known.filter(F.col(n) <= most).select(F.col(key), F.lit(-1).alias("_slot"), F.struct(*values).alias("_r"))
    met = dealt.join(rest, [key, "_slot"], "left").withColumn("_v", F.coalesce("_h", "_r"))
    return met.select(*rows.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def join_one(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``known``, which has one row per ``key``; hot keys are found by a count that combines first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return join_counted(rows, known.join(counts, key), key, rows.count(), "_n")
