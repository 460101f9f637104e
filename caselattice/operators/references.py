"""References to records that do not exist, were deleted or were loaded only afterwards.

Parents and children are brought into one long form ``(space, key, ...)`` and grouped by key; the group keeps a parent
flag, the earliest load and deletion and the range of the children's timestamps. Map-side combining collapses a hot key
before the shuffle. Only groups that can fail (no parent flag, a deletion not after the last child, a first load after
the first child) are kept, and the children are joined back to those groups alone.

Defined results: a null, empty or blank key is no reference; keys are compared trimmed and without case; with a null
timestamp only ``missing`` can be judged and the period is ``unknown``; repeated rows count once (equal output rows
collapse); an empty parent table makes every reference ``missing``; empty child tables give no rows. Only the columns
named in the specs are read, so extra or clashing columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: White space that may surround a typed key.
PADDING = " \t\n\r\u00a0\u3000\ufeff\u200b"
#: A key is hot when more than this share of all children refer to it; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001
#: Pieces a hot key's rows are dealt into for the join.
HOT_PIECES = 64


@dataclass(frozen=True)
class Parent:
    """A table whose ``key`` column can be referred to; several parents may share one key space."""

    space: str
    rows: DataFrame
    key: str
    loaded_at: str | None = None
    deleted_at: str | None = None


@dataclass(frozen=True)
class Child:
    """A reference column ``field`` of the table called ``name``, rows identified by ``row_id``."""

    name: str
    space: str
    rows: DataFrame
    field: str
    row_id: str
    timestamp: str


def key_form(column):
    """Trimmed, lower-case form of a key; null when nothing is left."""
    trimmed = F.lower(F.btrim(column, F.lit(PADDING)))
    return F.when(trimmed != "", trimmed)


def orphan_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """One row per failing reference: ``ref_table, ref_field, ref_id, status, period``."""
    at = "timestamp_ntz"
    up = [
        p.rows.select(
            F.lit(p.space).alias("space"),
            key_form(F.col(p.key)).alias("key"),
            F.lit(1).alias("is_parent"),
            (F.col(p.loaded_at).cast(at) if p.loaded_at else F.lit(None).cast(at)).alias("loaded"),
            (F.col(p.deleted_at).cast(at) if p.deleted_at else F.lit(None).cast(at)).alias("deleted"),
            F.lit(None).cast(at).alias("at"),
        )
        for p in parents
    ]
    down = [
        c.rows.select(
            F.lit(c.name).alias("ref_table"),
            F.lit(c.field).alias("ref_field"),
            F.col(c.row_id).cast("long").alias("ref_id"),
            F.lit(c.space).alias("space"),
            key_form(F.col(c.field)).alias("key"),
            F.col(c.timestamp).cast(at).alias("at"),
        ).filter(F.col("key").isNotNull())
        for c in children
    ]
    refs = reduce(DataFrame.unionByName, down)
    tagged = reduce(
        DataFrame.unionByName,
        [p.filter(F.col("key").isNotNull()) for p in up]
        + [refs.select("space", "key", F.lit(0).alias("is_parent"), F.lit(None).cast(at).alias("loaded"), F.lit(None).cast(at).alias("deleted"), "at")],
    )
    groups = tagged.groupBy("space", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("loaded").alias("loaded"),
        F.min("deleted").alias("deleted"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.count_if(F.col("is_parent") == 0).alias("n_refs"),
    )
    fails = (
        (F.col("has_parent") == 0) | (F.col("deleted") <= F.col("last_at")) | (F.col("loaded") > F.col("first_at"))
    )
    total = refs.agg(F.count(F.lit(1)).alias("n_all"))
    kept = cut(
        groups.filter("n_refs > 0")
        .crossJoin(F.broadcast(total))  # one row
        .select("space", "key", "has_parent", "loaded", "deleted", F.coalesce(fails, F.lit(False)).alias("fails"), (F.col("n_refs") > F.col("n_all") * HOT_SHARE).alias("hot"))
        .filter("fails OR hot")
    )
    failing = kept.filter("fails").drop("hot", "fails")
    # at most 1 / HOT_SHARE keys pass this filter, whatever the size of the tables
    hot = kept.filter("hot").select("space", "key", F.lit(HOT_PIECES).alias("pieces"))
    spread = lambda df: df.join(F.broadcast(hot), ["space", "key"], "left")
    left = spread(refs).withColumn(
        "piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("ref_id", "ref_table"), F.lit(HOT_PIECES))).otherwise(F.lit(0))
    )
    right = spread(failing).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("pieces") - 1, F.lit(0)).cast("long")))
    )
    status = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(F.col("deleted") <= F.col("at"), "deleted")
        .when(F.col("loaded") > F.col("at"), "late")
    )
    return (
        left.drop("pieces")
        .join(right.select("space", "key", "piece", "has_parent", "loaded", "deleted"), ["space", "key", "piece"])
        .select(
            "ref_table", "ref_field", "ref_id", status.alias("status"),
            F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
        )
        .filter(F.col("status").isNotNull())
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of failing references per table, field, status and month."""
    return found.groupBy("ref_table", "ref_field", "status", "period").agg(F.count(F.lit(1)).alias("n_refs"))
