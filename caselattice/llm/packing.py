"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths, not over the items: best-fit decreasing runs on counts, taking the longest
length first and placing all its items at once into the groups of equally filled containers with the least room that
still fits, then into new containers. A plan line says: the items of length L ranked from ``rank_from`` up to
``rank_to`` go, ``per`` to a container, into the containers from ``container`` on, starting at ``position``. Items then
take their slots by joining on (length, rank within length).

The histogram and the plan are bounded by the capacity, not by the data: at most ``capacity`` lengths, and a line is
added only when a length or a group of containers is used up. Ranks are made without a window over a whole length: items
are dealt into pieces by a hash of their key, numbered inside a piece, and shifted by the counts of the pieces before.

Defined results: an item longer than the capacity is split into full containers and a rest that is packed like an item;
no other item is split; an item of size zero (null or empty text) needs no room and comes out with a null container; a
null key is kept as any other; repeated rows are items of their own; an empty table gives no rows; ties between items of
one length are broken by the key.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS

#: Items of one length that are numbered in one piece, about, and the least number of pieces.
PIECE_ROWS, LEAST_PIECES = 500_000, 16
PLAN = "length long, rank_from long, rank_to long, per long, container long, position long"


def best_fit_plan(histogram: dict[int, int], capacity: int, first: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """Plan lines (see ``PLAN``) for ``{length: count}``, lengths from 1 to ``capacity``; containers are numbered from ``first``."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first container, how many)
    rooms: list[int] = []  # the rooms that have runs, ascending
    lines = []
    opened = first

    def put(left: int, start: int, count: int) -> None:
        if left and count:
            if not room[left]:
                insort(rooms, left)
            room[left].append((start, count))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                start, count = room[left].pop()
                if not room[left]:
                    rooms.pop(i)
            else:
                left, start, count = capacity, opened, -(-todo // (capacity // length))
                opened += count
            per = left // length
            full = min(count, todo // per)
            if full:
                lines.append((length, rank, rank + full * per, per, start, capacity - left))
                put(left - per * length, start, full)
                rank, todo = rank + full * per, todo - full * per
            if full < count and todo:  # fewer than ``per`` are left
                lines.append((length, rank, rank + todo, todo, start + full, capacity - left))
                put(left - todo * length, start + full, 1)
                full, todo = full + 1, 0
            put(left, start + full, count - full)
    return lines


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(key, part_no, start, n, container, position)`` of every item: the part's place in the item and in its container."""
    asked = items.select(F.lit(0).alias("spec_id"), F.lit(capacity).alias("capacity"), F.col(key).alias(key), F.col(size).alias("size"))
    return pack_specs(asked, key, "size", {0: capacity}).drop("spec_id")


def pack_specs(items: DataFrame, key: str, size: str, capacities: dict[int, int]) -> DataFrame:
    """``(spec_id, key, part_no, start, n, container, position)``: the items of every spec packed, all specs in one pass.

    ``items`` has a row per spec and item, with ``spec_id, capacity``; it is read several times, so pass a stored table when its
    sizes are expensive to compute.
    """
    spark = items.sparkSession
    cut = items.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("long").alias("capacity"), F.col(key).alias(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    longer = cut.filter("size > capacity").withColumn("parts", F.floor(F.col("size") / F.col("capacity")).cast("long"))
    rest = cut.withColumn("rest", F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size"))).filter("rest > 0 OR size = 0")
    # at most ``capacity`` lengths of a spec come to the driver
    counts: dict[int, dict[int, int]] = {spec: {} for spec in capacities}
    for r in rest.filter("rest > 0").groupBy("spec_id", "rest").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["spec_id"]][r["rest"]] = r["n"]
    plan, opened = [], {}
    for spec, capacity in capacities.items():
        lines = best_fit_plan(counts[spec], capacity)
        opened[spec] = max((c + -(-(b - a) // per) for _, a, b, per, c, _ in lines), default=0)
        plan += [(spec, *line) for line in lines]
    lines = spark.createDataFrame(plan, f"spec_id int, {PLAN}")
    if len(plan) <= BROADCAST_ROWS:  # bounded by the capacities; very large ones are joined by length
        lines = F.broadcast(lines)

    pieces = max(LEAST_PIECES, max((n for c in counts.values() for n in c.values()), default=0) // PIECE_ROWS)
    dealt = rest.filter("rest > 0").withColumn("piece", F.pmod(F.xxhash64(key), F.lit(pieces)))
    before = dealt.groupBy("spec_id", "rest", "piece").agg(F.count(F.lit(1)).alias("n")).select(
        "spec_id", "rest", "piece", (F.sum("n").over(W.partitionBy("spec_id", "rest").orderBy("piece")) - F.col("n")).alias("before")
    )  # at most ``pieces`` rows of a length
    ranked = (
        dealt.withColumn("place", F.row_number().over(W.partitionBy("spec_id", "rest", "piece").orderBy(key)))
        .join(before, ["spec_id", "rest", "piece"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
    )
    placed = ranked.join(
        lines.withColumnRenamed("spec_id", "_spec"), (F.col("spec_id") == F.col("_spec")) & (F.col("rest") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    ).select(
        "spec_id", key,
        F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("long").alias("part_no"),
        (F.col("size") - F.col("rest")).alias("start"),
        F.col("rest").alias("n"),
        (F.col("container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per"))).cast("long").alias("container"),
        (F.col("position") + (F.col("rank") - F.col("rank_from")) % F.col("per") * F.col("rest")).cast("long").alias("position"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = rest.filter("size = 0").select("spec_id", key, zero.alias("part_no"), zero.alias("start"), zero.alias("n"), none.alias("container"), none.alias("position"))
    return placed.unionByName(empty).unionByName(_full_parts(longer, key, opened, pieces))


def _full_parts(longer: DataFrame, key: str, opened: dict[int, int], pieces: int) -> DataFrame:
    """The full containers of items longer than the capacity, numbered on from those the plan has opened."""
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in opened.items() for x in pair)), F.col("spec_id").cast("long"))
    dealt = longer.withColumn("piece", F.pmod(F.xxhash64(key), F.lit(pieces)))
    before = dealt.groupBy("spec_id", "piece").agg(F.sum("parts").alias("n")).select(
        "spec_id", "piece", (F.sum("n").over(W.partitionBy("spec_id").orderBy("piece")) - F.col("n")).alias("before")
    )  # at most ``pieces`` rows of a spec
    order = W.partitionBy("spec_id", "piece").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        dealt.withColumn("through", F.sum("parts").over(order))
        .join(before, ["spec_id", "piece"])
        .withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(
            "spec_id", key, "part_no", (F.col("part_no") * F.col("capacity")).alias("start"), F.col("capacity").alias("n"),
            (start + F.col("before") + F.col("through") - F.col("parts") + F.col("part_no")).cast("long").alias("container"),
            F.lit(0).cast("long").alias("position"),
        )
    )
