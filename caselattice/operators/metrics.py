"""Quality measures as aggregates: set overlap, ranking quality, percentiles and checks against limits.

Defined results: null labels count as absent; an empty prediction or truth gives precision or recall 0; the AUC counts ties
half and is null when a class is missing; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import running_sum
from .skew import join_one


def prf(found: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Precision, recall and F1 of found keys against true keys, per value of ``by``."""
    f = found.select(by, *keys).distinct().withColumn("_found", F.lit(1))
    t = truth.select(by, *keys).distinct().withColumn("_true", F.lit(1))
    both = f.join(t, [by, *keys], "full")
    counted = both.groupBy(by).agg(F.count_if(F.expr("_found = 1 AND _true = 1")).alias("tp"), F.count_if(F.expr("_found = 1 AND _true IS NULL")).alias("fp"), F.count_if(F.expr("_found IS NULL AND _true = 1")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, from counts per distinct score; no pairs are made and no task sees all scores."""
    per = scored.select(F.col(score).alias("s"), F.col(positive).cast("boolean").alias("p")).dropna().groupBy("s").agg(F.count_if(F.expr("p")).alias("pos"), F.count_if(F.expr("NOT p")).alias("neg"))
    won = running_sum(per, [F.asc("s")], "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return won.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.round(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def precision_at(scored: DataFrame, group: str, score: str, hit: str, tie: str, k: int) -> DataFrame:
    """Per group the share of hits among its ``k`` best rows."""
    order = W.partitionBy(group).orderBy(F.desc(score), tie)
    top = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.groupBy(group).agg(F.round(F.avg(F.col(hit).cast("int")), 6).alias("precision"), F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median and 95th percentile (interpolated), least and most per group.

    Null values and groups are left out. Places come from running sums over the distinct values of all groups, so no aggregate holds a group's values.
    """
    per = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = running_sum(per, [F.asc("g"), F.asc("v")], "c", "through")
    size = placed.groupBy("g").agg(F.sum("c").alias("n"), F.min("through").alias("base"), F.min("v").alias("least"), F.max("v").alias("most"))
    here = join_one(placed, size, "g").withColumn("from", F.col("through") - F.col("base"))
    at = lambda place: F.max(F.when((F.col("from") <= place) & (place < F.col("from") + F.col("c")), F.col("v")))
    found = {}
    for name, p in (("median", 0.5), ("p95", 0.95)):
        place = p * (F.col("n") - 1)
        found |= {f"{name}_low": at(F.floor(place)), f"{name}_high": at(F.ceil(place))}
    agg = here.groupBy("g").agg(F.first("n").alias("n"), *(c.alias(k) for k, c in found.items()), F.first("least").alias("least"), F.first("most").alias("most"))
    mid = lambda name, p: F.round(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))), 6).alias(name)
    return agg.select(F.col("g").alias(group), "n", mid("median", 0.5), mid("p95", 0.95), "least", "most")


def hit_rate(found: DataFrame, expected: DataFrame, group: str, item: str, place: str, k: int) -> DataFrame:
    """One row: groups with expected items, groups of which any is among the first ``k`` found, and their share."""
    top = found.filter(F.col(place) <= k).select(group, item).distinct()
    wanted = expected.select(group, item).dropna().distinct()
    per = wanted.join(top.withColumn("_hit", F.lit(1)), [group, item], "left").groupBy(group).agg(F.max(F.coalesce("_hit", F.lit(0))).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hits"), F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), 4).alias("coverage"))


def macro_mean(per_case: DataFrame, values: list[str], error: str = "error") -> DataFrame:
    """One row: cases, valid cases (those without an error) and the mean of each value over the valid ones."""
    valid = F.col(error).isNull()
    return per_case.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(valid).alias("n_valid"), *(F.round(F.coalesce(F.avg(F.when(valid, F.col(v))), F.lit(0.0)), 4).alias(f"mean_{v}") for v in values))


def worst_quality(rows: DataFrame, group: str, flag: str, bad: str = "low") -> DataFrame:
    """``group, quality``: ``bad`` when any row of the group is, else ``ok``."""
    return rows.groupBy(group).agg(F.coalesce(F.bool_or(F.col(flag) == bad), F.lit(False)).alias("_bad")).select(group, F.when(F.col("_bad"), F.lit(bad)).otherwise(F.lit("ok")).alias("quality"))


def acceptance(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``metric, value, op, threshold, passed`` of measures ``(metric, value)`` against limits ``(metric, op, threshold)``."""
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    return limits.join(measured, "metric", "left").select("metric", "value", "op", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with the number of rows and an order-free digest of all rows, to compare two outputs."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)") for i in (1, 13, 25)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(p).cast("string").alias(f"digest_{i}") for i, p in enumerate(parts)))


def same_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two outputs hold the same rows."""
    x, y = fingerprint(a), fingerprint(b)
    equal = [F.coalesce(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(False)) for c in x.columns]
    same = equal[0]
    for e in equal[1:]:
        same = same & e
    return x.alias("x").crossJoin(y.alias("y")).select(F.col("x.n_rows").alias("n_rows"), same.alias("same"))  # one row beside one row
