"""Entity buckets, similarity, resolution by blocked links, cross-type clean-up, confidence and incremental merges.

Resolution links forms of one type and scope that reach a similarity threshold and takes connected components, so the
result does not depend on the order of rows. Candidates come from blocks of (scope, type, first letter of a token, last
letters of the longest token); exact types are grouped by value. The name of a group is its most frequent, then longest, then
first form.

Defined results: null or empty texts are left out; repeated mentions raise counts only; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import stable_id
from .components import connected_components

# Least similarity per type, weights of extraction methods, precedence of types.
THRESHOLDS = {"PERSON": 80, "ORGANIZATION": 80, "LOCATION": 85, "DATE": 70, "CASE": 95}
EXACT = ("PHONE", "VEHICLE", "ACCOUNT")
METHODS = {"regex": 1.00, "spacy": 0.85, "indicbert": 0.80}
DEFAULT_METHOD, REVIEW_BELOW = 0.75, 0.45
PRECEDENCE = {"PERSON": 5, "ORGANIZATION": 4, "LOCATION": 3}


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (lengths): 100 for equal texts, 0 beside an empty one."""
    return 100 * 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one of its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def _pairwise(function):
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return apply


def similarity(a: Column, b: Column, kind: str = "token_sort") -> Column:
    """Similarity of two text columns from 0 to 100, null beside a null: ``plain``, ``token_sort`` or ``partial``."""
    return _pairwise({"plain": ratio, "token_sort": token_sort_ratio, "partial": partial_ratio}[kind])(a, b)


def buckets(mentions: DataFrame) -> DataFrame:
    """``type, text, n_mentions, docs, methods, confidence``: mentions of one text and type together."""
    return mentions.filter("text IS NOT NULL AND text <> ''").groupBy("type", "text").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.array_sort(F.collect_set("doc")).alias("docs"), F.array_sort(F.collect_set("method")).alias("methods"), F.max("confidence").alias("confidence")
    )


def _keys(text: Column) -> Column:
    """Blocking keys of a text: each token's first letter with the last three letters of every other token."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    tails = F.transform(words, lambda w: F.right(w, F.lit(3)))
    one = F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("|"), F.right(w, F.lit(3))))
    pairs = F.flatten(F.transform(words, lambda w: F.transform(tails, lambda t: F.concat(F.substring(w, 1, 1), F.lit("|"), t))))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(one))


def resolve(forms: DataFrame, scope: str | None = None) -> DataFrame:
    """``type, scope, text, entity``: the forms with the id of their entity.

    ``forms`` has ``type, text`` and a count ``n_mentions``; with ``scope`` only forms of one scope are linked.
    """
    place = F.col(scope) if scope else F.lit("")
    given = forms.select("type", place.alias("scope"), "text", "n_mentions").filter("text <> ''")
    keyed = given.withColumn("id", F.concat_ws("|", "scope", "type", "text"))
    fuzzy = keyed.filter(F.col("type").isin(*THRESHOLDS)).withColumn("key", F.explode(_keys(F.col("text"))))
    a = fuzzy.select("type", "scope", "key", F.col("id").alias("src"), F.col("text").alias("ta"))
    b = fuzzy.select("type", "scope", "key", F.col("id").alias("dst"), F.col("text").alias("tb"))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in THRESHOLDS.items() for x in kv)), F.col("type"))
    near = a.join(b, ["type", "scope", "key"]).filter((F.col("src") < F.col("dst")) & (2 * F.least(F.length("ta"), F.length("tb")) * 100 >= limit * (F.length("ta") + F.length("tb"))))
    linked = near.select("type", "src", "dst", "ta", "tb").distinct().filter(similarity(F.lower("ta"), F.lower("tb")) >= limit)
    groups = connected_components(linked.select("src", "dst"))
    joined = keyed.join(groups, keyed["id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "id"))
    best = joined.groupBy("group", "type", "scope").agg(F.max_by("text", F.struct(F.col("n_mentions"), F.length("text"), F.col("text"))).alias("name"))
    named = best.withColumn("entity", stable_id(F.col("type"), F.concat_ws("|", "scope", "name"))).select("group", "name", "entity")
    return joined.join(named, "group").select("type", "scope", "text", "n_mentions", "name", "entity")


def confidence(rows: DataFrame) -> DataFrame:
    """Confidence of entities from ``base``, ``methods`` and the numbers of documents and aliases; review below 0.45."""
    weights = F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv))
    best = F.coalesce(F.array_max(F.transform("methods", lambda m: F.coalesce(F.element_at(weights, m), F.lit(DEFAULT_METHOD)))), F.lit(DEFAULT_METHOD))
    value = best * F.col("base") + F.least(0.02 * F.greatest(F.col("n_docs") - 1, F.lit(0)), F.lit(0.10)) + F.least(0.01 * F.greatest(F.col("n_aliases") - 1, F.lit(0)), F.lit(0.05))
    scored = rows.withColumn("confidence", F.round(F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 9), 4))
    return scored.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


def across_types(rows: DataFrame, scope: str, least: int = 92) -> DataFrame:
    """``scope, kept, kept_type, dropped, dropped_type, score``: entities of one scope and two types whose names, words sorted and in
    lower case, are alike to ``least`` or more; the type of higher precedence (persons, organisations, places) is kept.

    Names meet in the blocks of ``resolve``; an entity is dropped once, for its best match.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv)), F.col("type"))
    named = rows.filter(F.col("type").isin(*PRECEDENCE) & F.col("name").isNotNull() & F.col(scope).isNotNull()).select(scope, "type", "entity_id", "name", rank.alias("rank")).distinct()
    keyed = named.withColumn("key", F.explode(_keys(F.col("name"))))
    side = lambda n: keyed.select(scope, "key", *(F.col(c).alias(f"{c}_{n}") for c in ("type", "entity_id", "name", "rank")))
    met = side("a").join(side("b"), [scope, "key"]).filter("rank_a > rank_b AND entity_id_a <> entity_id_b").drop("key").distinct()
    scored = met.withColumn("score", F.round(similarity(F.lower("name_a"), F.lower("name_b")), 4)).filter(F.col("score") >= least)
    best = F.max_by(F.struct("entity_id_a", "type_a", "score"), F.struct("score", "rank_a", "entity_id_a")).alias("m")
    return scored.groupBy(scope, F.col("entity_id_b").alias("dropped"), F.col("type_b").alias("dropped_type")).agg(best).select(
        scope, F.col("m.entity_id_a").alias("kept"), F.col("m.type_a").alias("kept_type"), "dropped", "dropped_type", "m.score"
    )


def merge_incrementally(known: DataFrame, new: DataFrame, key: str, arrays: list[str], values: list[str]) -> DataFrame:
    """Known and new rows by key: known values win where they are there, arrays are united and sorted."""
    a = known.groupBy(key).agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(f"a_{c}") for c in arrays), *(F.min(c).alias(f"a_{c}") for c in values))
    b = new.groupBy(key).agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(f"b_{c}") for c in arrays), *(F.min(c).alias(f"b_{c}") for c in values))
    united = [F.array_sort(F.array_union(F.coalesce(f"a_{c}", F.array().cast("array<string>")), F.coalesce(f"b_{c}", F.array().cast("array<string>")))).alias(c) for c in arrays]
    return a.join(b, key, "full").select(key, *united, *(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in values))


def search_names(entities: DataFrame, query: str, least: float) -> DataFrame:
    """Entities by the best partial similarity of a name or alias with the query: ``entity_id, matched, score``."""
    names = entities.select("entity_id", F.explode(F.array_compact(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("matched")).filter("matched <> ''")
    scored = names.withColumn("score", F.round(similarity(F.lower("matched"), F.lit(query.lower()), "partial") / 100, 4)).filter(F.col("score") >= least)
    order = W.partitionBy("entity_id").orderBy(F.desc("score"), "matched")
    return scored.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
