"""Views over graph, texts and rankings: bundles, mentions, graph views, samples, votes.

Defined results: null ends, names and texts are left out; repeated rows count once where rows are distinct facts; ties are
ordered by ids; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import broadcast_if_small, cut
from .graph import HUB, held_out, neighbourhood_overlap, simple_pairs
from .metrics import auc
from .ranks import with_rank
from .skew import join_one

#: First words by which a name is looked for in texts.
HEAD_WORDS = 5


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Texts in composed Unicode form."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def words_of(column: Column) -> Column:
    """Lower-case words of a text: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def name_mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name_id: str, name: str, head: int = HEAD_WORDS) -> DataFrame:
    """``key, name_id``: names whose words occur next to each other in a text, names of any length.

    Both sides are cut to word sequences. A name meets a text at its first words (at most ``head``), by an equi-join on their hash;
    the words after them are compared in the hit. Of a text only the sequences whose first word begins some name are
    spread, when the first words are few enough to be held.
    """
    wanted = cut(
        names.select(name_id, words_of(F.col(name)).alias("w")).filter(F.size("w") > 0)
        .select(name_id, F.array_join("w", " ").alias("phrase"), F.least(F.size("w"), F.lit(head)).alias("n"), F.array_join(F.slice("w", 1, head), " ").alias("start"), F.col("w")[0].alias("first")).distinct()
    )
    placed = texts.select(key, words_of(F.col(text)).alias("w")).filter(F.size("w") > 0).withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    words = placed.select(key, "t", "w", F.posexplode("w").alias("pos", "first")).join(broadcast_if_small(wanted.select("first", "n").groupBy("first").agg(F.collect_set("n").alias("ns"))), "first")
    starts = words.select(key, "t", F.explode(F.transform("ns", lambda n: F.array_join(F.slice("w", F.col("pos") + 1, n), " "))).alias("start")).distinct()
    met = starts.join(wanted.select(name_id, "phrase", "start"), "start").filter(F.contains("t", F.concat(F.lit(" "), "phrase", F.lit(" "))))
    return met.select(key, name_id).distinct()


def flow_totals(transfers: DataFrame) -> DataFrame:
    """Transfers, total and largest amount per sender and receiver."""
    return transfers.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.max("amount").alias("largest")
    )


def presence_scores(flows: DataFrame, asked: DataFrame, unit: float = 50_000.0) -> DataFrame:
    """``a, b, score`` of account pairs: half the Jaccard of their counterparties, 0.3 of the money both ways on a log scale, and 0.2
    when both accounts have any counterparty. ``flows`` is ``src, dst, total``; loops are left out.
    """
    real = flows.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    near = neighbourhood_overlap(asked, simple_pairs(real))
    money = real.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "total").groupBy("x", "y").agg(F.sum("total").alias("total"))
    joined = near.join(money, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left")
    jaccard = F.coalesce(F.try_divide(F.col("cn"), F.col("ka") + F.col("kb") - F.col("cn")), F.lit(0.0))
    there = ((F.col("ka") > 0) & (F.col("kb") > 0)).cast("int")
    score = 0.5 * jaccard + 0.3 * F.log1p(F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / unit) + 0.2 * there
    return joined.select("a", "b", F.round(score, 6).alias("score"))


def _drawn(column: Column) -> Column:
    """A whole number drawn from a text by its MD5: the same in every process and engine."""
    return F.conv(F.substring(F.md5(column), 1, 12), 16, 10).cast("long")


def negative_samples(pairs: DataFrame, nodes: DataFrame, per_pair: int) -> DataFrame:
    """``a, b``: pairs of different nodes without an edge, ``per_pair`` draws for every edge; draws that hit an edge or repeat are dropped.

    Both ends are drawn from all nodes by position, so every pair can come up and no square over nodes is made.
    """
    placed = cut(with_rank(nodes.select(F.col(nodes.columns[0]).alias("node")).dropna().distinct(), [F.asc("node")], "place"))
    n = placed.count()
    if n < 2:
        return pairs.limit(0).select("a", "b")
    seeds = with_rank(pairs, [F.asc("a"), F.asc("b")], "seed").select("seed", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))).alias("k"))
    end = lambda side: F.pmod(_drawn(F.concat_ws("|", F.col("seed"), F.col("k"), F.lit(side))), F.lit(n))
    drawn = seeds.select(end("a").alias("x"), end("b").alias("y")).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    named = drawn.join(placed.select(F.col("place").alias("x"), F.col("node").alias("a")), "x").join(placed.select(F.col("place").alias("y"), F.col("node").alias("b")), "y")
    return named.select("a", "b").join(pairs, ["a", "b"], "left_anti")


def held_out_auc(flows: DataFrame, share: float = 0.4, negatives: int = 8) -> DataFrame:
    """One row: how well the score on the edges kept tells held-out edges from pairs without an edge."""
    edges = cut(flows.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "total"))
    split = cut(held_out(edges, share))
    held = split.filter("held").select("a", "b")
    nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a")))
    observed = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    none = negative_samples(cut(held), nodes, negatives).join(observed, ["a", "b"], "left_anti")
    asked = cut(held.withColumn("hit", F.lit(True)).unionByName(none.withColumn("hit", F.lit(False))))
    kept = cut(split.filter("NOT held").select(F.col("a").alias("src"), F.col("b").alias("dst"), "total"))
    scored = asked.join(presence_scores(kept, asked), ["a", "b"])
    return auc(scored, "score", "hit")


def strong_or_weak(edges: DataFrame, least: float) -> DataFrame:
    """The strong edges of each record, or all of a record that has no strong one."""
    strong = F.coalesce(F.col("weight") >= least, F.lit(False))
    has = edges.groupBy("source_record").agg(F.max(strong.cast("int")).alias("has_strong"))
    return edges.join(has, edges["source_record"].eqNullSafe(has["source_record"])).filter(strong | (F.col("has_strong") == 0)).drop(has["source_record"]).drop("has_strong")


def active_case(edges: DataFrame, members: DataFrame, largest: int = HUB) -> DataFrame:
    """``case_id, a, b, kind``: recorded links of a case and an APPEARS_IN_CASE link for every other pair of its members.

    The pairs of a case with more than ``largest`` members are not listed; its members come as class rows (kind ``MEMBER``, ``a``
    the case), which say that every two of them without a recorded link have that link.
    """
    recorded = edges.filter("src <> dst").select(F.col("source_record").alias("case_id"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("relationship").alias("kind"))
    inside = recorded.join(members.select("case_id", F.col("entity_id").alias("a")), ["case_id", "a"], "left_semi").join(members.select("case_id", F.col("entity_id").alias("b")), ["case_id", "b"], "left_semi")
    sizes = members.groupBy("case_id").agg(F.count(F.lit(1)).alias("size"))
    sized = join_one(cut(members.filter("case_id IS NOT NULL")), sizes, "case_id")
    small = sized.filter(F.col("size") <= largest)
    x, y = small.select("case_id", F.col("entity_id").alias("a")), small.select("case_id", F.col("entity_id").alias("b"))
    others = x.join(y, "case_id").filter("a < b").join(inside.select("case_id", "a", "b"), ["case_id", "a", "b"], "left_anti").select("case_id", "a", "b", F.lit("APPEARS_IN_CASE").alias("kind"))
    classes = sized.filter(F.col("size") > largest).select("case_id", F.col("case_id").alias("a"), F.col("entity_id").alias("b"), F.lit("MEMBER").alias("kind"))
    return inside.distinct().unionByName(others).unionByName(classes)


def evidence_bundle(flags: DataFrame, neighbours: DataFrame, per_entity: int = 5) -> DataFrame:
    """Per flagged entity its flags and its strongest neighbours in order, as text."""
    best = neighbours.filter(F.col("place") <= per_entity).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]), ",").alias("neighbours"))
    return flags.join(best, flags["key"] == best["node"], "left").select("key", "flags", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def summary_confidence(rows: DataFrame, text: str, relevance: str, flag: str, banned: list[str]) -> DataFrame:
    """0.4 of the relevance and 0.4 of the flag score, less 0.2 per banned word (at most 0.4), between 0 and 1."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.size(F.filter(F.array(*(F.lit(w) for w in banned)), lambda w: F.contains(low, w)))
    value = 0.4 * F.coalesce(F.col(relevance), F.lit(0.0)) + 0.4 * F.coalesce(F.col(flag), F.lit(0.0)) - F.least(0.2 * hits, F.lit(0.4))
    return rows.withColumn("confidence", F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4))


def rank_vote(rows: DataFrame, group: str, labels: str, k: int) -> DataFrame:
    """The ``k`` labels of a group by the sum of ``size - position`` over its ranked lists."""
    votes = rows.select(group, F.size(labels).alias("size"), F.posexplode(labels).alias("pos", "label")).groupBy(group, "label").agg(F.sum(F.col("size") - F.col("pos")).alias("votes"))
    order = W.partitionBy(group).orderBy(F.desc("votes"), "label")
    return votes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hashed_tfidf(index: DataFrame, key: str, size: int = 384) -> DataFrame:
    """``key, pos, value``: TF-IDF of hashed terms with length one, in long form; the hash is the same in every process."""
    total = index.select(key).distinct().agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = index.join(df, "token").crossJoin(F.broadcast(total)).select(key, F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("long").alias("h"), (F.col("tf") * F.log((1 + F.col("n_docs")) / (1 + F.col("df")))).alias("x"))
    cells = weighted.groupBy(key, (F.col("h") % size).alias("pos")).agg(F.sum("x").alias("x"))
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return cells.join(norms, key).filter("norm > 0").select(key, "pos", F.round(F.col("x") / F.col("norm"), 5).alias("value"))
