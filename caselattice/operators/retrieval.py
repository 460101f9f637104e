"""Keyword and vector retrieval, and the fusion of scores.

Vector search is exact: queries and rows are packed into blocks, a block of each meets as one matrix product in an Arrow
worker that keeps the best ``k`` rows per query, and a window keeps the best of all blocks. Blocks bound what a task holds.
The query set may grow with the data, so it is never broadcast unchecked: it is joined as blocks.

Defined results: rows or queries with a null vector or another length are left out; a zero vector has similarity 0 to all;
ties are ordered by the row's id; a query does not find itself when ``skip_self`` is set; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Rows of a block; two blocks are multiplied at once.
BLOCK = 8192


def vector_topk(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int, skip_self: bool = True) -> DataFrame:
    """``query_id, row_id, score, place``: the ``k`` rows of highest cosine for each query."""
    asked, held = (_blocks(df, key, vector) for df, key in ((queries, query_id), (rows, row_id)))
    pairs = held.select(F.col("ids").alias("r_ids"), F.col("vs").alias("r_vs")).crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rs, qs = (np.asarray(batch.column(c)[i].as_py(), np.int64) for c in ("r_ids", "q_ids"))
                size = max((len(v) for v in batch.column("q_vs")[i].as_py()), default=0)
                r_fit, m = _matrix(batch.column("r_vs")[i].as_py(), size)
                q_fit, a = _matrix(batch.column("q_vs")[i].as_py(), size)
                scores = np.round(a @ m.T, 9)
                rs, qs = rs[r_fit], qs[q_fit]
                if skip_self:
                    scores[qs[:, None] == rs[None, :]] = -np.inf
                by_id = np.argsort(rs, kind="stable")  # so that ties keep the least ids
                top = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
                kept = np.take_along_axis(scores, top, axis=1)
                real = np.isfinite(kept).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qs, top.shape[1])[real]), pa.array(rs[top].ravel()[real]), pa.array(kept.ravel()[real])], names=["q", "r", "score"]
                )

    met = pairs.mapInArrow(best, "q long, r long, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "r")
    top = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.select(F.col("q").alias("query_id"), F.col("r").alias("row_id"), F.round("score", 6).alias("score"), "place")


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``ids, vs``: the rows packed into blocks of about ``BLOCK`` rows."""
    kept = df.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<float>").alias("v")).dropna()
    n_blocks = max(1, -(-kept.count() // BLOCK))
    packed = kept.groupBy(F.pmod(F.xxhash64("i"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("i", "v")).alias("x"))
    return packed.select(F.col("x.i").alias("ids"), F.col("x.v").alias("vs"))


def _matrix(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of the right size, and these as rows of length one."""
    fit = [j for j, v in enumerate(vectors) if len(v) == size]
    return np.asarray(fit, np.int64), _unit(np.asarray([vectors[j] for j in fit], np.float64).reshape(len(fit), size))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, pos, value``: the mean vector of each group, of length one, in long form (sums combine before the shuffle)."""
    parts = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    size = parts.groupBy(group).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("size"))
    return parts.join(size, group).select(group, "pos", F.when(F.col("size") > 0, F.col("mean") / F.col("size")).otherwise(F.lit(0.0)).alias("value"))


def term_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``token, key, n, tf``: the inverted index with term frequencies."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("token"))
    counted = words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = df.select(key, F.size(tokens(F.col(text))).alias("size"))
    return counted.join(sizes.groupBy(key).agg(F.max("size").alias("size")), key).select("token", key, "n", F.round(F.col("n") / F.col("size"), 6).alias("tf"))


def keyword_search(index: DataFrame, key: str, words: list[str], k: int) -> DataFrame:
    """The ``k`` documents of the largest sum of term frequencies; the filter on tokens reaches the index's scan."""
    hits = index.filter(F.col("token").isin(*words)).groupBy(key).agg(F.round(F.sum("tf"), 6).alias("score"), F.count(F.lit(1)).alias("n_words"))
    return hits.orderBy(F.desc("score"), key).limit(k)


def bm25(index: DataFrame, key: str, words: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents by BM25 over the index."""
    sizes = index.groupBy(key).agg(F.sum("n").alias("size"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("size").alias("mean_size"))  # one row
    hits = index.filter(F.col("token").isin(*words))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # one row per query word
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    scored = hits.join(F.broadcast(df), "token").join(sizes, key).crossJoin(F.broadcast(whole)).groupBy(key).agg(F.round(F.sum(idf * part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def fuse(scores: DataFrame, key: str, weights: dict[str, float], floor_when: tuple[str, float] | None = None) -> DataFrame:
    """Weighted sum of score columns, missing ones 0, at most 1; ``floor_when=(column, least)`` lifts rows where the column is 1."""
    total = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    value = F.least(total, F.lit(1.0))
    if floor_when:
        value = F.when(F.col(floor_when[0]) >= 1, F.greatest(value, F.lit(floor_when[1]))).otherwise(value)
    return scores.select(key, F.round(value, 3).alias("score"))


def evidence_lines(df: DataFrame, key: str, text: str, pattern: str, per_doc: int) -> DataFrame:
    """The first ``per_doc`` lines of each text that match a pattern, case ignored: ``key, line_no, line``."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")).filter(F.col("line").rlike(f"(?i){pattern}"))
    order = W.partitionBy(key).orderBy("pos")
    return lines.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_doc).select(key, (F.col("pos") + 1).alias("line_no"), "line")
