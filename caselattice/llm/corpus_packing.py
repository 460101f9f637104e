"""Queries of problem 7: the documents in containers of each listed capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from .packing import pack_specs
from .tokens import VOCABULARIES, token_counts

#: File ending of each tokenizer that may be named in ``pack_spec``.
KINDS = {"byte_bpe_50k": "json", "word_bpe_49k": "json", "byte_bpe_multi_50k": "tiktoken", "piece_bpe_32k": "model"}


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part of a document and spec: ``spec_id, doc_id, part_no, start, n, container, position``."""
    specs = table(spark, folder, "pack_spec", "spec_id", "tokenizer", "capacity").dropna().collect()  # a fixed handful of rows
    documents = table(spark, folder, "documents", "doc_id", "text")
    counted = {
        name: cut(token_counts(documents, "doc_id", "text", f"{VOCABULARIES}/{name}.{KINDS[name]}"))
        for name in sorted({s["tokenizer"] for s in specs})
    }
    asked = [
        counted[s["tokenizer"]].select(F.lit(s["spec_id"]).alias("spec_id"), F.lit(s["capacity"]).alias("capacity"), "doc_id", "n_tokens")
        for s in sorted(specs, key=lambda s: s["spec_id"])
    ]
    return pack_specs(reduce(DataFrame.unionByName, asked), "doc_id", "n_tokens", {s["spec_id"]: s["capacity"] for s in specs})


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: containers used, the least number possible by volume, tokens held."""
    capacity = F.broadcast(table(spark, folder, "pack_spec", "spec_id", "capacity"))
    return (
        p7_containers(spark, folder)
        .groupBy("spec_id").agg(F.max("container").alias("last"), F.sum("n").alias("n_tokens"))
        .join(capacity, "spec_id")
        .select("spec_id", (F.col("last") + 1).alias("n_containers"), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("long").alias("least"), "n_tokens")
    )


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: documents placed, containers over their capacity, parts that overlap another, documents split though they fit."""
    capacity = table(spark, folder, "pack_spec", "spec_id", "capacity")
    parts = cut(p7_containers(spark, folder))
    docs = parts.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    filled = parts.filter("container IS NOT NULL").groupBy("spec_id", "container").agg(F.sum("n").alias("held"), F.max(F.col("position") + F.col("n")).alias("end"))
    one = docs.join(F.broadcast(capacity), "spec_id").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("k") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_split"))
    two = filled.join(F.broadcast(capacity), "spec_id").groupBy("spec_id").agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_over"), F.count_if(F.col("end") != F.col("held")).alias("n_gaps"))
    return one.join(two, "spec_id").select("spec_id", "n_docs", "n_split", "n_over", "n_gaps")


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants}
ORACLE = {"p7_invariants": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS n_split, 0 AS n_over, 0 AS n_gaps FROM pack_spec"}
