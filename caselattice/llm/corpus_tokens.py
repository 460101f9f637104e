"""Queries of problem 6: the corpus in token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .tokens import VOCABULARIES, decode_rows, encode

VOCABULARY = f"{VOCABULARIES}/byte_bpe_50k.json"


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", VOCABULARY)


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Text length and MD5 of every document, encoded and decoded again."""
    back = decode_rows(p6_ids(spark, folder), "doc_id", "ids", VOCABULARY)
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
ORACLE = {"p6_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents"}
