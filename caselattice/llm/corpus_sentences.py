"""Queries of problem 8: the sentence units of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .sentences import sentence_units


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_units(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p8_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per document with units: how many there are and how many characters they hold."""
    size = F.col("end_off") - F.col("start_off")
    return p8_found(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(size).alias("n_chars"))


QUERIES = {"p8_found": p8_found, "p8_cover": p8_cover}
ORACLE: dict[str, str] = {}
