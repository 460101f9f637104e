"""Queries of problem 1: personal information in case files and in the snippets of the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .personal import Finder, found_rows, learn, redacted_rows


def _finder(spark: SparkSession, folder: str) -> Finder:
    return Finder(learn(table(spark, folder, "case_files", "raw_text"), "raw_text", table(spark, folder, "subscribers", "full_name")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    finder = _finder(spark, folder)
    files = found_rows(table(spark, folder, "case_files", "doc_key", "raw_text"), "case_files", "doc_key", "raw_text", finder)
    return files.unionByName(found_rows(table(spark, folder, "top3_results", "result_id", "text_snippet"), "top3_results", "result_id", "text_snippet", finder))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """``(src_table, row_key, text)``: every case file and every snippet with placeholders for personal information."""
    finder = _finder(spark, folder)
    files = redacted_rows(table(spark, folder, "case_files", "doc_key", "raw_text"), "doc_key", "raw_text", finder)
    snippets = redacted_rows(table(spark, folder, "top3_results", "result_id", "text_snippet"), "result_id", "text_snippet", finder)
    named = lambda name, df: df.select(F.lit(name).alias("src_table"), "row_key", "text")
    return named("case_files", files).unionByName(named("top3_results", snippets))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLE: dict[str, str] = {}
