"""Queries of problem 4: the true language of case files and of the segments of mixed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .language import document_languages, fit, learn_words, line_languages, segments, sentence_rows


def _fit(spark: SparkSession, folder: str):
    filter_ = fit(table(spark, folder, "lang_samples", "lang", "text"))  # 400 rows at every scale
    codes = table(spark, folder, "lang_codes", "label_form", "lang")  # 42 rows at every scale
    files = table(spark, folder, "case_files", "doc_key", "lang_label", "clean_text")
    return learn_words(filter_, files.join(F.broadcast(codes), F.col("lang_label") == F.col("label_form")), "doc_key", "clean_text", "lang")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "case_files", "doc_key", "lang_label", "clean_text")
    found = line_languages(files, ["doc_key", "lang_label"], "clean_text", _fit(spark, folder))
    codes = table(spark, folder, "lang_codes", "label_form", F.col("lang").alias("meant"))  # 42 rows at every scale
    right = (F.col("lang_label") == F.col("label_form")) & (F.col("lang") == F.col("meant")) & (F.col("line_no") == 0)
    return found.join(F.broadcast(codes), right, "left_anti").filter(F.col("lang").isNotNull()).select("doc_key", "line_no", "lang").distinct()


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every case file's main language and confidence."""
    files = table(spark, folder, "case_files", "doc_key", "clean_text")
    return document_languages(files, ["doc_key"], "clean_text", _fit(spark, folder)).select("doc_key", "lang", "confidence").distinct()


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of one language of every case file."""
    files = table(spark, folder, "case_files", "doc_key", "clean_text")
    return segments(sentence_rows(files, ["doc_key"], "clean_text", _fit(spark, folder)), "doc_key")


QUERIES = {"p4_found": p4_found, "p4_languages": p4_languages, "p4_segments": p4_segments}
ORACLE: dict[str, str] = {}
