"""Readers of case folders: texts, calls, transfers, entity and relation arrays, line-delimited records, graphs, vectors.

Schemas are explicit, so no pass over the data infers them. Broken records are kept in ``_broken`` or given back as the
rejected half of a pair, never dropped silently. Missing paths give empty frames when ``optional`` is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import first_timestamp
from ..operators.validation import EDGE_CHECKS, checked

# The accepted timestamp and date forms, and the columns of both call and transfer layouts.
TIMESTAMPS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm")
DATES = ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")
CALLS = "caller string, callee string, timestamp string, duration_seconds string, tower_location string"
CALLS_OF_CASE = "timestamp string, caller string, receiver string, duration_sec string, tower_id string, hour string"
TRANSFERS = "source_account string, target_account string, amount_inr string, timestamp string, remarks string"
TRANSFERS_OF_CASE = "timestamp string, sender_account string, receiver_account string, amount_inr string, transaction_id string, flagged string"
ENTITY = "entity_id string, type string, name string, aliases array<string>, source_documents array<string>, confidence double, needs_review boolean"
RELATION = "source string, target string, relationship string, timestamp string, source_record string, confidence double"
SEGMENT = (
    "video_id string, segment_id string, start_ts double, end_ts double, visual struct<description:string, embedding_id:string, quality_flag:string>, audio struct<transcript:string, embedding_id:string>,"
    " objects array<struct<label:string, confidence:double, attributes:array<string>>>, ocr array<string>, scores map<string, double>"
)


def texts(spark: SparkSession, path: str, pattern: str = "*.txt", largest: int | None = None, recursive: bool = False) -> DataFrame:
    """``path, name, text`` of whole files of any size, or of those up to ``largest`` bytes when given."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    if largest is not None:
        found = found.filter(F.col("length") <= largest)  # reaches the file listing
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def corpus(spark: SparkSession, path: str, largest: int = 1 << 20) -> DataFrame:
    """``path, name, text`` of the txt, csv and json files under a folder up to ``largest`` bytes, for the search index (which has that limit)."""
    return texts(spark, path, "*.{txt,csv,json}", largest, recursive=True)


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV file with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def pattern_flags(spark: SparkSession, path: str) -> DataFrame:
    """``entity_id, flags, priority_score, evidence`` of a JSON array of flagged entities, one row per entity (the highest priority)."""
    rows = spark.read.json(path, schema="entity_id string, flags array<string>, priority_score double, evidence array<string>", multiLine=True)
    best = F.max_by(F.struct("flags", "priority_score", "evidence"), F.coalesce("priority_score", F.lit(-1.0))).alias("b")
    return rows.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(best).select("entity_id", "b.*")


def case_folder(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, doc_type, clean_text``: texts, calls and transfers of a case folder as documents; what is missing there is left out."""
    schema = "doc_id string, doc_type string, clean_text string"
    parts = [
        optional(spark, lambda s, p: texts(s, p).select(F.col("name").alias("doc_id"), F.lit("FIR").alias("doc_type"), F.col("text").alias("clean_text")), f"{path}/firs", schema),
        optional(spark, lambda s, p: rows_as_documents(calls(s, p)[0].withColumn("key", F.concat_ws("|", "src_file", "caller", "callee", "ts")), "CDR", "key", "Call from %s to %s at %s, %s seconds, at %s.", "caller", "callee", "ts", "duration_s", "place"), f"{path}/cdrs", schema),
        optional(spark, lambda s, p: rows_as_documents(transfers(s, p)[0].withColumn("key", F.concat_ws("|", "src_file", "src", "dst", "ts", "amount")), "TXN", "key", "Transfer from %s to %s of %s at %s: %s.", "src", "dst", "amount", "ts", "remarks"), f"{path}/transactions", schema),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = spark.read.csv(path, schema=f"{schema}, _broken string", header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", enforceSchema=True)
    return read.withColumn("src_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def calls(spark: SparkSession, path: str, of_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(calls, rejected)`` of either layout: ``caller, callee, ts, duration_s, place, src_file``; rows without a time are rejected."""
    rows = _csv(spark, path, CALLS_OF_CASE if of_case else CALLS)
    names = ("receiver", "duration_sec", "tower_id") if of_case else ("callee", "duration_seconds", "tower_location")
    typed = rows.select(
        "caller", F.col(names[0]).alias("callee"), first_timestamp(F.col("timestamp"), *TIMESTAMPS).alias("ts"),
        F.coalesce(F.expr(f"try_cast({names[1]} AS int)"), F.lit(0)).alias("duration_s"), F.col(names[2]).alias("place"), "src_file", F.col("timestamp").alias("given"),
    )
    return typed.filter("ts IS NOT NULL").drop("given"), typed.filter("ts IS NULL")


def transfers(spark: SparkSession, path: str, of_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(transfers, rejected)``: ``src, dst, ts, amount, remarks, flagged, src_file``; an amount that is no number counts 0."""
    rows = _csv(spark, path, TRANSFERS_OF_CASE if of_case else TRANSFERS)
    src, dst = ("sender_account", "receiver_account") if of_case else ("source_account", "target_account")
    typed = rows.select(
        F.col(src).alias("src"), F.col(dst).alias("dst"), first_timestamp(F.col("timestamp"), *TIMESTAMPS).alias("ts"),
        F.coalesce(F.expr("try_cast(amount_inr AS double)"), F.lit(0.0)).alias("amount"),
        (F.lit(None).cast("string") if of_case else F.col("remarks")).alias("remarks"), (F.col("flagged") == "1" if of_case else F.lit(None).cast("boolean")).alias("flagged"),
        "src_file", F.col("timestamp").alias("given"),
    )
    return typed.filter("ts IS NOT NULL").drop("given"), typed.filter("ts IS NULL")


def rows_as_documents(rows: DataFrame, prefix: str, key: str, sentence: str, *columns: str) -> DataFrame:
    """Rows as one-sentence documents ``doc_id, doc_type, clean_text``; ids are a digest of ``key``, stable over any order."""
    return rows.select(
        F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12)).alias("doc_id"), F.lit(prefix).alias("doc_type"),
        F.format_string(sentence, *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns)).alias("clean_text"),
    )


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON array file; broken records keep their text in ``_broken``."""
    return spark.read.json(path, schema=f"{ENTITY}, _broken string", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")


def relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` relations of a JSON array file."""
    rows = spark.read.json(path, schema=RELATION, multiLine=True).withColumn("ts", first_timestamp(F.col("timestamp"), *TIMESTAMPS))
    return checked(rows, EDGE_CHECKS)


def segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, broken)`` of line-delimited segment records."""
    rows = spark.read.json(path, schema=f"{SEGMENT}, _broken string", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").cache()
    return rows.filter("_broken IS NULL").drop("_broken"), rows.filter("_broken IS NOT NULL").select("_broken")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` written by the graph sink; a missing or incomplete folder raises ``ValueError``."""
    try:
        nodes, edges = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    except AnalysisException as e:
        raise ValueError(f"no graph at {path}") from e
    if not {"entity_id", "type"} <= set(nodes.columns) or not {"src", "dst", "relationship"} <= set(edges.columns):
        raise ValueError(f"incomplete graph at {path}")
    return nodes, edges


def vectors(spark: SparkSession, path: str, id_column: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Stored vectors beside their ids."""
    rows = spark.read.parquet(path)
    if not isinstance(rows.schema[vector].dataType, T.ArrayType):
        raise ValueError(f"{vector} is no array")
    return rows.withColumn(vector, F.col(vector).cast("array<float>")).withColumn(id_column, F.col(id_column))


def optional(spark: SparkSession, read, path: str, schema: str) -> DataFrame:
    """``read(spark, path)``, or an empty frame of ``schema`` when nothing is there."""
    try:
        return read(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
