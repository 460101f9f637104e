"""The canonical calls, transfers, vertices and edges, from the tables of the evidence domain.

Copies of a row (same key) are dropped once here. Timestamps stay without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import account_form, phone_form
from ..tables import table

EPOCH = "1970-01-01 00:00:00"


def known_time(column: str = "ts"):
    """Whether a timestamp is there and not the zero of the epoch, which stands for an unknown time."""
    return F.col(column) > F.lit(EPOCH).cast("timestamp_ntz")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """``call_id, caller, callee, ts, duration_s, place``; numbers in their ten-digit form, times known."""
    return (
        table(spark, folder, "cdr", "cdr_id", "caller", "callee", "timestamp", "duration_seconds", "tower_location")
        .groupBy(F.col("cdr_id").alias("call_id")).agg(
            F.min(phone_form(F.col("caller"))).alias("caller"), F.min(phone_form(F.col("callee"))).alias("callee"), F.min("timestamp").alias("ts"),
            F.min("duration_seconds").alias("duration_s"), F.min("tower_location").alias("place"),
        )
        .filter(known_time())
    )


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """``txn_id, src, dst, ts, amount, remarks``; account codes in one form, times known."""
    return (
        table(spark, folder, "bank_transactions", "txn_id", "source_account", "target_account", "amount_inr", "timestamp", "remarks")
        .groupBy("txn_id").agg(
            F.min(account_form(F.col("source_account"))).alias("src"), F.min(account_form(F.col("target_account"))).alias("dst"), F.min("timestamp").alias("ts"),
            F.min("amount_inr").alias("amount"), F.min("remarks").alias("remarks"),
        )
        .filter(known_time())
    )


def parties(calls_: DataFrame) -> DataFrame:
    """One row per call and different party: ``phone, call_id, ts, duration_s, place``."""
    both = F.array_distinct(F.array_compact(F.array("caller", "callee")))
    return calls_.select(F.explode(both).alias("phone"), "call_id", "ts", "duration_s", "place")


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_id, type, name, aliases, source_documents, confidence, needs_review``, one row per id."""
    return table(
        spark, folder, "entities", "entity_id", "type", "name", "aliases", "source_documents", "confidence", "needs_review"
    ).groupBy("entity_id").agg(*(F.min(c).alias(c) for c in ("type", "name", "aliases", "source_documents", "confidence", "needs_review")))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """``edge_id, src, dst, relationship, ts, source_record, confidence, weight``, one row per id, ends as typed."""
    return table(spark, folder, "edges").groupBy("edge_id").agg(
        F.min("source").alias("src"), F.min("target").alias("dst"), F.min("relationship").alias("relationship"), F.min("timestamp").alias("ts"),
        F.min("source_record").alias("source_record"), F.min("confidence").alias("confidence"), F.min("weight").alias("weight"),
    )


#: The same tables in SQL, to start the SQL of a query with.
SQL = {
    "calls": """calls AS (
  SELECT * FROM (SELECT cdr_id AS call_id, min(CASE WHEN regexp_matches(pc, '^[6-9][0-9]{9}$') THEN pc END) AS caller, min(CASE WHEN regexp_matches(pe, '^[6-9][0-9]{9}$') THEN pe END) AS callee,
    min("timestamp") AS ts, min(duration_seconds) AS duration_s, min(tower_location) AS place
  FROM (SELECT *, regexp_replace(regexp_replace(caller, '[^0-9]', '', 'g'), '^(?:0*91|0+)([0-9]{10})$', '\\1') AS pc,
               regexp_replace(regexp_replace(callee, '[^0-9]', '', 'g'), '^(?:0*91|0+)([0-9]{10})$', '\\1') AS pe FROM cdr)
  GROUP BY cdr_id) WHERE ts > TIMESTAMP '1970-01-01 00:00:00')""",
    "transfers": """transfers AS (
  SELECT * FROM (SELECT txn_id, min(nullif(upper(regexp_replace(source_account, '[^0-9A-Za-z]', '', 'g')), '')) AS src,
    min(nullif(upper(regexp_replace(target_account, '[^0-9A-Za-z]', '', 'g')), '')) AS dst, min("timestamp") AS ts, min(amount_inr) AS amount, min(remarks) AS remarks
  FROM bank_transactions GROUP BY txn_id) WHERE ts > TIMESTAMP '1970-01-01 00:00:00')""",
    "parties": """parties AS (
  SELECT caller AS phone, call_id, ts, duration_s, place FROM calls WHERE caller IS NOT NULL
  UNION ALL SELECT callee, call_id, ts, duration_s, place FROM calls WHERE callee IS NOT NULL AND callee IS DISTINCT FROM caller)""",
    "vertices": """vertices AS (
  SELECT entity_id, min(type) AS type, min(name) AS name, min(aliases) AS aliases, min(source_documents) AS source_documents, min(confidence) AS confidence
  FROM entities GROUP BY entity_id)""",
    "edge_rows": """edge_rows AS (
  SELECT edge_id, min(source) AS src, min(target) AS dst, min(relationship) AS relationship, min("timestamp") AS ts, min(source_record) AS source_record,
    min(confidence) AS confidence, min(weight) AS weight FROM edges GROUP BY edge_id)""",
}


def with_tables(*names: str, more: str = "") -> str:
    """``WITH`` clause of the named tables and further ones."""
    return "WITH RECURSIVE " + ",\n".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
