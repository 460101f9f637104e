"""Queries of problem 3: the call nearest to each transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import account_form, phone_form
from ..operators.skew import join_one
from ..session import BROADCAST_ROWS, broadcast_if_small
from ..tables import table
from .nearest import nearest_in_time

TOLERANCE_S = 900


def owned(rows: DataFrame, owners: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the ``subject`` of each owner of their ``key``; rows without one are left out.

    Owners are broadcast when a count shows there are few (here a few thousand at every scale), else joined with hot keys apart.
    """
    small = broadcast_if_small(owners, most)
    if small is not owners:
        return rows.join(small, "key").select(*rows.columns, "subject")
    lists = owners.groupBy("key").agg(F.collect_set("subject").alias("subjects"))
    return join_one(rows.filter("key IS NOT NULL"), lists, "key").select(*rows.columns, F.explode("subjects").alias("subject"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "subscribers", "person_id", "phone", "account")
    of = lambda column, form: owners.select(form(F.col(column)).alias("key"), F.col("person_id").alias("subject")).dropna().distinct()
    calls = table(spark, folder, "cdr", "cdr_id", "caller", "timestamp").select("cdr_id", phone_form(F.col("caller")).alias("key"), F.col("timestamp").alias("at"))
    moves = table(spark, folder, "bank_transactions", "txn_id", "source_account", "timestamp").select("txn_id", account_form(F.col("source_account")).alias("key"), F.col("timestamp").alias("at"))
    # 1970-01-01 00:00:00 stands for an unknown time
    known = F.col("at") > F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return nearest_in_time(
        owned(moves.filter(known), of("account", account_form)), owned(calls.filter(known), of("phone", phone_form)),
        TOLERANCE_S, "txn_id", "cdr_id",
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("cdr_id", "txn_id")


def p3_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs per minute of distance."""
    return _pairs(spark, folder).groupBy(F.floor(F.col("gap_us") / 60_000_000).cast("long").alias("minutes")).agg(F.count(F.lit(1)).alias("n_pairs"))


_SQL = """
WITH phones AS (SELECT DISTINCT phone AS key, person_id FROM subscribers WHERE phone IS NOT NULL),
accounts AS (SELECT DISTINCT account AS key, person_id FROM subscribers WHERE account IS NOT NULL),
calls AS (
  SELECT DISTINCT c.cdr_id, p.person_id, c."timestamp" AS at FROM cdr c
  JOIN phones p ON p.key = right(regexp_replace(c.caller, '[^0-9]', '', 'g'), 10)
  WHERE c."timestamp" > TIMESTAMP '1970-01-01 00:00:00'
), moves AS (
  SELECT DISTINCT t.txn_id, a.person_id, t."timestamp" AS at FROM bank_transactions t
  JOIN accounts a ON a.key = upper(regexp_replace(t.source_account, '[^0-9A-Za-z]', '', 'g'))
  WHERE t."timestamp" > TIMESTAMP '1970-01-01 00:00:00'
), ranked AS (
  SELECT m.txn_id, c.cdr_id, abs(epoch_us(m.at) - epoch_us(c.at)) AS gap_us,
         row_number() OVER (PARTITION BY m.txn_id ORDER BY abs(epoch_us(m.at) - epoch_us(c.at)), c.at, c.cdr_id) AS place
  FROM moves m JOIN calls c ON m.person_id = c.person_id AND c.at BETWEEN m.at - INTERVAL 900 SECOND AND m.at + INTERVAL 900 SECOND
)
"""

QUERIES = {"p3_found": p3_found, "p3_gaps": p3_gaps}
ORACLE = {
    "p3_found": _SQL + "SELECT cdr_id, txn_id FROM ranked WHERE place = 1",
    "p3_gaps": _SQL + "SELECT CAST(gap_us // 60000000 AS BIGINT) AS minutes, count(*) AS n_pairs FROM ranked WHERE place = 1 GROUP BY 1",
}
