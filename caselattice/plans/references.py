"""Queries of problem 2: references of edges and relationships that fail, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import Child, Parent, orphan_references, orphan_report
from ..tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name, *cols: table(spark, folder, name, *cols)
    parents = [
        Parent("entity", read("entities", "entity_id", "loaded_at", "deleted_at"), "entity_id", "loaded_at", "deleted_at"),
        Parent("record", read("cdr", "cdr_id", "loaded_at"), "cdr_id", "loaded_at"),
        Parent("record", read("bank_transactions", "txn_id", "loaded_at"), "txn_id", "loaded_at"),
        Parent("record", read("case_files", "doc_key", "loaded_at", "deleted_at"), "doc_key", "loaded_at", "deleted_at"),
    ]
    edges = read("edges", "edge_id", "source", "target", "timestamp")
    children = [
        Child("edges", "entity", edges, "source", "edge_id", "timestamp"),
        Child("edges", "entity", edges, "target", "edge_id", "timestamp"),
        Child("relationships", "record", read("relationships", "rel_id", "source_record", "timestamp"), "source_record", "rel_id", "timestamp"),
    ]
    return orphan_references(parents, children)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p2_found(spark, folder))


_KEY = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288) || chr(65279) || chr(8203)))"

_FOUND = f"""
WITH parent AS (
  SELECT 'entity' AS space, {_KEY.format('entity_id')} AS key, loaded_at, deleted_at FROM entities
  UNION ALL SELECT 'record', {_KEY.format('cdr_id')}, loaded_at, NULL FROM cdr
  UNION ALL SELECT 'record', {_KEY.format('txn_id')}, loaded_at, NULL FROM bank_transactions
  UNION ALL SELECT 'record', {_KEY.format('doc_key')}, loaded_at, deleted_at FROM case_files
), known AS (
  SELECT space, key, min(loaded_at) AS loaded, min(deleted_at) AS deleted FROM parent WHERE key <> '' GROUP BY 1, 2
), child AS (
  SELECT 'edges' AS ref_table, 'source' AS ref_field, edge_id AS ref_id, 'entity' AS space, {_KEY.format('source')} AS key, "timestamp" AS at FROM edges
  UNION ALL SELECT 'edges', 'target', edge_id, 'entity', {_KEY.format('target')}, "timestamp" FROM edges
  UNION ALL SELECT 'relationships', 'source_record', rel_id, 'record', {_KEY.format('source_record')}, "timestamp" FROM relationships
), judged AS (
  SELECT c.ref_table, c.ref_field, c.ref_id,
         CASE WHEN k.key IS NULL THEN 'missing' WHEN k.deleted <= c.at THEN 'deleted' WHEN k.loaded > c.at THEN 'late' END AS status,
         coalesce(strftime(c.at, '%Y-%m'), 'unknown') AS period
  FROM child c LEFT JOIN known k ON c.space = k.space AND c.key = k.key WHERE c.key <> ''
), found AS (SELECT DISTINCT * FROM judged WHERE status IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_report": _FOUND + "SELECT ref_table, ref_field, status, period, count(*) AS n_refs FROM found GROUP BY ALL",
}
