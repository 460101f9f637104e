"""Splitting rows into valid and rejected ones by named checks.

A check is a name and a condition that holds for good rows; a null condition fails. Rejected rows carry the names of the
checks they fail, in the order of the checks, and are never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types of entities and of relations.
TYPES = ("PERSON", "PHONE", "VEHICLE", "LOCATION", "ORGANIZATION", "ACCOUNT", "CASE", "DATE")
RELATIONS = ("APPEARS_IN_SAME_DOCUMENT", "CALLED", "TRANSFERRED_MONEY_TO", "APPEARS_IN_CASE", "OWNS", "LOCATED_AT", "ASSOCIATED_WITH", "WORKS_FOR", "CONNECTED_TO")
ENTITY_CHECKS = {"name": "trim(name) <> ''", "type": f"type IN {TYPES}", "confidence": "confidence BETWEEN 0 AND 1", "circle": "circle IS NOT NULL"}
EDGE_CHECKS = {"source": "trim(source) <> ''", "target": "trim(target) <> ''", "relationship": f"relationship IN {RELATIONS}", "confidence": "confidence BETWEEN 0 AND 1"}
RESULT_CHECKS = {"rank_no": "rank_no >= 1", "risk_score": "risk_score BETWEEN 0 AND 100", "entity_id": "trim(entity_id) <> ''", "evidence_line": "evidence_line >= 1", "text_snippet": "trim(text_snippet) <> ''"}
SEGMENT_CHECKS = {"video_id": "video_id IS NOT NULL", "order": "end_ts >= start_ts", "start": "start_ts >= 0"}


def checked(rows: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; the rejected have a column ``errors``, names joined by commas."""
    errors = F.concat_ws(",", *(F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)) for name, condition in checks.items()))
    judged = rows.withColumn("errors", errors)
    return judged.filter("errors = ''").drop("errors"), judged.filter("errors <> ''")
