"""Queries of problem 5: entities that are the same person or firm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from .names import entity_groups, linked_pairs


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    entities = table(spark, folder, "entities", "entity_id", "type", "circle", "name", "aliases")
    return entity_groups(entities, table(spark, folder, "nickname_ref", "formal_name", "nickname"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_pairs(_groups(spark, folder))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity with a usable name: its group."""
    return _groups(spark, folder).distinct()


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLE: dict[str, str] = {}
