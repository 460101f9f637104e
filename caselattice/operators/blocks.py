"""Classifying the lines of case texts into header fields, table rows, noise and narrative.

Each line is classified by itself; a table header makes the delimited lines below it table rows until a line with another
number of cells. That look-ahead is per text, so the texts are mapped in Arrow batches, whole. The same class is registered
as a table function for SQL.

Defined results: null and empty texts give no blocks; consecutive narrative lines form one block; line numbers start at 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_FIELD = re.compile(r"\s*([^\W\d][^:：|\t]{0,38}?)\s*[:：]\s*(\S.*?)\s*$")
_RULE = re.compile(r"\s*[-=_*~#.]{3,}\s*$|\s*page\s+\d+(\s+of\s+\d+)?\s*$", re.I)
DELIMITERS = ("|", "\t", ";")
# The mark after which a document holds nothing, and the words in the head of a column of names.
_END = re.compile(r"---\s*end\s*of\s*document|note\s*for\s*testing\s*purposes", re.I)
NAME_HEADS = ("name", "person", "witness", "suspect", "individual", "accused")
SCHEMA = "kind string, first_line int, last_line int, text string"


def classify(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, first line, last line, text)`` of the blocks of a text."""
    lines = text.split("\n")
    blocks: list[tuple[str, int, int, str]] = []
    story: list[str] = []

    def close(at: int) -> None:
        if any(s.strip() for s in story):
            blocks.append(("NARRATIVE", at - len(story) + 1, at, "\n".join(story).strip("\n")))
        story.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if _END.search(line):
            close(i)
            blocks.append(("NOISE", i + 1, len(lines), "\n".join(lines[i:]).strip()))
            return blocks
        mark = next((d for d in DELIMITERS if line.count(d) >= 2), None)
        if mark and i + 1 < len(lines) and lines[i + 1].count(mark) == line.count(mark):
            close(i)
            while i < len(lines) and lines[i].count(mark) == line.count(mark):
                blocks.append(("TABLE_ROW", i + 1, i + 1, lines[i].strip()))
                i += 1
            continue
        field = _FIELD.match(line)
        if _RULE.match(line):
            close(i)
            blocks.append(("NOISE", i + 1, i + 1, line.strip()))
        elif field and len(field[1].split()) <= 4 and not story:
            blocks.append(("HEADER_FIELD", i + 1, i + 1, line.strip()))
        elif not line.strip():
            close(i)
        else:
            story.append(line)
        i += 1
    close(len(lines))
    return blocks


def table_names(rows: list[str]) -> list[str]:
    """The cells of the name column of a table's rows, the first row being its head; none without such a column."""
    mark = next((d for d in DELIMITERS if rows and rows[0].count(d) >= 2), None)
    if not mark:
        return []
    cells = [[c.strip() for c in r.strip().strip(mark if mark == "|" else "").split(mark)] for r in rows]
    at = next((i for i, c in enumerate(cells[0]) if any(h in c.lower() for h in NAME_HEADS)), None)
    return [] if at is None else [r[at] for r in cells[1:] if at < len(r) and len(r[at]) >= 2]


def routed_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, type, value, method, confidence)``: each block read in its own way.

    Identifiers by pattern come from the whole text; the name column of a table gives persons; header fields and narrative give
    the names of numbered lists in them; noise gives nothing. A null or empty text has none.
    """
    of = lambda kind, values, sure, method: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(method).alias("method"), F.lit(sure).alias("confidence")))
    c = F.col(text)
    whole = df.select(key, F.inline(F.concat(of("PHONE", T.found(c, T.PHONE), 0.98, "regex"), of("VEHICLE", T.found(c, T.PLATE), 0.98, "regex"), of("ACCOUNT", T.accounts(c), 0.95, "regex"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                table: list[str] = []
                for kind, _, _, block in [*(classify(value) if value else ()), ("", 0, 0, "")]:
                    if kind == "TABLE_ROW":
                        table.append(block)
                        continue
                    for name in table_names(table):
                        rows.append(i)
                        names.append(name)
                    table = []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string())], names=[key, "value"])

    tabled = df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, value string").select(
        key, F.lit("PERSON").alias("type"), "value", F.lit("table").alias("method"), F.lit(0.88).alias("confidence")
    )
    told = line_blocks(df, key, text).filter("kind IN ('NARRATIVE', 'HEADER_FIELD')").select(key, F.inline(of("PERSON", T.found(F.col("text"), T.LISTED_NAME), 0.85, "list")))
    return whole.unionByName(tabled).unionByName(told)


def line_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, kind, first_line, last_line, text)`` of every block of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for block in classify(value) if value else ():
                    rows.append(i)
                    found.append(block)
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "kind", "first_line", "last_line", "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}")


def register(spark: SparkSession, name: str = "line_blocks") -> None:
    """Make ``line_blocks(text)`` a table function of SQL."""

    @F.udtf(returnType=SCHEMA)
    class Blocks:
        def eval(self, text: str):
            yield from classify(text or "")

    spark.udtf.register(name, Blocks)


def rebuild(blocks: DataFrame, key: str) -> DataFrame:
    """The text of each document without noise, blocks in order."""
    kept = blocks.filter("kind <> 'NOISE'")
    ordered = F.array_sort(F.collect_list(F.struct("first_line", "text")))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))
