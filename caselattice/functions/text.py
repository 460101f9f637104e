"""Text extraction in column expressions: identifiers, dates and amounts, language markers, chunks and tokens.

Identifiers next to a digit or letter of any script are no identifiers. Every function is null or empty for a null text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of identifiers, marker words of code-mixed text and English stop words.
PHONE = r"(?<![0-9])(?:\+91[-.\s]?|0)?([6-9][0-9]{9})(?![0-9])"
PLATE = r"(?<![\p{L}\p{N}_])([A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4})(?![\p{L}\p{N}_])"
ACCOUNT = r"(?i)(?<![\p{L}\p{N}_])(ACC[0-9]{5}|ACC_[a-f0-9]{8})(?![\p{L}\p{N}_])"
ACCOUNT_NUMBER = r"(?i)(?:account\s+(?:number\s+)?|a/c\s*(?:no\.?\s*)?)([0-9]{9,18})(?![\p{L}\p{N}_])"
DATE = r"([0-9]{2}-[0-9]{2}-[0-9]{4})"
AMOUNT = r"Rs\. ?([0-9][0-9,]*)"
LISTED_NAME = r"(?m)^\s*[0-9]+\.\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+)*)"
CASE_NO = r"(?:FIR No\.|Case No\.|Case Number|Ref\. No\.): *([0-9A-Za-z/-]+)"
MARKERS = (
    "ne", "ka", "ki", "ko", "mein", "se", "hai", "tha", "thi", "the", "aur", "par", "jo", "woh", "yeh", "bataya", "dekha", "pakda", "giraftaar", "uska", "paas", "baith", "bhaag", "chura",
)
STOP_WORDS = ("the", "a", "an", "is", "in", "of", "and", "to", "for", "are", "at", "by", "on", "be", "this", "that", "with", "has", "was", "all", "from", "been", "have", "it")


def found(column: Column, pattern: str) -> Column:
    """All first groups of a pattern."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pattern), F.lit(1))


def accounts(column: Column) -> Column:
    """Account codes, then account numbers after a cue."""
    return F.concat(found(column, ACCOUNT), found(column, ACCOUNT_NUMBER))


def amounts(column: Column) -> Column:
    """The amounts of a text as numbers."""
    return F.transform(found(column, AMOUNT), lambda a: F.regexp_replace(a, ",", "").cast("long"))


def markers(column: Column) -> Column:
    """The romanised Hindi marker words that occur in a text."""
    words = F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_intersect(F.array_distinct(words), F.array(*(F.lit(m) for m in MARKERS)))


def mixed(column: Column) -> Column:
    """Whether a text is code-mixed: Devanagari letters, or two or more marker words."""
    return F.coalesce(column, F.lit("")).rlike("[ऀ-ॿ]") | (F.size(markers(column)) >= 2)


def tokens(column: Column) -> Column:
    """Lower-case words of three letters or more without stop words."""
    words = F.split(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def sentences(column: Column) -> Column:
    """Parts after an end mark before a capital or Devanagari letter, and lines; blank parts dropped."""
    marked = F.regexp_replace(F.coalesce(column, F.lit("")), "([.!?।])[ \\t\\n]+([A-Zऀ-ॿ])", "$1\n$2")
    return F.filter(F.transform(F.split(marked, "\n+"), lambda s: F.trim(s)), lambda s: s != "")


def chunks(df: DataFrame, text: str, size: int, overlap: int, skip_blank: bool = False) -> DataFrame:
    """One row per chunk of ``size`` characters, starting every ``size - overlap``: ``chunk_no, start, chunk, first_line``.

    The text is carried once per document up to the explode; a trailing chunk shorter than the overlap is kept.
    """
    step = size - overlap
    kept = df.filter(F.length(text) > 0)
    cut = kept.withColumn("start", F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))))
    before = F.substring(F.col(text), F.lit(1), F.col("start"))
    out = cut.withColumns({
        "chunk_no": (F.col("start") / step).cast("int"),
        "chunk": F.substring(F.col(text), F.col("start") + 1, F.lit(size)),
        "first_line": F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1,
    })
    return out.filter(F.trim(F.regexp_replace("chunk", r"\s+", " ")) != "") if skip_blank else out
