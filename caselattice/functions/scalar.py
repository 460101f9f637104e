"""Column functions: canonical forms of phones, accounts, plates and names, stable ids, vector and interval arithmetic.

Every function is null for a null input and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank abbreviations kept in capitals, and look-alike characters of number plates.
RANKS = ("SI", "ASI", "PSI", "DSP", "SP", "IPS", "SHO", "IO")
PLATE_FROM, PLATE_TO = "OQILZ", "00112"


def phone_form(column: Column) -> Column:
    """The ten significant digits: country code, trunk zero and punctuation removed; null for other lengths and first digits below 6."""
    digits = F.regexp_replace(column, r"[^0-9]", "")
    bare = F.regexp_replace(digits, r"^(?:0*91|0+)([0-9]{10})$", "$1")
    return F.when(bare.rlike("^[6-9][0-9]{9}$"), bare)


def account_form(column: Column) -> Column:
    """Upper-case code without spaces and punctuation; null when nothing is left."""
    code = F.upper(F.regexp_replace(column, r"[^0-9A-Za-z]", ""))
    return F.when(code != "", code)


def plate_form(column: Column) -> Column:
    """Upper-case letters and digits of a plate, look-alikes made equal (O, Q to 0; I, L to 1; Z to 2)."""
    return F.translate(F.upper(F.regexp_replace(column, r"[^0-9A-Za-z]", "")), PLATE_FROM, PLATE_TO)


def valid_plate_text(column: Column) -> Column:
    """The normalised text of a plate when it has five characters or more and a digit, else null."""
    plate = plate_form(column)
    return F.when((F.length(plate) >= 5) & plate.rlike("[0-9]"), plate)


def name_case(column: Column) -> Column:
    """Blanks collapsed and each word capitalised; rank abbreviations stay in capitals."""
    words = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    cased = F.transform(words, lambda w: F.when(F.upper(w).isin(*RANKS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))))
    return F.array_join(cased, " ")


def slug(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[^a-z0-9]+", "_")


def stable_id(kind: Column, canonical: Column) -> Column:
    """``KIN_`` and the first eight hex digits of SHA-256 of ``TYPE:canonical``; what already is such an id stays."""
    return F.when(canonical.rlike("^[A-Z]{3}_[0-9a-f]{8}$"), canonical).otherwise(_digest_id(kind, canonical))


def _digest_id(kind: Column, canonical: Column) -> Column:
    return F.concat(F.substring(kind, 1, 3), F.lit("_"), F.substring(F.sha2(F.concat(kind, F.lit(":"), canonical), 256), 1, 8))


def clean(column: Column) -> Column:
    """Control characters out, horizontal blanks collapsed, at most one empty line in a row, ends trimmed."""
    bare = F.regexp_replace(column, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    flat = F.regexp_replace(bare, r"[ \t\x{a0}]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(flat, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 beside a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 when the union is empty."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    whole = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def rescale(value: Column, floor: float, ceiling: float) -> Column:
    """Linear rescaling of a similarity from ``[floor, ceiling]`` to ``[0, 1]``, clamped."""
    return F.least(F.greatest((value - floor) / (ceiling - floor), F.lit(0.0)), F.lit(1.0))


def clock(seconds: Column) -> Column:
    """``mm:ss`` of seconds."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def shorten(column: Column, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters and a mark when the text is longer."""
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size), F.lit(mark))).otherwise(column)


def first_timestamp(column: Column, *formats: str) -> Column:
    """The first of several formats that parses; null when none does."""
    return F.coalesce(*(F.try_to_timestamp(column, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def contains_any(column: Column, words: list[str]) -> Column:
    """The listed words that occur in a text, case ignored."""
    low = F.lower(column)
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, F.lower(w)))
