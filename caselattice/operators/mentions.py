"""Cleaning extracted mentions: fragments, precedence of patterns over models, places taken for persons, junk; and timelines from text.

Mentions have ``doc, type, text, start, end, method, confidence``. Rules are column conditions, so a mention is kept, changed
or given a reason; nothing is dropped without one.

Defined results: null texts are junk; mentions without a place (-1) overlap nothing; equal mentions count as given; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import phone_form
from .intervals import overlap_join

# Function words that make no name, words of places, terms of forms and systems, words of institutions, cues of incidents.
FILLERS = tuple(dict.fromkeys(
    "ke ka ki ko se ne mein par tak maine humein hume mujhe uska uski unka unki woh yeh ye jo jiska jis jisme koi kuch apna apni apne hai hain tha thi the hoga hua hui hue raha rahi rahe gaya gayi gaye kiya kara"
    " bataya bola mila milega lagaya chalaya utha diya diye dikha aur ya lekin ab na hi bhi to jab tab toh phir naam vyakti dwara paisa rupaye phone return lakh mahine scheme milkar saath dosto wapas mil double".split()
))
PLACE_ENDINGS = tuple(
    "nagar colony vihar puram enclave basti ganj pura layout extension bagh kunj garden gardens marg road lane avenue path chowk crossing square market bazaar bazaars area block phase pocket zone west east north south".split()
)
NO_PLACE = r"\b(SI|ACP|DCP|SHO|Public|Private|Ltd|Inc)\b"
TERMS = (
    "psychological", "communications", "timeline", "authorship", "network graph", "identity", "relationship", "possible", "physical", "who", "family", "documentary", "hypothesis", "document", "location", "evidence",
    "activity", "organization", "person", "vehicle", "account", "date", "information", "fir", "si", "na", "bank", "shakti", "anita", "vikram", "ipc", "detail records", "call detail records",
)
TERM_PARTS = (
    "case no", "police station", "reporting officer", "first information", "under section", "ipc", "crpc", "ps 26152", "evidence database", "activity database", "initial fir", "network graph", "detail records",
)
TECHNICAL = tuple("dashboard search graph export review pipeline upload extract system engine module analysis workflow documentation centrality detection nlp llm rag ui streamlit scorer normalizer langgraph players interactive csv pdf louvain community".split())
INSTITUTIONS = tuple("board center group department association company inc ltd corp agency council commission force police bank hospital school university court station ministry".split())
LONE_WORDS = ("the", "a", "an", "this", "that", "entity", "name", "id", "entity_id", "entity_ids", "none", "null", "undefined")
INCIDENT = r"(?i)(?<![\p{L}\p{N}_])(incident|robbery|theft|assault|accident|murder|fraud|attack)(?![\p{L}\p{N}_])"
PATTERN_METHODS = ("regex", "list", "table")


def words(column: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def is_fragment(column: Column) -> Column:
    """All words are fillers, or of two or more words at most one is not and at least one is; no words are no fragment."""
    all_ = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{M}_']+)"), F.lit(1))
    fill = F.size(F.filter(all_, lambda w: w.isin(*FILLERS)))
    return (F.size(all_) > 0) & ((fill == F.size(all_)) | ((F.size(all_) >= 2) & (F.size(all_) - fill <= 1) & (fill >= 1)))


def _bare_words(column: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N}\p{M}_\s]", ""))
    return F.filter(F.split(kept, r"\s+"), lambda w: w != "")


def junk_reason(kind: Column, text: Column) -> Column:
    """Why a mention is no entity of its type, else null."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    words_ = _bare_words(low)
    odd = lambda mark: (F.length(low) - F.length(F.replace(low, F.lit(mark), F.lit("")))) % 2 == 1
    has = lambda known: F.size(F.filter(words_, lambda w: w.isin(*known))) > 0
    date = F.trim(text)
    name = (
        F.when(F.length(low) < 2, "short").when(low.rlike("^[0-9]+$"), "number").when(low.isin(*TERMS) | low.rlike("|".join(TERM_PARTS)), "term")
        .when((kind == "LOCATION") & low.rlike("[0-9]{2}/[0-9]{2}/[0-9]{4}"), "date").when(low.rlike("^[0-9]{1,2}:[0-9]{2}$"), "time").when(is_fragment(low), "fragment")
        .when((F.size(words_) <= 7) & has(TECHNICAL) & ~has(INSTITUTIONS), "technical").when(low.rlike("[,:]$"), "dangling").when(low.rlike(r"^[a-z]{2,4}\s?[0-9]{3,6}$"), "code")
        .when(odd('"') | odd("'"), "quote").when(low.isin(*LONE_WORDS), "word")
    )
    when = F.when(date.rlike("^[0-9]{4}$") & ~date.between("1900", "2099"), "number").when(date.rlike(r"(?i)^between\s+[0-9]") | date.rlike("^[0-9]{1,2}:[0-9]{2}$"), "time")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(kind == "PHONE", F.when(phone_form(text).isNull(), "phone"))
        .when(kind == "VEHICLE", F.when(~F.upper(F.regexp_replace(text, r"[^0-9A-Za-z]", "")).rlike("^[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}$"), "plate"))
        .when(kind == "DATE", when)
        .when(kind.isin("PERSON", "ORGANIZATION", "LOCATION"), name)
    )


def places(mentions: DataFrame, most: float = 0.72) -> DataFrame:
    """Persons and organisations of two or more words whose last is a word of places, or that name a sector, become locations of at most that confidence.

    Names with a rank or the word of a firm in them stay.
    """
    words_ = _bare_words(F.col("text"))
    last, before = F.lower(F.try_element_at(words_, F.lit(-1))), F.lower(F.try_element_at(words_, F.lit(-2)))
    ends = last.isin(*PLACE_ENDINGS, "sector") | ((before == "sector") & last.rlike("^[0-9]+$"))
    wrong = F.coalesce(F.col("type").isin("PERSON", "ORGANIZATION") & (F.size(words_) >= 2) & ~F.coalesce("text", F.lit("")).rlike(NO_PLACE) & ends, F.lit(False))
    return mentions.withColumns({"confidence": F.when(wrong, F.least("confidence", F.lit(most))).otherwise(F.col("confidence")), "type": F.when(wrong, "LOCATION").otherwise(F.col("type"))})


def patterns_first(mentions: DataFrame) -> DataFrame:
    """Mentions of a model that overlap a pattern's, or fold to the same letters and digits in the same text, are left out."""
    numbered = mentions.withColumn("m", F.xxhash64("doc", "type", "text", "start", "end", "method"))
    by_pattern = numbered.filter(F.col("method").isin(*PATTERN_METHODS))
    by_model = numbered.filter(~F.col("method").isin(*PATTERN_METHODS))
    fold = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    placed = lambda df, n: df.filter("start >= 0 AND end > start").select("doc", F.col("m").alias(f"m{n}"), F.col("start").alias(f"s{n}"), (F.col("end") - 1).alias(f"e{n}"))
    overlapping = overlap_join(placed(by_model, 1), placed(by_pattern, 2), "doc", 64, "s1", "e1", "s2", "e2").select(F.col("m1").alias("m"))
    same = by_model.select("doc", "m", fold(F.col("text")).alias("f")).join(by_pattern.select("doc", fold(F.col("text")).alias("f")).distinct(), ["doc", "f"], "left_semi").select("m")
    return by_pattern.unionByName(by_model.join(overlapping.unionByName(same).distinct(), "m", "left_anti")).drop("m")


def text_timeline(texts: DataFrame, key: str, text: str, base: Column, patterns: dict[str, tuple[str, int]], incident: str) -> DataFrame:
    """Values found per line as events: ``key, line_no, kind, value, ts``; ``base`` is a day, each kind has its hour, the line gives the minutes.

    ``patterns`` is kind -> (pattern, hour); a line that matches ``incident`` is an event at eleven. Values count once a line.
    """
    lines = texts.select(key, base.alias("base"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))

    def of_kind(kind: str, pattern: str, hour: int) -> Column:
        values = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda v: F.upper(v)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(hour).alias("hour")))

    seen = F.when(F.col("line").rlike(incident), F.array(F.struct(F.lit("incident").alias("kind"), F.concat(F.lit("line "), F.col("pos") + 1).alias("value"), F.lit(11).alias("hour"))))
    found = F.flatten(F.array_compact(F.array(*(of_kind(k, p, h) for k, (p, h) in patterns.items()), seen)))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), "base", F.inline(found)).select(
        key, "line_no", "kind", "value", (F.col("base") + F.make_dt_interval(hours=F.col("hour"), mins=F.col("line_no"))).alias("ts")
    )


def graph_view(edges: DataFrame, vertices: DataFrame, first, last, least: float, k: int) -> DataFrame:
    """The ``k`` heaviest edges of a span of time: weak ones only where no strong one is left, ends known, organisations with two or more edges."""
    span = edges.filter(F.col("ts").between(first, last) & (F.col("src") != F.col("dst")))
    strong = span.filter(F.col("weight") >= least)
    counted = strong.agg(F.count(F.lit(1)).alias("n_strong"))  # one row
    shown = span.crossJoin(F.broadcast(counted)).filter((F.col("weight") >= least) | (F.col("n_strong") == 0)).drop("n_strong")
    ends = shown.select(F.explode(F.array("src", "dst")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    known = vertices.select("entity_id", "type").join(ends, "entity_id").filter("type <> 'ORGANIZATION' OR n >= 2").select("entity_id")
    kept = shown.join(known.select(F.col("entity_id").alias("src")), "src", "left_semi").join(known.select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    return kept.orderBy(F.desc("weight"), "edge_id").limit(k)
