"""Scoring of video segments against a parsed query: objects with attributes, events, text on screen, and fusion.

A query is a plain value (see ``parse_query``) that becomes column expressions, so scoring is one projection and one window per
video. Positions use the order of a video's segments.

Defined results: null lists are empty; a query without objects scores 0 for objects; a video of one segment has position 0;
ties are ordered by segment id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clock, plate_form, rescale

# Families of labels, colours, actions and the weights of the fusion.
FAMILIES = {
    "vehicle": ("vehicle", "car", "truck", "bus", "van", "motorcycle", "motorbike", "bike", "bicycle", "auto", "automobile", "suv", "jeep", "cab", "taxi"),
    "person": ("person", "people", "man", "woman", "individual", "pedestrian", "driver", "passenger", "occupant", "thief", "suspect", "criminal"),
    "license_plate": ("license_plate", "plate", "number_plate", "registration"),
}
COLOURS = ("black", "white", "red", "blue", "green", "silver", "yellow")
ACTIONS = {"arrive": ("arrive", "stop", "park"), "depart": ("depart", "leave", "drive off"), "walk": ("walk", "run", "move"), "enter": ("enter", "exit", "get in", "get out")}
WEIGHTS = {"visual": 0.35, "spoken": 0.35, "objects": 0.20, "screen": 0.10, "event": 0.25}
_PLATE = re.compile(r"\b[A-Z]{2}[ -]?\d{1,2}[ -]?[A-Z]{1,2}[ -]?\d{4}\b", re.I)


@dataclass(frozen=True)
class Query:
    text: str
    objects: tuple[tuple[str, tuple[str, ...]], ...] = ()
    actions: tuple[str, ...] = ()
    plates: tuple[str, ...] = ()
    words: tuple[str, ...] = field(default=())


def parse_query(text: str) -> Query:
    """Objects with the colours before them, actions, plates and other words of a question in plain English."""
    plates = tuple(dict.fromkeys(re.sub(r"[ -]", "", m).upper() for m in _PLATE.findall(text)))
    low = _PLATE.sub(" ", text).lower()
    words = re.findall(r"[a-z]+", low)
    objects, used, near = [], set(), []
    for w in words:
        family = next((f for f, names in FAMILIES.items() if f != "license_plate" and w.rstrip("s") in names), None)  # plates are read on screen
        if w in COLOURS:
            near.append(w)
            used.add(w)
        elif family:
            objects.append((family, tuple(near)))
            used.add(w)
            near = []
    actions = tuple(a for a, forms in ACTIONS.items() if any(re.search(rf"\b{re.escape(f)}", low) for f in forms))
    rest = tuple(dict.fromkeys(w for w in words if len(w) > 3 and w not in used))
    return Query(text, tuple(objects), actions, plates, rest)


def object_score(objects: Column, query: Query) -> Column:
    """Mean over the query's objects of 1 for label and attributes, 0.5 for the label alone, else 0."""
    if not query.objects:
        return F.lit(0.0)
    parts = []
    for family, attributes in query.objects:
        of_family = F.filter(F.coalesce(objects, F.array().cast("array<struct<label:string,confidence:double,attributes:array<string>>>")), lambda o: F.lower(o["label"]).isin(*FAMILIES[family]))
        wanted = F.array(*(F.lit(a) for a in attributes)).cast("array<string>")
        full = F.exists(of_family, lambda o: F.size(F.array_except(wanted, F.coalesce(o["attributes"], F.array().cast("array<string>")))) == 0)
        parts.append(F.when(full, 1.0).when(F.size(of_family) > 0, 0.5).otherwise(0.0))
    return sum(parts[1:], parts[0]) / len(parts)


def screen_score(ocr: Column, query: Query) -> Column:
    """1 when a plate of the query is read (look-alikes made equal), 0.5 when a word is, else 0."""
    read = F.coalesce(ocr, F.array().cast("array<string>"))
    plate = F.exists(read, lambda x: plate_form(x).isin(*(_plain_plate(p) for p in query.plates))) if query.plates else F.lit(False)
    word = F.exists(read, lambda x: F.lower(x).isin(*query.words)) if query.words else F.lit(False)
    return F.when(plate, 1.0).when(word, 0.5).otherwise(0.0)


def _plain_plate(plate: str) -> str:
    return plate.translate(str.maketrans("OQILZ", "00112"))


def event_scores(segments: DataFrame, query: Query) -> DataFrame:
    """Segments with ``event``: the first and last sighting of a vehicle count for arriving and leaving, others less, by their place among the sightings."""
    order = W.partitionBy("video_id").orderBy("start_ts", "segment_id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    labels = FAMILIES["vehicle"]
    vehicle = F.exists(F.coalesce("objects", F.array().cast("array<struct<label:string,confidence:double,attributes:array<string>>>")), lambda o: F.lower(o["label"]).isin(*labels))
    person = F.exists(F.coalesce("objects", F.array().cast("array<struct<label:string,confidence:double,attributes:array<string>>>")), lambda o: F.lower(o["label"]).isin(*FAMILIES["person"]))
    seen = segments.withColumns({"_v": vehicle, "_p": person})
    sighted = F.when(F.col("_v"), F.struct("start_ts", "segment_id"))
    marked = seen.withColumns({
        "_first": F.min(sighted).over(whole), "_last": F.max(sighted).over(whole),
        "_recent": F.max(F.col("_v").cast("int")).over(order.rowsBetween(-2, -1)),
    })
    here = F.struct("start_ts", "segment_id")
    marked = marked.withColumns({
        "_nv": F.sum(F.col("_v").cast("int")).over(whole), "_iv": F.sum(F.col("_v").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)),
        "_start": F.min(here).over(whole), "_lastp": F.max(F.when(F.col("_p"), here)).over(whole),
    })
    # the place of a sighting among all, from 0 to 1
    position = F.coalesce("_iv", F.lit(0)) / F.greatest(F.col("_nv") - 1, F.lit(1))
    parts = []
    if "arrive" in query.actions:
        parts.append(F.when(F.col("_v"), F.when(here == F.col("_first"), 1.0).otherwise(0.55)).when(here == F.col("_start"), 0.25).otherwise(0.0))
    if "depart" in query.actions:
        parts.append(F.when(F.col("_v"), F.when(here == F.col("_last"), 1.0).otherwise(0.35 + 0.45 * position)).when((F.col("_nv") == 0) & (here == F.col("_lastp")), 0.5).otherwise(0.0))
    if "walk" in query.actions:
        parts.append(F.when(F.col("_p"), 0.65).otherwise(0.0))
    if "enter" in query.actions:
        parts.append(F.when(F.col("_p") & F.col("_v"), 0.95).when(F.col("_p") & (F.col("_recent") == 1), 0.75).otherwise(0.0))
    event = F.greatest(*parts, F.lit(0.0)) if parts else F.lit(0.0)
    return marked.withColumn("event", F.round(F.coalesce(event, F.lit(0.0)), 3)).drop("_v", "_p", "_first", "_last", "_recent", "_nv", "_iv", "_start", "_lastp")


def search(segments: DataFrame, query: Query, k: int, visual: DataFrame | None = None, spoken: DataFrame | None = None) -> DataFrame:
    """The ``k`` best segments: ``video_id, segment_id, score`` and the parts.

    ``visual`` and ``spoken`` give ``embedding_id, score`` of the vector searches; what is missing there counts 0.
    """
    scored = event_scores(segments, query).withColumns({"objects_score": object_score(F.col("objects"), query), "screen": screen_score(F.col("ocr"), query)})
    for name, part, path, low, high in (("visual_score", visual, "visual.embedding_id", 0.10, 0.42), ("spoken_score", spoken, "audio.embedding_id", 0.10, 0.75)):
        if part is None:
            scored = scored.withColumn(name, F.lit(0.0))
        else:
            best = part.groupBy("embedding_id").agg(F.max("score").alias(name))
            scored = scored.withColumn("embedding_id", F.col(path)).join(best, "embedding_id", "left").withColumn(name, F.coalesce(rescale(F.col(name), low, high), F.lit(0.0))).drop("embedding_id")
    total = (
        WEIGHTS["visual"] * F.col("visual_score") + WEIGHTS["spoken"] * F.col("spoken_score") + WEIGHTS["objects"] * F.col("objects_score")
        + WEIGHTS["screen"] * F.col("screen") + WEIGHTS["event"] * F.col("event")
    )
    value = F.least(total, F.lit(1.0))
    if query.plates:
        value = F.when(F.col("screen") == 1, F.greatest(value, F.lit(0.85))).otherwise(value)
    ranked = scored.withColumn("score", F.round(value, 3)).filter("score > 0")
    return ranked.orderBy(F.desc("score"), "video_id", "segment_id").limit(k).select(
        "video_id", "segment_id", "start_ts", "end_ts", "score", "objects_score", "screen", "event", "visual_score", "spoken_score"
    )


def join_modalities(visual: DataFrame, audio: DataFrame, frames: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """Visual segments with the best overlapping transcript of their video, and the labels and texts of the frames in them.

    Times are seconds; cells of ten seconds index the intervals (see ``intervals``).
    """
    from ..functions.scalar import interval_iou
    from .intervals import overlap_join, points_in

    a = visual.select("video_id", "segment_id", "start_ts", "end_ts")
    met = overlap_join(a, audio.select("video_id", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"), "transcript"), "video_id", 10, "start_ts", "end_ts", "s", "e")
    iou = interval_iou(F.col("start_ts"), F.col("end_ts"), F.col("s"), F.col("e"))
    best = met.withColumn("iou", iou).filter(F.col("iou") >= least_iou).groupBy("video_id", "segment_id").agg(F.max_by("transcript", F.struct(F.col("iou"), (-F.col("s")).alias("x"))).alias("transcript"))
    inside = points_in(frames.select("video_id", F.col("ts").alias("at"), "labels", "texts"), a, "video_id", 10, "at", "start_ts", "end_ts")
    gathered = inside.groupBy("video_id", "segment_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("ocr")
    )
    return a.join(best, ["video_id", "segment_id"], "left").join(gathered, ["video_id", "segment_id"], "left")


def frame_records(frames: DataFrame) -> DataFrame:
    """``video_id, ts, labels, texts`` of frame rows: texts only of sharp frames (``sharp``), of two characters or more, each once in order."""
    read = F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.length(F.trim(t)) >= 2)
    return frames.select("video_id", "ts", F.array_distinct(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), F.when(F.col("sharp"), F.array_distinct(F.transform(read, lambda t: F.trim(t)))).otherwise(F.array().cast("array<string>")).alias("texts"))


def ingest(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """``(segments, failures)`` of the modalities ``visual``, ``audio`` and ``frames``, each of which may fail.

    A reader that raises gives an empty modality and its error by name; segments need the visual one.
    """
    schemas = {"visual": "video_id string, segment_id string, start_ts double, end_ts double", "audio": "video_id string, start_ts double, end_ts double, transcript string", "frames": "video_id string, ts double, labels array<string>, texts array<string>"}
    parts, failed = {}, {}
    for name, schema in schemas.items():
        try:
            part = readers[name]()
            part.limit(1).count()  # a broken source shows when it is read
        except Exception as e:  # noqa: BLE001
            part, failed[name] = spark.createDataFrame([], schema), f"{type(e).__name__}: {e}"[:200]
        parts[name] = part
    return join_modalities(parts["visual"], parts["audio"], parts["frames"]), failed


def shown(results: DataFrame) -> DataFrame:
    """Search results as lines to read: rank, span in minutes, score and how sure it is (high from 0.60, medium from 0.45)."""
    order = W.orderBy(F.desc("score"), "video_id", "segment_id")  # at most the k rows of a search
    band = F.when(F.col("score") >= 0.60, "HIGH").when(F.col("score") >= 0.45, "MEDIUM").otherwise("LOW")
    span = F.concat(clock(F.col("start_ts")), F.lit("-"), clock(F.col("end_ts")))
    return results.withColumn("place", F.row_number().over(order)).select("place", F.format_string("%d. %s %s score %.3f (%s)", "place", "video_id", span, "score", band).alias("line"))


def ask(segments: DataFrame, question: str, k: int = 5) -> DataFrame:
    """A question in plain English answered by the ``k`` best segments, as lines."""
    return shown(search(segments, parse_query(question), k))
