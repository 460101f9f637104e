"""Queries of entity buckets, resolution, merges, validation, measures and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import resolve as E
from ..operators import segments as G
from ..operators.rolling import micros
from ..operators.validation import ENTITY_CHECKS, checked
from ..sources.casedata import calls, transfers, vertices, with_tables
from ..tables import table


def entity_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of one type and canonical name: rows, documents and the highest confidence."""
    rows = vertices(spark, folder).select(
        "type", F.trim(F.lower(F.regexp_replace("name", r"\s+", " "))).alias("text"), F.explode_outer("source_documents").alias("doc"), F.lit("list").alias("method"), "confidence"
    )
    return E.buckets(rows).select("type", "text", "n_mentions", F.size("docs").cast("long").alias("n_docs"), "confidence")


def fuzzy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Names of every type resolved within their circle (rows without one among themselves): entities, forms and mentions."""
    rows = table(spark, folder, "entities", "entity_id", "type", "name", "circle").filter("name IS NOT NULL").withColumn("circle", F.coalesce("circle", F.lit("")))
    forms = rows.groupBy("type", "circle", F.col("name").alias("text")).agg(F.count(F.lit(1)).alias("n_mentions"))
    return E.resolve(forms, "circle").groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n_mentions").alias("n_mentions"), F.first("name").alias("name"))


def cross_type_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities", "entity_id", "type", "name", "circle").filter("circle IS NOT NULL").distinct()
    return E.across_types(rows, "circle")


def confidence_score(spark: SparkSession, folder: str) -> DataFrame:
    v = vertices(spark, folder)
    rows = v.select("entity_id", F.col("confidence").alias("base"), F.array(F.lit("table")).alias("methods"), F.coalesce(F.size("source_documents"), F.lit(0)).alias("n_docs"), F.coalesce(F.size("aliases"), F.lit(0)).alias("n_aliases"))
    return E.confidence(rows).select("entity_id", "confidence", "needs_review")


def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Entities loaded before November merged with those loaded later."""
    rows = table(spark, folder, "entities", "entity_id", "type", "name", "source_documents", "loaded_at")
    early = F.col("loaded_at") < F.lit("2025-11-01").cast("timestamp_ntz")
    merged = E.merge_incrementally(rows.filter(early), rows.filter(~early | F.col("loaded_at").isNull()), "entity_id", ["source_documents"], ["type", "name"])
    return merged.select("entity_id", "type", "name", F.array_join("source_documents", ",").alias("docs"))


def name_search(spark: SparkSession, folder: str) -> DataFrame:
    return E.search_names(vertices(spark, folder), "Textile Works", 0.9)


def invalid_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of entities that fail a check, with the failed checks."""
    rows = table(spark, folder, "entities", "entity_id", "type", "name", "confidence", "circle")
    return checked(rows, ENTITY_CHECKS)[1].select("entity_id", "errors").distinct()


def segment_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivered row of every call (copies carry a later load time), as an upsert by key."""
    rows = table(spark, folder, "cdr", "cdr_id", "loaded_at", "duration_seconds")
    return rows.groupBy("cdr_id").agg(F.max_by("duration_seconds", "loaded_at").alias("duration_seconds"), F.max("loaded_at").alias("loaded_at"))


def label_prf(spark: SparkSession, folder: str) -> DataFrame:
    """How well a script rule finds the language of the labelled samples, per language."""
    rows = table(spark, folder, "lang_samples", "sample_id", "lang", "text").filter("lang IN ('th', 'ta', 'bn', 'ur', 'ja', 'zh')")
    script = (
        F.when(F.col("text").rlike("[฀-๿]"), "th").when(F.col("text").rlike("[஀-௿]"), "ta").when(F.col("text").rlike("[ঀ-৿]"), "bn")
        .when(F.col("text").rlike("[؀-ۿ]"), "ur").when(F.col("text").rlike("[ぁ-ヿ]"), "ja").otherwise("zh")
    )
    return M.prf(rows.select("sample_id", script.alias("lang")), rows.select("sample_id", "lang"), ["sample_id"], "lang")


def amount_auc(spark: SparkSession, folder: str) -> DataFrame:
    """How well the amount tells the remark ``Advance`` from others."""
    rows = table(spark, folder, "bank_transactions", "amount_inr", "remarks").select(F.col("amount_inr").alias("score"), (F.lower(F.trim("remarks")) == "advance").alias("hit"))
    return M.auc(rows, "score", "hit")


def precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Per case the share of its three riskiest ranking rows that carry a snippet."""
    rows = table(spark, folder, "top3_results", "result_id", "case_key", "risk_score", "text_snippet").filter("case_key IS NOT NULL").groupBy("result_id").agg(
        F.min("case_key").alias("case_key"), F.min("risk_score").alias("risk_score"), F.max(F.col("text_snippet").isNotNull().cast("int")).alias("hit")
    )
    return M.precision_at(rows, "case_key", "risk_score", "hit", "result_id", 3)


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return M.percentiles(table(spark, folder, "events", "event_type", "value"), "event_type", "value")


def acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of usable rows in the calls and transfers against limits."""
    c, t = table(spark, folder, "cdr", "caller"), table(spark, folder, "bank_transactions", "source_account")
    measured = c.agg(F.round(F.avg(F.col("caller").isNotNull().cast("int")), 6).alias("value")).select(F.lit("caller_known").alias("metric"), "value").unionByName(
        t.agg(F.round(F.avg(F.col("source_account").isNotNull().cast("int")), 6).alias("value")).select(F.lit("account_known").alias("metric"), "value")
    )
    limits = spark.createDataFrame([("caller_known", ">=", 0.99), ("account_known", ">=", 0.99), ("absent", "<=", 1.0)], "metric string, op string, threshold double")
    return M.acceptance(measured, limits)


def outputs_agree(spark: SparkSession, folder: str) -> DataFrame:
    """Two ways of counting calls per caller give the same rows."""
    c = calls(spark, folder)
    return M.same_outputs(c.groupBy("caller").count(), c.groupBy("caller", "callee").count().groupBy("caller").agg(F.sum("count").alias("count")))


def greedy_merge_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of a caller merged into turns of at most an hour."""
    start = micros(F.col("ts")) / 1_000_000
    timed = calls(spark, folder).select("caller", "call_id", start.alias("start"), (start + F.coalesce("duration_s", F.lit(0))).alias("end"))
    return G.merge_turns(timed, "caller", "start", "end", "call_id", 3600.0)


def label_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers of an account cut into segments by the words of their remarks."""
    t = transfers(spark, folder).filter("src IS NOT NULL").select("src", "txn_id", (micros(F.col("ts")) / 1_000_000).alias("at"), F.array_distinct(F.split(F.lower(F.coalesce("remarks", F.lit(""))), " ")).alias("labels"))
    return G.label_segments(t, "src", "at", "labels", "txn_id", 0.5, 86_400.0)


def vector_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of a label, in order of id, cut where the direction changes."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label").withColumn("at", F.col("vec_id").cast("double"))
    return G.vector_segments(rows, "label", "at", "embedding", "vec_id", 0.1, 50.0)


def throttled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user that pass a throttle of one per two hours."""
    rows = table(spark, folder, "events", "event_id", "user_id", "ts").withColumn("at", micros(F.col("ts")) / 1_000_000)
    return G.throttled(rows, "user_id", "at", "event_id", 7200.0)


QUERIES = {
    f.__name__: f
    for f in (
        entity_bucket, fuzzy_dedup, cross_type_dedup, confidence_score, incremental_merge, name_search, invalid_entities, segment_upsert, label_prf, amount_auc, precision_at_k,
        latency_percentiles, acceptance, outputs_agree, greedy_merge_turns, label_segmentation, vector_segmentation, throttled_events,
    )
}

ORACLE = {
    "entity_bucket": with_tables("vertices") + r"""SELECT type, text, count(*) AS n_mentions, count(DISTINCT doc) AS n_docs, max(confidence) AS confidence FROM (
      SELECT type, trim(lower(regexp_replace(name, '\s+', ' ', 'g'))) AS text, confidence, unnest(CASE WHEN len(source_documents) > 0 THEN source_documents ELSE [NULL] END) AS doc FROM vertices) WHERE text <> '' GROUP BY 1, 2""",
    "confidence_score": with_tables("vertices") + """SELECT entity_id, c AS confidence, c < 0.45 AS needs_review FROM (SELECT entity_id, CAST(round(CAST(least(greatest(0.75 * confidence
      + least(0.02 * greatest(coalesce(len(source_documents), 0) - 1, 0), 0.10) + least(0.01 * greatest(coalesce(len(aliases), 0) - 1, 0), 0.05), 0.0), 1.0) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS c FROM vertices)""",
    "incremental_merge": """WITH r AS (SELECT entity_id, type, name, source_documents AS d, coalesce(loaded_at < TIMESTAMP '2025-11-01', false) AS early FROM entities)
      SELECT entity_id, coalesce(min(type) FILTER (WHERE early), min(type) FILTER (WHERE NOT early)) AS type, coalesce(min(name) FILTER (WHERE early), min(name) FILTER (WHERE NOT early)) AS name,
      array_to_string(list_sort(list_distinct(flatten(list(coalesce(d, []))))), ',') AS docs FROM r GROUP BY 1""",
    "invalid_entities": """SELECT DISTINCT entity_id, errors FROM (SELECT entity_id, concat_ws(',', CASE WHEN coalesce(trim(name), '') = '' THEN 'name' END,
      CASE WHEN coalesce(type, '') NOT IN ('PERSON', 'PHONE', 'VEHICLE', 'LOCATION', 'ORGANIZATION', 'ACCOUNT', 'CASE', 'DATE') THEN 'type' END,
      CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN circle IS NULL THEN 'circle' END) AS errors FROM entities) WHERE errors <> ''""",
    "segment_upsert": "SELECT cdr_id, arg_max_null(duration_seconds, loaded_at) AS duration_seconds, max(loaded_at) AS loaded_at FROM cdr GROUP BY 1",
    "label_prf": """WITH f AS (SELECT sample_id, lang AS truth, CASE WHEN regexp_matches(text, '[฀-๿]') THEN 'th' WHEN regexp_matches(text, '[஀-௿]') THEN 'ta' WHEN regexp_matches(text, '[ঀ-৿]') THEN 'bn'
        WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ur' WHEN regexp_matches(text, '[ぁ-ヿ]') THEN 'ja' ELSE 'zh' END AS guess FROM lang_samples WHERE lang IN ('th', 'ta', 'bn', 'ur', 'ja', 'zh')),
      l AS (SELECT DISTINCT truth AS lang FROM f UNION SELECT DISTINCT guess FROM f),
      c AS (SELECT lang, count(*) FILTER (WHERE truth = lang AND guess = lang) AS tp, count(*) FILTER (WHERE guess = lang AND truth <> lang) AS fp, count(*) FILTER (WHERE truth = lang AND guess <> lang) AS fn FROM l, f GROUP BY 1)
      SELECT lang, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c""",
    "amount_auc": """WITH r AS (SELECT amount_inr AS s, lower(trim(remarks)) = 'advance' AS p FROM bank_transactions WHERE amount_inr IS NOT NULL AND remarks IS NOT NULL), k AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r)
      SELECT count(*) FILTER (WHERE p) AS n_pos, count(*) FILTER (WHERE NOT p) AS n_neg, round((sum(rk) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 6) AS auc FROM k""",
    "precision_at_k": """SELECT case_key, round(avg(hit), 6) AS precision, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY risk_score DESC, result_id) AS k FROM (
      SELECT result_id, min(case_key) AS case_key, min(risk_score) AS risk_score, max(CASE WHEN text_snippet IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM top3_results WHERE case_key IS NOT NULL GROUP BY 1)) WHERE k <= 3 GROUP BY 1""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "acceptance": """WITH m AS (SELECT 'caller_known' AS metric, round(avg(CASE WHEN caller IS NOT NULL THEN 1 ELSE 0 END), 6) AS value FROM cdr UNION ALL SELECT 'account_known', round(avg(CASE WHEN source_account IS NOT NULL THEN 1 ELSE 0 END), 6) FROM bank_transactions),
      l(metric, op, threshold) AS (VALUES ('caller_known', '>=', 0.99::DOUBLE), ('account_known', '>=', 0.99::DOUBLE), ('absent', '<=', 1.0::DOUBLE))
      SELECT metric, value, op, threshold, coalesce(CASE op WHEN '>=' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM l LEFT JOIN m USING (metric)""",
    "outputs_agree": with_tables("calls") + "SELECT count(*) AS n_rows, true AS same FROM (SELECT caller, count(*) FROM calls GROUP BY 1)",
    "greedy_merge_turns": with_tables("calls", more="""timed AS (SELECT caller, call_id, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + coalesce(duration_s, 0) AS e, row_number() OVER (PARTITION BY caller ORDER BY ts, call_id) AS k FROM calls WHERE caller IS NOT NULL),
      turn(caller, k, first, e) AS (SELECT caller, k, s, e FROM timed WHERE k = 1
        UNION ALL SELECT t.caller, t.k, CASE WHEN t.e - r.first <= 3600 THEN r.first ELSE t.s END, t.e FROM turn r JOIN timed t ON t.caller = r.caller AND t.k = r.k + 1)""")
    + "SELECT caller, CAST(first AS DOUBLE) AS first, CAST(max(e) AS DOUBLE) AS last, count(*) AS n_rows FROM turn GROUP BY caller, first",
    "throttled_events": """WITH RECURSIVE timed AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      pass(user_id, event_id, t, k, last, passed) AS (SELECT user_id, event_id, t, k, t, true FROM timed WHERE k = 1
        UNION ALL SELECT n.user_id, n.event_id, n.t, n.k, CASE WHEN n.t - p.last >= 7200 THEN n.t ELSE p.last END, n.t - p.last >= 7200 FROM pass p JOIN timed n ON n.user_id = p.user_id AND n.k = p.k + 1)
      SELECT user_id, event_id, CAST(t AS DOUBLE) AS "at" FROM pass WHERE passed""",
}
