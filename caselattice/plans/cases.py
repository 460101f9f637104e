"""Queries over cases: filtered timelines, coverage and macro means, bundles, scoped search, mentions by gazetteer, bands, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import slug
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators.validation import RESULT_CHECKS, checked
from ..session import broadcast_if_small, cut
from ..sources.casedata import edges, vertices, with_tables
from ..tables import table
from .patterns import carriers, key_totals
from .temporal import _TIMELINE, timeline_union
from .texts import _ACCOUNTS, _FILES, _INDEX, _PHONES, _PLATES, _files

FIRST, LAST = "2025-10-15", "2025-11-15"


def match_keys(value):
    """Normalised forms of an id or name: lower case, what follows the last underscore, letters and digits alone, the last ten digits."""
    low = F.lower(F.trim(value))
    digits = F.regexp_replace(low, "[^0-9]", "")
    forms = F.array(low, F.regexp_extract(low, "_([^_]*)$", 1), F.regexp_replace(low, "[^a-z0-9]", ""), F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits))
    return F.array_distinct(F.filter(forms, lambda f: f != ""))


def timeline_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and transfers of the timeline between two days, both included."""
    day = F.to_date("ts")
    return timeline_union(spark, folder).filter(day.between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")) & F.col("kind").isin("call", "transaction")).select("ts", "kind", "actor", "target", "record")


def timeline_of_people(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the timeline whose actor or target is a phone or account of a subscriber, matched in normalised form."""
    people = table(spark, folder, "subscribers", "person_id", "phone", "account")
    known = people.select("person_id", F.explode(F.array_compact(F.array("phone", "account"))).alias("k")).select("person_id", F.explode(match_keys(F.col("k"))).alias("k")).distinct()
    seats = timeline_union(spark, folder).filter("kind <> 'filing'").select("record", "kind", F.explode(F.array_distinct(F.array_compact(F.array("actor", "target")))).alias("who"))
    return seats.select("record", "kind", F.explode(match_keys(F.col("who"))).alias("k")).join(broadcast_if_small(known), "k").groupBy("person_id", "kind").agg(F.countDistinct("record").alias("n_events"))


def entity_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred entities, persons before all others, then by name."""
    rows = vertices(spark, folder).withColumn("low", F.lower(F.coalesce("name", F.lit(""))))
    return rows.orderBy(F.col("type") != "PERSON", "low", "entity_id").limit(100).select("entity_id", "type", "name")


def relevant_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Of the five nearest rows of each query row those of a similarity of a quarter or more, the row itself never among them."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return R.vector_topk(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding", 5).filter("score >= 0.25")


def _ranking(spark, folder):
    return table(spark, folder, "top3_results", "result_id", "case_key", "rank_no", "entity_id", "risk_score", "evidence_file", "evidence_line", "text_snippet").dropDuplicates(["result_id"])


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cases whose entity of highest risk is among the first three ranks."""
    rows = _ranking(spark, folder).filter("case_key IS NOT NULL AND entity_id IS NOT NULL")
    best = rows.groupBy("case_key").agg(F.max(F.struct("risk_score", "entity_id")).alias("b")).select("case_key", F.col("b.entity_id").alias("entity_id"))
    return M.hit_rate(rows, best, "case_key", "entity_id", "rank_no", 3)


def macro_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over cases of their mean risk and share of rows with a snippet; cases without a risk are errors and skipped."""
    per = _ranking(spark, folder).filter("case_key IS NOT NULL").groupBy("case_key").agg(F.avg("risk_score").alias("risk"), F.avg(F.col("text_snippet").isNotNull().cast("int")).alias("shown"))
    return M.macro_mean(per.withColumn("error", F.when(F.col("risk").isNull(), "no_risk")), ["risk", "shown"])


def evidence_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per case the worst quality of its evidence rows: low when any has no snippet."""
    rows = _ranking(spark, folder).filter("case_key IS NOT NULL").withColumn("flag", F.when(F.col("text_snippet").isNull(), "low").otherwise("ok"))
    return M.worst_quality(rows, "case_key", "flag")


def invalid_results(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking rows that fail a check, with the checks."""
    return checked(_ranking(spark, folder), RESULT_CHECKS)[1].select("result_id", "errors")


def case_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Per case its evidence ids in rank order (at most ten) and how many rows it has, for a prompt."""
    order = W.partitionBy("case_key").orderBy("rank_no", "result_id")
    rows = _ranking(spark, folder).filter("case_key IS NOT NULL").withColumn("place", F.row_number().over(order))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 10, F.struct("place", F.concat_ws(":L", "evidence_file", "evidence_line").alias("id"))))), lambda x: x["id"]), ",")
    return rows.groupBy("case_key").agg(F.count(F.lit(1)).alias("n_rows"), ids.alias("evidence_ids"))


def flagged_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Per flagged carrier its flags, all its edges and all its neighbours, the strongest first, and how many it has."""
    kept = cut(G.build(edges(spark, folder), vertices(spark, folder))[0])
    ends = kept.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id"), "edge_id")
    n_edges = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("edge_id")), ",").alias("edges"))
    near = G.strongest_neighbours(kept).groupBy(F.col("node").alias("entity_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]), ",").alias("neighbours"), F.count(F.lit(1)).alias("n_neighbours")
    )
    marked = key_totals(spark, folder).join(carriers(spark, folder), "key").select("entity_id", "key", "flags", "n_flags")
    return marked.join(n_edges, "entity_id", "left").join(near, "entity_id", "left").select(
        "entity_id", "key", "flags", "n_flags", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "edges", F.coalesce("neighbours", F.lit("")).alias("neighbours"), F.coalesce("n_neighbours", F.lit(0)).cast("long").alias("n_neighbours"),
    )


SCOPE = "FIR"


def scoped_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search inside one kind of document: others are left out before scoring, so they neither appear nor weigh."""
    docs = table(spark, folder, "documents", "doc_id", "text", "doc_type").filter(F.col("doc_type") == SCOPE)
    return R.keyword_search(R.term_index(docs, "doc_id", "text"), "doc_id", ["account", "cash", "ledger", "mobile", "witness"], 20)


def gazetteer_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """All mentions of the case files by pattern, and the subscribers known by a phone or account in them: type, id and documents."""
    c = F.col("text")
    of = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("type"), F.upper(x).alias("value")))
    found = cut(_files(spark, folder).select("doc_key", F.inline(F.array_distinct(F.concat(of("PHONE", T.found(c, T.PHONE)), of("VEHICLE", T.found(c, T.PLATE)), of("ACCOUNT", T.accounts(c)))))))
    people = table(spark, folder, "subscribers", "full_name", "phone", "account").filter("full_name IS NOT NULL")
    known = people.select(F.col("full_name").alias("name"), F.explode(F.array_compact(F.array("phone", "account"))).alias("value")).distinct()
    persons = found.filter("type IN ('PHONE', 'ACCOUNT')").join(broadcast_if_small(known), "value").select("doc_key", F.lit("PERSON").alias("type"), F.col("name").alias("value"))
    rows = found.select("doc_key", "type", "value").unionByName(persons).distinct()
    return rows.groupBy("type", "value").agg(F.countDistinct("doc_key").alias("n_docs")).select(F.concat(F.lower("type"), F.lit("_"), slug(F.col("value"))).alias("id"), "type", "value", "n_docs")


def review_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking rows with a confidence band (high from 0.60, medium from 0.45) and whether a person must look (below 0.5)."""
    share = F.col("risk_score") / 100
    band = F.when(share >= 0.60, "HIGH").when(share >= 0.45, "MEDIUM").otherwise("LOW")
    return _ranking(spark, folder).select("result_id", band.alias("band"), (F.coalesce(share, F.lit(0.0)) < 0.5).alias("requires_review"))


QUERIES = {
    f.__name__: f
    for f in (
        timeline_filtered, timeline_of_people, entity_list, relevant_neighbours, coverage, macro_scores, evidence_quality, invalid_results, case_evidence, flagged_bundles, scoped_search,
        gazetteer_mentions, review_routes,
    )
}

_ROWS = "ranking AS (SELECT DISTINCT ON (result_id) * FROM top3_results)"
_KEYS = """list_distinct(list_filter([lower(trim({0})), regexp_extract(lower(trim({0})), '_([^_]*)$', 1), regexp_replace(lower(trim({0})), '[^a-z0-9]', '', 'g'),
  CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace({0}, '[^0-9]', '', 'g'), 10) ELSE regexp_replace({0}, '[^0-9]', '', 'g') END], lambda f: f <> ''))"""
ORACLE = {
    "timeline_filtered": with_tables("calls", "transfers", more=_TIMELINE) + f"SELECT ts, kind, actor, target, record FROM timeline WHERE CAST(ts AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND kind IN ('call', 'transaction')",
    "timeline_of_people": with_tables("calls", "transfers", more=_TIMELINE + f""",
      known AS (SELECT DISTINCT person_id, unnest({_KEYS.format('k')}) AS k FROM (SELECT person_id, phone AS k FROM subscribers WHERE phone IS NOT NULL UNION SELECT person_id, account FROM subscribers WHERE account IS NOT NULL)),
      seats AS (SELECT record, kind, unnest({_KEYS.format('who')}) AS k FROM (SELECT record, kind, actor AS who FROM timeline WHERE kind <> 'filing' AND actor IS NOT NULL UNION SELECT record, kind, target FROM timeline WHERE kind <> 'filing' AND target IS NOT NULL))""")
    + "SELECT person_id, kind, count(DISTINCT record) AS n_events FROM seats JOIN known USING (k) GROUP BY 1, 2",
    "entity_list": with_tables("vertices") + "SELECT entity_id, type, name FROM vertices ORDER BY type <> 'PERSON', lower(coalesce(name, '')), entity_id LIMIT 100",
    "relevant_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT query_id, row_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (
      SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_cosine_similarity(q.e, r.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 9) DESC, r.vec_id) AS place
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE place <= 5 AND round(score, 6) >= 0.25""",
    "coverage": f"""WITH {_ROWS}, r AS (SELECT * FROM ranking WHERE case_key IS NOT NULL AND entity_id IS NOT NULL), b AS (SELECT case_key, arg_max(entity_id, (risk_score, entity_id)) AS entity_id FROM (SELECT case_key, entity_id, coalesce(risk_score, -1) AS risk_score FROM r) GROUP BY 1)
      SELECT count(*) AS n_groups, CAST(sum(h) AS BIGINT) AS n_hits, round(coalesce(avg(h), 0.0), 4) AS coverage FROM (SELECT b.case_key, max(CASE WHEN r.rank_no <= 3 THEN 1 ELSE 0 END) AS h FROM b LEFT JOIN r ON r.case_key = b.case_key AND r.entity_id = b.entity_id GROUP BY 1)""",
    "macro_scores": f"""WITH {_ROWS}, per AS (SELECT case_key, avg(risk_score) AS risk, avg(CASE WHEN text_snippet IS NOT NULL THEN 1 ELSE 0 END) AS shown FROM ranking WHERE case_key IS NOT NULL GROUP BY 1)
      SELECT count(*) AS n_cases, count(risk) AS n_valid, round(coalesce(avg(risk), 0.0), 4) AS mean_risk, round(coalesce(avg(CASE WHEN risk IS NOT NULL THEN shown END), 0.0), 4) AS mean_shown FROM per""",
    "evidence_quality": f"WITH {_ROWS} SELECT case_key, CASE WHEN bool_or(text_snippet IS NULL) THEN 'low' ELSE 'ok' END AS quality FROM ranking WHERE case_key IS NOT NULL GROUP BY 1",
    "invalid_results": f"""WITH {_ROWS} SELECT * FROM (SELECT result_id, concat_ws(',', CASE WHEN NOT coalesce(rank_no >= 1, false) THEN 'rank_no' END, CASE WHEN NOT coalesce(risk_score BETWEEN 0 AND 100, false) THEN 'risk_score' END,
      CASE WHEN NOT coalesce(trim(entity_id) <> '', false) THEN 'entity_id' END, CASE WHEN NOT coalesce(evidence_line >= 1, false) THEN 'evidence_line' END, CASE WHEN NOT coalesce(trim(text_snippet) <> '', false) THEN 'text_snippet' END) AS errors FROM ranking) WHERE errors <> ''""",
    "case_evidence": f"""WITH {_ROWS} SELECT case_key, count(*) AS n_rows, string_agg(concat_ws(':L', evidence_file, evidence_line), ',' ORDER BY place) FILTER (WHERE place <= 10) AS evidence_ids
      FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY rank_no NULLS FIRST, result_id) AS place FROM ranking WHERE case_key IS NOT NULL) GROUP BY 1""",
    "scoped_search": f"WITH {_INDEX.replace('FROM documents)', chr(70) + 'ROM documents WHERE doc_type = ' + chr(39) + 'FIR' + chr(39) + ')')} SELECT doc_id, round(sum(tf), 6) AS score, count(*) AS n_words FROM idx WHERE token IN ('account', 'cash', 'ledger', 'mobile', 'witness') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20",
    "gazetteer_mentions": _FILES.rstrip() + f""", found AS (SELECT DISTINCT doc_key, type, value FROM (SELECT doc_key, 'PHONE' AS type, unnest({_PHONES}) AS value FROM files UNION ALL SELECT doc_key, 'VEHICLE', unnest({_PLATES}) FROM files
        UNION ALL SELECT doc_key, 'ACCOUNT', upper(unnest({_ACCOUNTS})) FROM files)),
      known AS (SELECT DISTINCT full_name AS name, phone AS value FROM subscribers WHERE phone IS NOT NULL UNION SELECT full_name, account FROM subscribers WHERE account IS NOT NULL),
      r AS (SELECT * FROM found UNION SELECT doc_key, 'PERSON', name FROM found JOIN known USING (value) WHERE type IN ('PHONE', 'ACCOUNT') AND name IS NOT NULL)
      SELECT lower(type) || '_' || regexp_replace(lower(trim(value)), '[^a-z0-9]+', '_', 'g') AS id, type, value, count(DISTINCT doc_key) AS n_docs FROM r GROUP BY type, value""",
    "review_routes": f"WITH {_ROWS} SELECT result_id, CASE WHEN risk_score / 100 >= 0.60 THEN 'HIGH' WHEN risk_score / 100 >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS band, coalesce(risk_score / 100, 0.0) < 0.5 AS requires_review FROM ranking",
}
