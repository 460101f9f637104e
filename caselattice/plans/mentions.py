"""Queries of cleaned mentions, timelines from text and the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mentions as M
from ..sources.casedata import edges, vertices, with_tables
from ..tables import table

FIRST, LAST = "2025-10-15", "2025-11-15"


def junk_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that are none by their own text, and why."""
    v = vertices(spark, folder)
    return v.select("entity_id", M.junk_reason(F.col("type"), F.col("name")).alias("reason")).filter("reason IS NOT NULL")


def places_taken(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by type after places taken for persons or organisations were put right."""
    rows = vertices(spark, folder).select(F.col("entity_id"), "type", F.col("name").alias("text"), "confidence")
    return M.places(rows).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def text_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts (from nine o'clock), phones (ten) and incidents (eleven) of the case files as events on the day of loading, a minute per line."""
    files = table(spark, folder, "case_files", "doc_key", "clean_text", "loaded_at").groupBy("doc_key").agg(F.min("clean_text").alias("text"), F.min("loaded_at").alias("loaded_at"))
    base = F.date_trunc("day", F.col("loaded_at")).cast("timestamp_ntz")
    return M.text_timeline(files, "doc_key", "text", base, {"transaction": (T.ACCOUNT, 9), "call": (T.PHONE, 10)}, M.INCIDENT)


def graph_view(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return M.graph_view(edges(spark, folder), vertices(spark, folder), at(FIRST), at(LAST), 0.5, 300).select("edge_id", "src", "dst", "weight")


QUERIES = {f.__name__: f for f in (junk_entities, places_taken, text_timeline, graph_view)}

_STOPPED = """'ke','ka','ki','ko','se','ne','mein','par','tak','ke liye','maine','humein','hume','mujhe','uska','uski','unka','unki','woh','yeh','ye','jo','jiska','jis','jisme','koi','kuch','apna','apni','apne',
  'hai','hain','tha','thi','the','hoga','hua','hui','hue','raha','rahi','rahe','gaya','gayi','gaye','kiya','kara','bataya','bola','mila','milega','lagaya','chalaya','utha','diya','diye','dikha',
  'aur','ya','lekin','ab','na','hi','bhi','to','jab','tab','toh','phir','naam','vyakti','dwara','paisa','rupaye','phone','return','lakh','mahine','scheme','milkar','saath','dosto','wapas','mil','double'"""
_EXACT = """'psychological','communications','timeline','authorship','network graph','identity','relationship','possible','physical','who','family','documentary','hypothesis','document','location','evidence',
  'activity','organization','person','vehicle','account','date','information','fir','si','na','bank','shakti','anita','vikram','ipc','detail records','call detail records'"""
_PARTS = "case no|police station|reporting officer|first information|under section|ipc|crpc|ps 26152|evidence database|activity database|initial fir|network graph|detail records"
_TECH = "'dashboard','search','graph','export','review','pipeline','upload','extract','system','engine','module','analysis','workflow','documentation','centrality','detection','nlp','llm','rag','ui','streamlit','scorer','normalizer','langgraph','players','interactive','csv','pdf','louvain','community'"
_LEGIT = "'board','center','group','department','association','company','inc','ltd','corp','agency','council','commission','force','police','bank','hospital','school','university','court','station','ministry'"
_SUFFIXES = "'nagar','colony','vihar','puram','enclave','basti','ganj','pura','layout','extension','bagh','kunj','garden','gardens','marg','road','lane','avenue','path','chowk','crossing','square','market','bazaar','bazaars','area','block','phase','pocket','zone','west','east','north','south'"
ORACLE = {
    "junk_entities": with_tables("vertices", more=rf"""w AS (SELECT *, trim(name) AS t, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS low, regexp_replace(name, '[^0-9]', '', 'g') AS d, upper(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')) AS v FROM vertices),
      x AS (SELECT *, regexp_extract_all(low, '[\p{{L}}\p{{N}}\p{{M}}_\x27]+') AS ws, list_filter(string_split_regex(trim(regexp_replace(low, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')), '\s+'), lambda y: y <> '') AS bare, regexp_replace(d, '^(?:0*91|0+)([0-9]{{10}})$', '\1') AS p FROM w),
      r AS (SELECT *, len(list_filter(ws, lambda y: y IN ({_STOPPED}))) AS n_stop FROM x)""")
    + rf"""SELECT * FROM (SELECT entity_id, CASE WHEN name IS NULL OR t = '' THEN 'empty' WHEN type = 'PHONE' THEN CASE WHEN NOT regexp_matches(p, '^[6-9][0-9]{{9}}$') THEN 'phone' END
      WHEN type = 'VEHICLE' THEN CASE WHEN NOT regexp_matches(v, '^[A-Z]{{2}}[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4}}$') THEN 'plate' END
      WHEN type = 'DATE' THEN CASE WHEN regexp_matches(t, '^[0-9]{{4}}$') AND CAST(t AS INTEGER) NOT BETWEEN 1900 AND 2099 THEN 'number' WHEN regexp_matches(t, '(?i)^between\s+[0-9]') OR regexp_matches(t, '^[0-9]{{1,2}}:[0-9]{{2}}$') THEN 'time' END
      WHEN type NOT IN ('PERSON', 'ORGANIZATION', 'LOCATION') THEN NULL WHEN length(low) < 2 THEN 'short' WHEN regexp_matches(low, '^[0-9]+$') THEN 'number' WHEN low IN ({_EXACT}) OR regexp_matches(low, '{_PARTS}') THEN 'term'
      WHEN type = 'LOCATION' AND regexp_matches(low, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'date' WHEN regexp_matches(low, '^[0-9]{{1,2}}:[0-9]{{2}}$') THEN 'time'
      WHEN len(ws) > 0 AND (n_stop = len(ws) OR (len(ws) >= 2 AND len(ws) - n_stop <= 1 AND n_stop >= 1)) THEN 'fragment'
      WHEN len(bare) <= 7 AND len(list_filter(bare, lambda y: y IN ({_TECH}))) > 0 AND len(list_filter(bare, lambda y: y IN ({_LEGIT}))) = 0 THEN 'technical' WHEN regexp_matches(low, '[,:]$') THEN 'dangling'
      WHEN regexp_matches(low, '^[a-z]{{2,4}}\s?[0-9]{{3,6}}$') THEN 'code' WHEN (length(low) - length(replace(low, chr(34), ''))) % 2 = 1 OR (length(low) - length(replace(low, chr(39), ''))) % 2 = 1 THEN 'quote'
      WHEN low IN ('the','a','an','this','that','entity','name','id','entity_id','entity_ids','none','null','undefined') THEN 'word' END AS reason FROM r) WHERE reason IS NOT NULL""",
    "places_taken": with_tables("vertices", more=rf"""w AS (SELECT *, list_filter(string_split_regex(trim(regexp_replace(coalesce(name, ''), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')), '\s+'), lambda x: x <> '') AS ws FROM vertices),
      p AS (SELECT *, type IN ('PERSON', 'ORGANIZATION') AND len(ws) >= 2 AND NOT regexp_matches(coalesce(name, ''), '\b(SI|ACP|DCP|SHO|Public|Private|Ltd|Inc)\b')
        AND (lower(ws[-1]) IN ({_SUFFIXES}, 'sector') OR (lower(ws[-2]) = 'sector' AND regexp_matches(ws[-1], '^[0-9]+$'))) AS wrong FROM w)""")
    + "SELECT CASE WHEN wrong THEN 'LOCATION' ELSE type END AS type, count(*) AS n, round(avg(CASE WHEN wrong THEN least(confidence, 0.72) ELSE confidence END), 6) AS mean_confidence FROM p GROUP BY 1",
    "text_timeline": r"""WITH files AS (SELECT doc_key, min(clean_text) AS text, date_trunc('day', min(loaded_at)) AS base FROM case_files GROUP BY 1),
      lines AS (SELECT doc_key, base, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM files)),
      wide AS (SELECT *, '  ' || regexp_replace(line, '[^\p{L}\p{N}_]', '  ', 'g') || '  ' AS w, regexp_replace(line, '([^0-9])', '\1\1', 'g') AS d FROM lines),
      hits AS (SELECT DISTINCT doc_key, base, line_no, 'transaction' AS kind, 9 AS hour, upper(unnest(regexp_extract_all(w, '(?i) (ACC[0-9]{5}|ACC_[a-f0-9]{8}) ', 1))) AS value FROM wide
        UNION SELECT doc_key, base, line_no, 'call', 10, unnest(regexp_extract_all(d, '(?:^|[^0-9])(?:\+91(?:[-.\s]{2})?|0)?([6-9][0-9]{9})(?:[^0-9]|$)', 1)) FROM wide
        UNION SELECT doc_key, base, line_no, 'incident', 11, 'line ' || line_no FROM wide WHERE regexp_matches(w, '(?i) (incident|robbery|theft|assault|accident|murder|fraud|attack) '))
      SELECT doc_key, CAST(line_no AS INTEGER) AS line_no, kind, value, CAST(base AS TIMESTAMP) + hour * INTERVAL 1 HOUR + line_no * INTERVAL 1 MINUTE AS ts FROM hits""",
    "graph_view": with_tables("vertices", "edge_rows", more=f"""span AS (SELECT * FROM edge_rows WHERE ts BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}' AND src <> dst),
      shown AS (SELECT * FROM span WHERE weight >= 0.5 OR (SELECT count(*) FROM span WHERE weight >= 0.5) = 0),
      ends AS (SELECT entity_id, count(*) AS n FROM (SELECT src AS entity_id FROM shown UNION ALL SELECT dst FROM shown) GROUP BY 1), known AS (SELECT entity_id FROM vertices JOIN ends USING (entity_id) WHERE type <> 'ORGANIZATION' OR n >= 2)""")
    + "SELECT edge_id, src, dst, weight FROM shown WHERE src IN (SELECT entity_id FROM known) AND dst IN (SELECT entity_id FROM known) ORDER BY weight DESC NULLS LAST, edge_id LIMIT 300",
}
