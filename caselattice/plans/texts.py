"""Queries of text extraction, chunks, indexes and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..operators import retrieval as R
from ..operators.blocks import line_blocks
from ..operators.blocks import routed_mentions as line_mentions
from ..session import broadcast_if_small
from ..tables import table


def _files(spark, folder):
    """Case files once per key, with their clean text."""
    return table(spark, folder, "case_files", "doc_key", "clean_text").groupBy("doc_key").agg(F.min("clean_text").alias("text"))


def extract_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Phones, plates, accounts, dates and amounts found in every case file, in order."""
    c = F.col("text")
    lists = {"phones": T.found(c, T.PHONE), "plates": T.found(c, T.PLATE), "accounts": T.accounts(c), "dates": T.found(c, T.DATE)}
    total = F.aggregate(T.amounts(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return _files(spark, folder).select("doc_key", *(F.array_join(v, ",").alias(k) for k, v in lists.items()), F.size(T.amounts(c)).cast("long").alias("n_amounts"), total.alias("total_amount"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and mentions per extracted phone and account."""
    c = F.col("text")
    both = F.concat(F.transform(T.found(c, T.PHONE), lambda x: F.struct(F.lit("PHONE").alias("type"), x.alias("value"))), F.transform(T.accounts(c), lambda x: F.struct(F.lit("ACCOUNT").alias("type"), x.alias("value"))))
    return _files(spark, folder).select("doc_key", F.inline(both)).groupBy("type", "value").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_key").alias("n_docs"))


def known_people(spark: SparkSession, folder: str) -> DataFrame:
    """Subscribers named in case files by their phone or account."""
    people = table(spark, folder, "subscribers", "person_id", "phone", "account")
    keys = people.select("person_id", F.explode(F.array_compact(F.array("phone", "account"))).alias("value")).distinct()
    c = F.col("text")
    hits = _files(spark, folder).select("doc_key", F.explode(F.array_distinct(F.concat(T.found(c, T.PHONE), T.accounts(c)))).alias("value"))
    return hits.join(broadcast_if_small(keys), "value").select("doc_key", "person_id").distinct()


def lang_marker(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("text")
    return _files(spark, folder).select("doc_key", T.mixed(c).alias("mixed"), F.size(T.markers(c)).cast("long").alias("n_markers"))


def case_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("doc_key", F.regexp_extract(F.coalesce("text", F.lit("")), T.CASE_NO, 1).alias("case_no"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every case file by end marks and lines: how many and the longest."""
    s = T.sentences(F.col("text"))
    return _files(spark, folder).select("doc_key", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


def header_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each kind in the case files."""
    return line_blocks(_files(spark, folder), "doc_key", "text").groupBy("doc_key", "kind").agg(F.count(F.lit(1)).alias("n_blocks"))


def routed_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of the case files by type and method, each block read in its own way."""
    found = line_mentions(_files(spark, folder), "doc_key", "text")
    return found.groupBy("type", "method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_key").alias("n_docs"), F.min("confidence").alias("confidence"))


def chunk_400_80(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return T.chunks(docs, "text", 400, 80).select("doc_id", "chunk_no", "start", F.md5("chunk").alias("digest"))


def chunk_250_50(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 250 characters with the line they begin in; blank ones skipped."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return T.chunks(docs, "text", 250, 50, skip_blank=True).select("doc_id", "chunk_no", F.col("first_line").cast("long").alias("first_line"), F.length("chunk").cast("long").alias("n_chars"))


def tf_index(spark: SparkSession, folder: str) -> DataFrame:
    return R.term_index(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


_QUERY = ["account", "cash", "ledger", "mobile", "witness"]


def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return R.keyword_search(tf_index(spark, folder), "doc_id", _QUERY, 20)


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25(tf_index(spark, folder), "doc_id", _QUERY, 20)


def evidence_grep(spark: SparkSession, folder: str) -> DataFrame:
    """At most three lines of each case file that mention an account or a vehicle."""
    return R.evidence_lines(_files(spark, folder), "doc_key", "text", "(account|vehicle|khata|gaadi)", 3).select("doc_key", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest rows to every row whose id is divisible by 100, searched over all rows."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return R.vector_topk(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding", 5)


def centroid_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    return R.centroids(rows, "label", "embedding").select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))


def fusion_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking rows with scores fused from risk, rank and a match of the snippet; a plate in the snippet lifts them."""
    rows = table(spark, folder, "top3_results", "result_id", "rank_no", "risk_score", "text_snippet").groupBy("result_id").agg(
        F.min("rank_no").alias("rank_no"), F.min("risk_score").alias("risk_score"), F.min("text_snippet").alias("text_snippet")
    )
    text = F.coalesce("text_snippet", F.lit(""))
    scored = rows.withColumns({
        "risk": S.rescale(F.col("risk_score"), 10.0, 75.0), "near": 1 / F.col("rank_no").cast("double"),
        "hit": F.lower(text).contains("account").cast("double"), "plate": text.rlike(T.PLATE).cast("double"),
    })
    return R.fuse(scored, "result_id", {"risk": 0.35, "near": 0.35, "hit": 0.20, "plate": 0.10}, ("plate", 0.85))


QUERIES = {
    f.__name__: f
    for f in (
        extract_patterns, mentions, known_people, lang_marker, case_numbers, sentence_split, header_fields, routed_mentions, chunk_400_80, chunk_250_50, tf_index, keyword_search, bm25_search,
        evidence_grep, vector_topk, centroid_terms, fusion_rank,
    )
}

_FILES = "WITH files AS (SELECT doc_key, min(clean_text) AS text FROM case_files GROUP BY 1)\n"
_ALL = lambda p: f"regexp_extract_all(coalesce(text, ''), '{p}', 1)"
_STOP = "'the','a','an','is','in','of','and','to','for','are','at','by','on','be','this','that','with','has','was','all','from','been','have','it'"
_MARK = "'ne','ka','ki','ko','mein','se','hai','tha','thi','the','aur','par','jo','woh','yeh','bataya','dekha','pakda','giraftaar','uska','paas','baith','bhaag','chura'"
_N_MARK = f"(SELECT count(DISTINCT w) FROM (SELECT unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+')) AS w) WHERE w IN ({_MARK}))"
# no look-around here: separators are doubled, so that each neighbour can be matched by both values beside it
_PHONES = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])(?:\+91(?:[-.\s]{2})?|0)?([6-9][0-9]{9})(?:[^0-9]|$)', 1)"
_SPACED = r"('  ' || regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '  ', 'g') || '  ')"
_PLATES = f"regexp_extract_all({_SPACED}, ' ([A-Z]{{2}}[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4}}) ', 1)"
_CODES = f"regexp_extract_all({_SPACED}, '(?i) (ACC[0-9]{{5}}|ACC_[a-f0-9]{{8}}) ', 1)"
_ACCOUNTS = "list_concat(" + _CODES + r", regexp_extract_all(coalesce(text, ''), '(?i)(?:account\s+(?:number\s+)?|a/c\s*(?:no\.?\s*)?)([0-9]{9,18})(?:[^\p{L}\p{N}_]|$)', 1))"
_INDEX = f"""words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS token FROM documents),
idx AS (SELECT token, doc_id, count(*) AS n, round(count(*) / any_value(size), 6) AS tf FROM words JOIN (SELECT doc_id, count(*) AS size FROM words GROUP BY 1) USING (doc_id) GROUP BY 1, 2)"""
_IN = ", ".join(f"'{w}'" for w in _QUERY)

ORACLE = {
    "extract_patterns": _FILES + f"""SELECT doc_key, array_to_string({_PHONES}, ',') AS phones, array_to_string({_PLATES}, ',') AS plates, array_to_string({_ACCOUNTS}, ',') AS accounts,
      array_to_string({_ALL(T.DATE)}, ',') AS dates, len({_ALL(T.AMOUNT)}) AS n_amounts, CAST(coalesce(list_sum(list_transform({_ALL(T.AMOUNT)}, lambda a: CAST(replace(a, ',', '') AS BIGINT))), 0) AS BIGINT) AS total_amount FROM files""",
    "mentions": _FILES + f"""SELECT type, value, count(*) AS n_mentions, count(DISTINCT doc_key) AS n_docs FROM (SELECT doc_key, 'PHONE' AS type, unnest({_PHONES}) AS value FROM files
      UNION ALL SELECT doc_key, 'ACCOUNT', unnest({_ACCOUNTS}) FROM files) GROUP BY 1, 2""",
    "known_people": _FILES + f"""SELECT DISTINCT doc_key, person_id FROM (SELECT doc_key, unnest({_PHONES}) AS value FROM files UNION SELECT doc_key, unnest({_ACCOUNTS}) FROM files)
      JOIN (SELECT person_id, phone AS value FROM subscribers UNION SELECT person_id, account FROM subscribers) USING (value)""",
    "lang_marker": _FILES + f"SELECT doc_key, regexp_matches(coalesce(text, ''), '[ऀ-ॿ]') OR {_N_MARK} >= 2 AS mixed, {_N_MARK} AS n_markers FROM files",
    "case_numbers": _FILES + f"SELECT doc_key, regexp_extract(coalesce(text, ''), '{T.CASE_NO}', 1) AS case_no FROM files",
    "sentence_split": _FILES + r"""SELECT doc_key, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (
      SELECT doc_key, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?।])[ \t\n]+([A-Zऀ-ॿ])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM files)""",
    "chunk_400_80": "SELECT doc_id, CAST(start // 320 AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, md5(substr(text, start + 1, 400)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 320)) AS start FROM documents WHERE length(text) > 0)",
    "chunk_250_50": """SELECT doc_id, CAST(start // 200 AS INTEGER) AS chunk_no, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS first_line, length(substr(text, start + 1, 250)) AS n_chars
      FROM (SELECT doc_id, text, CAST(unnest(range(0, length(text), 200)) AS INTEGER) AS start FROM documents WHERE length(text) > 0) WHERE trim(regexp_replace(substr(text, start + 1, 250), '\\s+', ' ', 'g')) <> ''""",
    "tf_index": f"WITH {_INDEX} SELECT * FROM idx",
    "keyword_search": f"WITH {_INDEX} SELECT doc_id, round(sum(tf), 6) AS score, count(*) AS n_words FROM idx WHERE token IN ({_IN}) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_search": f"""WITH {_INDEX}, sizes AS (SELECT doc_id, sum(n) AS size FROM idx GROUP BY 1), whole AS (SELECT count(*) AS n_docs, avg(size) AS mean_size FROM sizes), df AS (SELECT token, count(*) AS df FROM idx WHERE token IN ({_IN}) GROUP BY 1)
      SELECT doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * size / mean_size))), 6) AS score FROM idx JOIN df USING (token) JOIN sizes USING (doc_id), whole
      GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""",
    "evidence_grep": _FILES + """SELECT doc_key, line_no, md5(line) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY line_no) AS k FROM (
      SELECT doc_key, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_key, string_split(coalesce(text, ''), chr(10)) AS ls FROM files)) WHERE regexp_matches(line, '(?i)(account|vehicle|khata|gaadi)')) WHERE k <= 3""",
    "vector_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT query_id, row_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (
      SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_cosine_similarity(q.e, r.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 9) DESC, r.vec_id) AS place
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE place <= 5""",
    "centroid_terms": """WITH parts AS (SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2),
      sizes AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM parts GROUP BY 1) SELECT label, pos, round(mean / size, 5) AS value FROM parts JOIN sizes USING (label)""",
    "fusion_rank": f"""SELECT result_id, round(CASE WHEN plate THEN greatest(least(total, 1.0), 0.85) ELSE least(total, 1.0) END, 3) AS score FROM (SELECT result_id, len({_PLATES}) > 0 AS plate,
      0.35 * coalesce(least(greatest((risk - 10.0) / 65.0, 0.0), 1.0), 0.0) + 0.35 * coalesce(1.0 / place, 0.0) + 0.20 * CASE WHEN contains(lower(text), 'account') THEN 1.0 ELSE 0.0 END + 0.10 * CASE WHEN len({_PLATES}) > 0 THEN 1.0 ELSE 0.0 END AS total
      FROM (SELECT result_id, min(rank_no) AS place, min(risk_score) AS risk, coalesce(min(text_snippet), '') AS text FROM top3_results GROUP BY 1))""",
}
