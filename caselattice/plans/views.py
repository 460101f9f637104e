"""Queries of the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import patterns as P
from ..operators import views as V
from ..session import cut
from ..sources.casedata import edges, transfers, vertices, with_tables
from ..tables import table
from .patterns import _FREQ, _LARGE
from .texts import _FILES, _INDEX, _files, tf_index


# Words a summary must not use.
BANNED = [
    "guilty", "convicted", "criminal", "confirmed criminal", "proven", "definitely", "certainly committed", "is the perpetrator", "is guilty", "is responsible for the crime",
]


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw texts composed and cleaned: their length and words."""
    rows = table(spark, folder, "case_files", "doc_key", "raw_text").groupBy("doc_key").agg(F.min("raw_text").alias("t"))
    c = S.clean(V.composed("t"))
    return rows.select("doc_key", F.length(c).cast("long").alias("n_chars"), F.size(V.words_of(c)).cast("long").alias("n_words"))


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Case files that name an entity word for word, by a name or alias of any length."""
    v = vertices(spark, folder)
    names = v.select("entity_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("name"))
    return V.name_mentions(_files(spark, folder), "doc_key", "text", names, "entity_id", "name")


def listed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names in numbered lists of the case files."""
    return _files(spark, folder).select("doc_key", F.explode(T.found(F.col("text"), T.LISTED_NAME)).alias("name")).groupBy("doc_key", "name").agg(F.count(F.lit(1)).alias("n"))


def flow_totals(spark: SparkSession, folder: str) -> DataFrame:
    return V.flow_totals(transfers(spark, folder))


def adjacency_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Senders and distinct sender-receiver pairs."""
    pairs = transfers(spark, folder).filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    return pairs.agg(F.countDistinct("src").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))


def relation_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean confidence, least weight and number of edges per relationship."""
    return edges(spark, folder).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("weight").alias("least_weight"))


def strong_edges(spark: SparkSession, folder: str) -> DataFrame:
    return V.strong_or_weak(edges(spark, folder), 0.8).select("edge_id", "source_record", "weight")


def active_case_view(spark: SparkSession, folder: str) -> DataFrame:
    members = vertices(spark, folder).select("entity_id", F.explode(F.array_distinct("source_documents")).alias("case_id"))
    return V.active_case(edges(spark, folder), members)


def link_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Account pairs with money between them, by counterparties, money and presence."""
    flows = cut(V.flow_totals(transfers(spark, folder)))
    pairs = flows.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return V.presence_scores(flows, pairs)


def held_out_links(spark: SparkSession, folder: str) -> DataFrame:
    """AUC of the link score for held-out account pairs beside drawn pairs without a transfer."""
    return V.held_out_auc(cut(V.flow_totals(transfers(spark, folder))))


def negative_links(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cut(G.simple_pairs(G.build(edges(spark, folder), vertices(spark, folder))[0]))
    return V.negative_samples(pairs, vertices(spark, folder).select("entity_id"), 2)


def evidence_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged accounts with the receivers they paid most."""
    t = transfers(spark, folder)
    flags = P.flag_ranking(P.flags(
        (P.frequency_anomalies(t), "src", "HIGH_TRANSACTION_FREQUENCY", F.format_string("%d transfers", "peak")),
        (P.large_singles(t), "src", "LARGE_TRANSFER", F.col("txn_id")),
    )).filter("key IS NOT NULL")
    paid = V.flow_totals(t).select("src", "dst", F.col("total").alias("confidence"))
    return V.evidence_bundle(flags, G.strongest_neighbours(paid, 5))


def snippet_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "top3_results", "result_id", "rank_no", "risk_score", "text_snippet").groupBy("result_id").agg(
        F.min("rank_no").alias("rank_no"), F.min("risk_score").alias("risk"), F.min("text_snippet").alias("text")
    ).withColumns({"relevance": 1 / F.col("rank_no").cast("double"), "flag": F.least(F.col("risk") / 100, F.lit(1.0))})
    return V.summary_confidence(rows, "text", "relevance", "flag", BANNED).select("result_id", "confidence")


def remark_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Per month the three words that come first in the remarks of transfers."""
    rows = transfers(spark, folder).select(F.date_format("ts", "yyyy-MM").alias("month"), V.words_of(F.col("remarks")).alias("words")).filter(F.size("words") > 0)
    return V.rank_vote(rows, "month", "words", 3)


def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return V.hashed_tfidf(tf_index(spark, folder), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        clean_texts, entity_mentions, listed_names, flow_totals, adjacency_stats, relation_confidence, strong_edges, active_case_view, link_presence, held_out_links, negative_links, evidence_bundles,
        snippet_confidence, remark_vote, tfidf_vectors,
    )
}

_FLOWS = "flows AS (SELECT src, dst, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, max(amount) AS largest FROM transfers WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)"
_WORDS = r"array_to_string(list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> ''), ' ')"
ORACLE = {
    "entity_mentions": _FILES.rstrip() + f""", vertices AS (SELECT entity_id, min(type) AS type, min(name) AS name, min(aliases) AS aliases FROM entities GROUP BY 1), forms AS (SELECT entity_id, name FROM vertices UNION SELECT entity_id, unnest(aliases) FROM vertices), names AS (SELECT DISTINCT entity_id, {_WORDS.format('name')} AS phrase FROM forms),
      texts AS (SELECT doc_key, {_WORDS.format('text')} AS t FROM files) SELECT DISTINCT doc_key, entity_id FROM texts JOIN names ON phrase <> '' AND contains(' ' || t || ' ', ' ' || phrase || ' ')""",
    "listed_names": _FILES + f"SELECT doc_key, name, count(*) AS n FROM (SELECT doc_key, unnest(regexp_extract_all(coalesce(text, ''), '(?m)^\\s*[0-9]+\\.\\s+([A-Z][A-Za-z\\-]+(?:\\s+[A-Z][A-Za-z\\-]+)*)', 1)) AS name FROM files) GROUP BY 1, 2",
    "flow_totals": with_tables("transfers", more=_FLOWS) + "SELECT * FROM flows",
    "adjacency_stats": with_tables("transfers", more=_FLOWS) + "SELECT count(DISTINCT src) AS n_nodes, count(*) AS n_edges FROM flows",
    "relation_confidence": with_tables("edge_rows") + "SELECT relationship, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, min(weight) AS least_weight FROM edge_rows GROUP BY 1",
    "strong_edges": with_tables("edge_rows") + """SELECT edge_id, source_record, weight FROM (SELECT *, coalesce(weight >= 0.8, false) AS strong, max(CASE WHEN coalesce(weight >= 0.8, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_record) AS has_strong FROM edge_rows)
      WHERE strong OR has_strong = 0""",
    "active_case_view": with_tables("vertices", "edge_rows", more="""members AS (SELECT DISTINCT entity_id, unnest(source_documents) AS case_id FROM vertices),
      inside AS (SELECT DISTINCT e.source_record AS case_id, least(src, dst) AS a, greatest(src, dst) AS b, relationship AS kind FROM edge_rows e
        JOIN members x ON x.case_id = e.source_record AND x.entity_id = least(src, dst) JOIN members y ON y.case_id = e.source_record AND y.entity_id = greatest(src, dst) WHERE src <> dst)""")
    + """SELECT * FROM inside UNION ALL SELECT case_id, case_id, entity_id, 'MEMBER' FROM members WHERE case_id IN (SELECT case_id FROM members GROUP BY 1 HAVING count(*) > 1000)
      UNION ALL SELECT x.case_id, x.entity_id, y.entity_id, 'APPEARS_IN_CASE' FROM members x JOIN members y ON x.case_id = y.case_id AND x.entity_id < y.entity_id
      WHERE x.case_id NOT IN (SELECT case_id FROM members WHERE case_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1000) AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.case_id = x.case_id AND i.a = x.entity_id AND i.b = y.entity_id)""",
    "link_presence": with_tables("transfers", more=_FLOWS + """, pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(total) AS total FROM flows WHERE src <> dst GROUP BY 1, 2),
      ways AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), deg AS (SELECT node, count(*) AS k FROM ways GROUP BY 1),
      shared AS (SELECT p.a, p.b, count(*) AS cn FROM pairs p JOIN ways x ON x.node = p.a JOIN ways y ON y.node = p.b AND y.other = x.other GROUP BY 1, 2)""")
    + """SELECT p.a, p.b, round(0.5 * coalesce(cn, 0) / (da.k + db.k - coalesce(cn, 0)) + 0.3 * ln(1 + greatest(coalesce(total, 0.0), 0.0) / 50000.0) + 0.2, 6) AS score
      FROM pairs p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b JOIN deg da ON da.node = p.a JOIN deg db ON db.node = p.b""",
    "negative_links": with_tables("vertices", "edge_rows", more="""pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edge_rows WHERE src <> dst AND src IN (SELECT entity_id FROM vertices) AND dst IN (SELECT entity_id FROM vertices)),
      placed AS (SELECT entity_id AS node, row_number() OVER (ORDER BY entity_id) - 1 AS place FROM vertices), seeds AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS seed FROM pairs),
      draws AS (SELECT ('0x' || substr(md5(seed || '|' || k || '|a'), 1, 12))::BIGINT % (SELECT count(*) FROM placed) AS x, ('0x' || substr(md5(seed || '|' || k || '|b'), 1, 12))::BIGINT % (SELECT count(*) FROM placed) AS y FROM seeds, range(2) t(k)),
      named AS (SELECT DISTINCT p.node AS a, q.node AS b FROM (SELECT least(x, y) AS x, greatest(x, y) AS y FROM draws WHERE x <> y) d JOIN placed p ON p.place = d.x JOIN placed q ON q.place = d.y)""")
    + "SELECT a, b FROM named WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = named.a AND p.b = named.b)",
    "evidence_bundles": with_tables("transfers", more=_FLOWS + f""",
      marks AS (SELECT src AS key, 'HIGH_TRANSACTION_FREQUENCY' AS flag FROM ({_FREQ}) UNION ALL SELECT src, 'LARGE_TRANSFER' FROM ({_LARGE})),
      ways AS (SELECT node, other, max(total) AS total FROM (SELECT src AS node, dst AS other, total FROM flows WHERE src <> dst UNION ALL SELECT dst, src, total FROM flows WHERE src <> dst) GROUP BY 1, 2),
      best AS (SELECT node, string_agg(other, ',' ORDER BY k) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY total DESC NULLS LAST, other) AS k FROM ways) WHERE k <= 5 GROUP BY 1)""")
    + "SELECT key, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, coalesce(any_value(neighbours), '') AS neighbours FROM marks LEFT JOIN best ON node = key WHERE key IS NOT NULL GROUP BY key",
    "snippet_confidence": """SELECT result_id, round(least(greatest(0.4 * coalesce(1.0 / r, 0.0) + 0.4 * coalesce(least(risk / 100, 1.0), 0.0)
      - least(0.2 * len(list_filter(['guilty', 'convicted', 'criminal', 'confirmed criminal', 'proven', 'definitely', 'certainly committed', 'is the perpetrator', 'is guilty', 'is responsible for the crime'], lambda w: contains(t, w))), 0.4), 0.0), 1.0), 4) AS confidence
      FROM (SELECT result_id, CAST(min(rank_no) AS DOUBLE) AS r, min(risk_score) AS risk, lower(coalesce(min(text_snippet), '')) AS t FROM top3_results GROUP BY 1)""",
    "remark_vote": with_tables("transfers", more=r"""lists AS (SELECT strftime(ts, '%Y-%m') AS month, list_filter(string_split_regex(lower(coalesce(remarks, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM transfers),
      votes AS (SELECT month, label, CAST(sum(size - pos) AS BIGINT) AS votes FROM (SELECT month, len(ws) AS size, unnest(range(len(ws))) AS pos, unnest(ws) AS label FROM lists) GROUP BY 1, 2)""")
    + "SELECT month, label, votes, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY votes DESC, label) AS place FROM votes) WHERE place <= 3",
    "tfidf_vectors": f"""WITH {_INDEX}, df AS (SELECT token, count(*) AS df FROM idx GROUP BY 1), cells AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 7))::BIGINT % 384 AS BIGINT) AS pos,
      sum(tf * ln((1 + (SELECT count(DISTINCT doc_id) FROM idx)) / (1 + df))) AS x FROM idx JOIN df USING (token) GROUP BY 1, 2), norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY 1)
      SELECT doc_id, pos, round(x / norm, 5) AS value FROM cells JOIN norms USING (doc_id) WHERE norm > 0""",
    "clean_texts": r"""SELECT doc_key, length(c) AS n_chars, len(list_filter(string_split_regex(lower(coalesce(c, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')) AS n_words FROM (
      SELECT doc_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(t), '[\x00-\x08\x0b-\x1f\x7f-\x9f]|\p{Cf}', '', 'g'), '[ \t\x{a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9)) AS c
      FROM (SELECT doc_key, min(raw_text) AS t FROM case_files GROUP BY 1))""",
}
