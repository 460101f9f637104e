"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RULES
from ..operators import graph as G
from ..operators.components import connected_components
from ..operators.patterns import flag_ranking as ranked_flags
from ..operators.patterns import flags
from ..session import cut
from ..sources.casedata import edges, vertices, with_tables
from .patterns import carriers, key_flags


def _pairs(spark, folder):
    kept, _ = G.build(edges(spark, folder), vertices(spark, folder))
    return G.simple_pairs(kept)


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.build(edges(spark, folder), vertices(spark, folder))[0]


def rejected_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.build(edges(spark, folder), vertices(spark, folder))[1]


def typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.typed(edges(spark, folder), vertices(spark, folder)).select("edge_id", "src", "dst", "kind", "strength")


def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return G.neighbours(graph_edges(spark, folder))


def case_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a case among entities that name it: recorded ones and those of entities met in one document."""
    v = cut(vertices(spark, folder))
    met = G.cooccurrences(v).filter("kind = 'pair'").select(F.lit(None).cast("long").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("doc").alias("source_record"))
    return G.case_edges(edges(spark, folder).select("edge_id", "src", "dst", "source_record").unionByName(met), v)


def cooccur_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of one document in pairs, typed by the document; members of very large documents as class rows."""
    found = G.cooccurrences(vertices(spark, folder))
    return found.withColumn("relationship", F.when(F.startswith(F.upper("doc"), F.lit("FIR")), "APPEARS_IN_CASE").otherwise("APPEARS_IN_SAME_DOCUMENT"))


def case_pair_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one document with the relation of their types and a fixed confidence."""
    v = cut(vertices(spark, folder))
    of = lambda side: v.select(F.col("entity_id").alias(side), F.col("type").alias(f"type_{side}"))
    met = G.cooccurrences(v).filter("kind = 'pair'").join(of("a"), "a").join(of("b"), "b")
    return met.select("doc", "a", "b", G.case_pair_type(F.col("type_a"), F.col("type_b")).alias("relationship"), F.lit(G.CASE_PAIR_CONFIDENCE).alias("confidence"))


def degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(_pairs(spark, folder), vertices(spark, folder))


def link_score(spark: SparkSession, folder: str) -> DataFrame:
    return G.link_scores(cut(_pairs(spark, folder)))


def top_links(spark: SparkSession, folder: str) -> DataFrame:
    """The ten suggested links of highest score."""
    return link_score(spark, folder).filter("kind = 'pair'").orderBy(F.desc("score"), "a", "b").limit(10).drop("kind")


def components(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    return connected_components(pairs, vertices(spark, folder).select("entity_id"), "a", "b")


def bfs_path(spark: SparkSession, folder: str) -> DataFrame:
    """Hops from the node that comes first in order to every node it reaches."""
    pairs = cut(_pairs(spark, folder))
    return G.hop_distances(pairs, pairs.agg(F.min("a").alias("node")))


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """The path of fewest edges from the first to the last node in order."""
    pairs = cut(_pairs(spark, folder))
    first, last = pairs.agg(F.min("a"), F.max("b")).first()
    return G.shortest_path(pairs, first, last)


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    flow = graph_edges(spark, folder).select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("w")).filter("w > 0")
    return G.pagerank(flow, vertices(spark, folder).select("entity_id")).select("node", F.round("rank", 8).alias("rank"))


def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Exact betweenness and closeness of the whole graph."""
    return G.path_centrality(cut(_pairs(spark, folder)), vertices(spark, folder).select("entity_id"))


def communities(spark: SparkSession, folder: str) -> DataFrame:
    return G.communities(cut(_pairs(spark, folder)))


def dense_cluster(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cut(_pairs(spark, folder))
    return G.dense_members(pairs, G.communities(pairs))


def strongest_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return G.strongest_neighbours(graph_edges(spark, folder), 7)


def type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and edges per type with a total, as grouping sets."""
    return vertices(spark, folder).cube("type").agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).select(
        F.coalesce("type", F.lit("ALL")).alias("type"), "n_entities", "mean_confidence"
    )


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    """Every node with its centralities, betweenness and closeness exact, and its community by rank of size, -1 without one."""
    pairs, nodes = cut(_pairs(spark, folder)), cut(vertices(spark, folder).select("entity_id"))
    found = cut(G.communities(pairs))
    numbered = found.join(G.community_ranks(found).select("community", F.col("rank").cast("int").alias("cluster")), "community").select("node", "community", "cluster")
    return (
        degree(spark, folder).join(G.path_centrality(pairs, nodes), "node").join(pagerank(spark, folder), "node")
        .join(numbered, "node", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    )


def centrality_table(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes with degree, betweenness, closeness, rank and community number (-1: none)."""
    return _measures(spark, folder).select("node", "degree", "betweenness", "closeness", "rank", F.col("cluster").alias("community"))


def priority_score(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by review priority, the highest first: degree, betweenness, PageRank and all flags, with the evidence of each part."""
    nodes = cut(_measures(spark, folder))
    carried = key_flags(spark, folder).join(carriers(spark, folder), "key").select(F.col("entity_id").alias("key"), "flag", "evidence")
    grouped = nodes.filter("community IS NOT NULL").select("node", "community")
    dense = G.dense_members(cut(_pairs(spark, folder)), grouped)
    in_cluster = flags((dense, "node", "DENSE_CLUSTER_MEMBERSHIP", F.format_string("%.3f of %d neighbours in its community", "share", "n_neighbours")))
    marks = ranked_flags(carried.unionByName(in_cluster)).select(F.col("key").alias("node"), "flags", "flag_score", F.col("evidence").alias("flag_evidence"))
    score = (
        RULES.weight_degree * F.col("degree") + RULES.weight_betweenness * F.col("betweenness")
        + RULES.weight_pagerank * F.col("rank") + F.coalesce("flag_score", F.lit(0.0))
    )
    evidence = F.concat_ws(
        "; ", F.when(F.col("degree") > 0, F.format_string("degree %.3f", "degree")), F.when(F.col("betweenness") > 0, F.format_string("betweenness %.3f", "betweenness")),
        F.when(F.col("rank") > 0, F.format_string("PageRank %.4f", "rank")), "flag_evidence",
    )
    return nodes.join(marks, "node", "left").filter("flags IS NOT NULL OR n_neighbours > 0").select(
        "node", "degree", "betweenness", "rank", F.col("cluster").alias("community"), F.coalesce("flags", F.lit("")).alias("flags"),
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("priority"), evidence.alias("evidence"),
    ).orderBy(F.desc("priority"), "node")


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, rejected_edges, typed_edges, neighbors, case_subgraph, cooccur_edges, case_pair_edges, degree, link_score, top_links, components, bfs_path, shortest_path, pagerank,
        betweenness, communities, dense_cluster, strongest_neighbors, type_counts, centrality_table, priority_score,
    )
}

_BASE = ("vertices", "edge_rows")
_BUILT = """firsts AS (SELECT src, dst, relationship, source_record, min((edge_id, ts, confidence, weight)) AS e FROM edge_rows GROUP BY ALL),
built AS (SELECT f.src, f.dst, f.relationship, f.source_record, e[1] AS edge_id, e[2] AS ts, e[3] AS confidence, e[4] AS weight,
  a.entity_id IS NOT NULL AS has_src, b.entity_id IS NOT NULL AS has_dst FROM firsts f LEFT JOIN vertices a ON a.entity_id = f.src LEFT JOIN vertices b ON b.entity_id = f.dst),
kept AS (SELECT * EXCLUDE (has_src, has_dst) FROM built WHERE has_src AND has_dst),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM kept WHERE src <> dst),
ways AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
deg AS (SELECT node, count(*) AS k FROM ways GROUP BY 1)"""
_W = lambda more="": with_tables(*_BASE, more=_BUILT + more)
_MEMBERS = "members AS (SELECT DISTINCT entity_id, type, coalesce(confidence, 0.5) AS confidence, unnest(source_documents) AS doc FROM vertices), big AS (SELECT doc FROM members GROUP BY 1 HAVING count(*) > 1000)"
_MET = "SELECT x.doc, x.entity_id AS a, y.entity_id AS b, least(x.confidence, y.confidence) AS confidence, x.type AS x, y.type AS y FROM members x JOIN members y ON x.doc = y.doc AND x.entity_id < y.entity_id WHERE x.doc NOT IN (SELECT doc FROM big)"

_LINKS = """, met AS (SELECT x.other AS a, y.other AS b, count(*) AS cn, sum(1 / ln(d.k)) AS aa, any_value(da.k) AS ka, any_value(db.k) AS kb, min(d.k) AS least_k FROM ways x JOIN ways y ON x.node = y.node AND x.other < y.other JOIN deg d ON d.node = x.node
      JOIN deg da ON da.node = x.other JOIN deg db ON db.node = y.other GROUP BY 1, 2),
    found AS (SELECT * FROM (SELECT a, b, cn, round(aa, 6) AS aa, round(cn / (ka + kb - cn), 6) AS jaccard, round(0.4 * cn / (SELECT max(k) FROM deg) + 0.4 * least(aa, 1.0) + 0.2 * (cn / (ka + kb - cn)), 6) AS score, 'pair' AS kind
      FROM met p WHERE least_k <= 1000 AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.a = p.a AND q.b = p.b)) WHERE score >= 0.05)"""
ORACLE = {
    "graph_edges": _W() + "SELECT * FROM kept",
    "rejected_edges": _W() + "SELECT edge_id, src, dst, concat_ws(',', CASE WHEN NOT has_src THEN 'source' END, CASE WHEN NOT has_dst THEN 'target' END) AS unknown FROM built WHERE NOT (has_src AND has_dst)",
    "typed_edges": with_tables(*_BASE) + """SELECT edge_id, src, dst, kind, round(CASE WHEN kind IN ('CALLED', 'TRANSFERRED_MONEY_TO') THEN least(2 * confidence, 1.0) ELSE confidence END, 6) AS strength FROM (
      SELECT e.*, CASE WHEN relationship <> 'APPEARS_IN_SAME_DOCUMENT' THEN relationship WHEN upper(source_record) LIKE 'CDR%' THEN 'CALLED'
        WHEN upper(source_record) LIKE 'TXN%' OR upper(source_record) LIKE 'TRANSACTION%' THEN 'TRANSFERRED_MONEY_TO' WHEN upper(source_record) LIKE 'FIR%' THEN 'APPEARS_IN_CASE'
        WHEN (x = 'PERSON' AND y IN ('PHONE', 'VEHICLE', 'ACCOUNT')) OR (y = 'PERSON' AND x IN ('PHONE', 'VEHICLE', 'ACCOUNT')) THEN 'OWNS'
        WHEN (x = 'PERSON' AND y = 'LOCATION') OR (x = 'LOCATION' AND y = 'PERSON') THEN 'LOCATED_AT' WHEN (x = 'PERSON' AND y = 'ORGANIZATION') OR (x = 'ORGANIZATION' AND y = 'PERSON') THEN 'WORKS_FOR'
        WHEN x = 'ACCOUNT' AND y = 'ACCOUNT' THEN 'TRANSFERRED_MONEY_TO' WHEN x = 'PHONE' AND y = 'PHONE' THEN 'CONNECTED_TO' ELSE 'ASSOCIATED_WITH' END AS kind
      FROM (SELECT e.*, a.type AS x, b.type AS y FROM edge_rows e LEFT JOIN vertices a ON a.entity_id = e.src LEFT JOIN vertices b ON b.entity_id = e.dst) e)""",
    "neighbors": _W() + "SELECT src AS node, dst AS other, 'out' AS direction, relationship FROM kept UNION SELECT dst, src, 'in', relationship FROM kept",
    "case_subgraph": with_tables(*_BASE, more=_MEMBERS) + f"""SELECT c.source_record AS case_id, c.edge_id, c.src, c.dst FROM (SELECT edge_id, src, dst, source_record FROM edge_rows UNION ALL SELECT NULL, a, b, doc FROM ({_MET})) c
      JOIN vertices a ON a.entity_id = c.src JOIN vertices b ON b.entity_id = c.dst WHERE list_contains(a.source_documents, c.source_record) AND list_contains(b.source_documents, c.source_record)""",
    "cooccur_edges": with_tables("vertices", more=_MEMBERS)
    + f"""SELECT *, CASE WHEN upper(doc) LIKE 'FIR%' THEN 'APPEARS_IN_CASE' ELSE 'APPEARS_IN_SAME_DOCUMENT' END AS relationship FROM (SELECT doc, a, b, confidence, 'pair' AS kind FROM ({_MET})
      UNION ALL SELECT doc, doc, entity_id, confidence, 'member' FROM members WHERE doc IN (SELECT doc FROM big))""",
    "case_pair_edges": with_tables("vertices", more=_MEMBERS) + f"""SELECT doc, a, b, CASE WHEN x = 'PHONE' AND y = 'PHONE' THEN 'CALLED' WHEN x = 'ACCOUNT' AND y = 'ACCOUNT' THEN 'TRANSFERRED_MONEY_TO'
      WHEN x || y IN ('PERSONPHONE', 'PHONEPERSON') THEN 'USES_PHONE' WHEN x || y IN ('PERSONACCOUNT', 'ACCOUNTPERSON') THEN 'OWNS_ACCOUNT' WHEN x || y IN ('PERSONVEHICLE', 'VEHICLEPERSON') THEN 'DRIVES_VEHICLE'
      ELSE 'CO_OCCURS_WITH' END AS relationship, 0.8::DOUBLE AS confidence FROM ({_MET})""",
    "degree": _W(",\nnodes AS (SELECT node FROM ways UNION SELECT entity_id FROM vertices)")
    + "SELECT node, coalesce(k, 0) AS n_neighbours, round(coalesce(k, 0) / greatest((SELECT count(*) FROM nodes) - 1, 1), 6) AS degree FROM nodes LEFT JOIN deg USING (node)",
    "link_score": _W() + _LINKS + " SELECT * FROM found UNION ALL SELECT w.node, w.other, k, round(1 / ln(k), 6), NULL, NULL, 'hub' FROM ways w JOIN deg ON deg.node = w.node WHERE k > 1000",
    "top_links": _W() + _LINKS + " SELECT a, b, cn, aa, jaccard, score FROM found ORDER BY score DESC, a, b LIMIT 10",
    "components": _W(",\nreach(node, root) AS (SELECT node, node FROM deg UNION SELECT w.other, r.root FROM reach r JOIN ways w ON w.node = r.node WHERE r.root < w.other)")
    + "SELECT entity_id AS node, least(entity_id, coalesce((SELECT min(root) FROM reach WHERE node = entity_id), entity_id)) AS component FROM vertices",
    "bfs_path": _W(",\nhop(node, hops) AS (SELECT min(a), 0 FROM pairs UNION SELECT w.other, h.hops + 1 FROM hop h JOIN ways w ON w.node = h.node WHERE h.hops < 60),\nnear AS (SELECT node, min(hops) AS hops FROM hop GROUP BY 1)")
    + "SELECT n.node, CAST(n.hops AS INTEGER) AS hops, (SELECT min(w.other) FROM ways w JOIN near p ON p.node = w.other WHERE w.node = n.node AND p.hops = n.hops - 1) AS via FROM near n",
    "shortest_path": _W(""",\nfwd(node, hops) AS (SELECT min(a), 0 FROM pairs UNION SELECT w.other, h.hops + 1 FROM fwd h JOIN ways w ON w.node = h.node WHERE h.hops < 60),
near AS (SELECT node, min(hops) AS hops FROM fwd GROUP BY 1),
before AS (SELECT n.node, n.hops, min(w.other) AS via FROM near n JOIN ways w ON w.node = n.node JOIN near p ON p.node = w.other AND p.hops = n.hops - 1 GROUP BY 1, 2),
back(node, step) AS (SELECT node, hops FROM near WHERE node = (SELECT max(b) FROM pairs) UNION ALL SELECT p.via, b.step - 1 FROM back b JOIN before p ON p.node = b.node)""") + "SELECT CAST(step AS INTEGER) AS step, node FROM back",
    "strongest_neighbors": _W(",\nbest AS (SELECT node, other, max(confidence) AS confidence FROM (SELECT src AS node, dst AS other, confidence FROM kept WHERE src <> dst UNION ALL SELECT dst, src, confidence FROM kept WHERE src <> dst) GROUP BY 1, 2)")
    + """SELECT node, CAST(place AS INTEGER) AS place, other, confidence, n_all - least(n_all, 7) AS n_more FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, other) AS place, count(*) OVER (PARTITION BY node) AS n_all FROM best) WHERE place <= 7""",
    "type_counts": with_tables("vertices") + "SELECT coalesce(type, 'ALL') AS type, count(*) AS n_entities, round(avg(confidence), 6) AS mean_confidence FROM vertices GROUP BY GROUPING SETS ((type), ())",
}
