"""The typed property graph: building, queries, centrality, link scores and communities.

Vertices and edges are DataFrames and every algorithm is joins and aggregates over them; iterations write each round to the
shared checkpoint folder. Communities and shortest paths of at most ``HELD`` edges are counted over arrays in the tasks (see
``arrays``), larger ones by joins; the results are the same. Nothing of a graph is collected, but its edges are broadcast as bytes
to the tasks that count paths.

Defined results: edges with a null end are rejected; loops do not count for degree, links, paths and communities; repeated
edges keep the least edge id; isolated nodes have degree 0; an empty graph gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .arrays import merging, pack_pairs, path_counts
from .ranks import with_rank
from .skew import join_one

#: Neighbours up to which a node's neighbour pairs are listed; above, it is kept as a hub (see ``shared_neighbours``).
HUB = 1_000
#: Edges up to which one task holds a graph as arrays: 8 bytes an edge as sent, about 100 in a worker.
HELD = 4_000_000

# The relation that a record's prefix or a pair of types means where only a shared document is known.
RECORD_TYPES = (("CDR", "CALLED"), ("TXN", "TRANSFERRED_MONEY_TO"), ("TRANSACTION", "TRANSFERRED_MONEY_TO"), ("FIR", "APPEARS_IN_CASE"))
PAIR_TYPES = {
    ("PERSON", "PHONE"): "OWNS", ("PHONE", "PERSON"): "OWNS", ("PERSON", "VEHICLE"): "OWNS", ("VEHICLE", "PERSON"): "OWNS",
    ("PERSON", "ACCOUNT"): "OWNS", ("ACCOUNT", "PERSON"): "OWNS", ("PERSON", "LOCATION"): "LOCATED_AT", ("LOCATION", "PERSON"): "LOCATED_AT",
    ("PERSON", "ORGANIZATION"): "WORKS_FOR", ("ORGANIZATION", "PERSON"): "WORKS_FOR", ("ACCOUNT", "ACCOUNT"): "TRANSFERRED_MONEY_TO",
    ("PHONE", "PHONE"): "CONNECTED_TO", ("PERSON", "PERSON"): "ASSOCIATED_WITH",
}
UNTYPED, DEFAULT_TYPE = "APPEARS_IN_SAME_DOCUMENT", "ASSOCIATED_WITH"
# Relations of a pair of types inside one case, and their confidence.
CASE_PAIR_TYPES = {
    ("PHONE", "PHONE"): "CALLED", ("ACCOUNT", "ACCOUNT"): "TRANSFERRED_MONEY_TO", ("PERSON", "PHONE"): "USES_PHONE", ("PERSON", "ACCOUNT"): "OWNS_ACCOUNT", ("PERSON", "VEHICLE"): "DRIVES_VEHICLE",
}
CASE_PAIR_CONFIDENCE = 0.80


def typed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with ``kind`` and ``strength``: a given type stays; an edge of a shared document follows the record's prefix (in
    any case), else the pair of types, else the default. Calls and transfers count double, at most 1.
    """
    kinds = vertices.select(F.col("entity_id").alias("id"), F.col("type"))
    a = kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type"))
    b = kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    joined = join_one(join_one(edges, a, "src"), b, "dst")
    record = F.upper(F.coalesce("source_record", F.lit("")))
    by_record = F.coalesce(*(F.when(F.startswith(record, F.lit(prefix)), kind) for prefix, kind in RECORD_TYPES))
    by_pair = F.element_at(_map({f"{x}|{y}": v for (x, y), v in PAIR_TYPES.items()}), F.concat("src_type", F.lit("|"), "dst_type"))
    given = F.when(F.col("relationship") != UNTYPED, F.col("relationship"))
    kind = F.coalesce(given, by_record, by_pair, F.lit(DEFAULT_TYPE))
    strength = F.when(kind.isin("CALLED", "TRANSFERRED_MONEY_TO"), F.least(2 * F.col("confidence"), F.lit(1.0))).otherwise(F.col("confidence"))
    return joined.withColumn("kind", kind).withColumn("strength", F.round(strength, 6)).drop("src_type", "dst_type")


def case_pair_type(a: Column, b: Column) -> Column:
    """The relation of two entities of one case by their types, in either order."""
    pairs = {f"{x}|{y}": v for (x, y), v in CASE_PAIR_TYPES.items()}
    return F.coalesce(F.element_at(_map(pairs), F.concat(a, F.lit("|"), b)), F.element_at(_map(pairs), F.concat(b, F.lit("|"), a)), F.lit("CO_OCCURS_WITH"))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def build(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: edges with both ends known, one per (src, dst, relationship, record), and those with an unknown end."""
    ids = vertices.select("entity_id").distinct()
    first = cut(edges.groupBy("src", "dst", "relationship", "source_record").agg(F.min(F.struct("edge_id", "ts", "confidence", "weight")).alias("e")).select(
        "src", "dst", "relationship", "source_record", "e.*"
    ))
    known_a = join_one(first, ids.select(F.col("entity_id").alias("src")).withColumn("has_src", F.lit(True)), "src")
    known = join_one(known_a, ids.select(F.col("entity_id").alias("dst")).withColumn("has_dst", F.lit(True)), "dst")
    kept = known.filter("has_src AND has_dst").drop("has_src", "has_dst")
    reason = F.concat_ws(",", F.when(F.col("has_src").isNull(), "source"), F.when(F.col("has_dst").isNull(), "target"))
    rejected = known.filter("has_src IS NULL OR has_dst IS NULL").select("edge_id", "src", "dst", reason.alias("unknown"))
    return kept, rejected


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected simple edges ``a < b``."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(a.alias("a"), b.alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))


def neighbours(edges: DataFrame) -> DataFrame:
    """``node, other, direction, relationship``: neighbours of every node, once per direction and relationship."""
    real = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    out = real.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "relationship")
    return out.unionByName(real.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"), "relationship")).distinct()


def degrees(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """``node, n_neighbours, degree``: neighbours over the number of other nodes, isolated nodes included."""
    nodes = both_ways(pairs).select("node").unionByName(vertices.select(F.col("entity_id").alias("node"))).distinct()
    total = nodes.agg(F.count(F.lit(1)).alias("n_all"))  # one row
    counted = both_ways(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(counted, "node", "left").crossJoin(F.broadcast(total)).select(
        "node", F.coalesce("k", F.lit(0)).alias("n_neighbours"), F.round(F.coalesce("k", F.lit(0)) / F.greatest(F.col("n_all") - 1, F.lit(1)), 6).alias("degree")
    )


def case_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``case_id, edge_id, src, dst``: edges recorded for a case whose ends both name it among their documents."""
    of_case = vertices.select("entity_id", F.explode(F.array_distinct("source_documents")).alias("case_id")).distinct()
    a = of_case.select(F.col("entity_id").alias("src"), F.col("case_id").alias("source_record"))
    b = of_case.select(F.col("entity_id").alias("dst"), F.col("case_id").alias("source_record"))
    return edges.join(a, ["src", "source_record"], "left_semi").join(b, ["dst", "source_record"], "left_semi").select(F.col("source_record").alias("case_id"), "edge_id", "src", "dst")


def cooccurrences(vertices: DataFrame, largest: int = HUB) -> DataFrame:
    """``doc, a, b, confidence, kind``: entities of one document in pairs ``a < b`` (kind ``pair``), confidence the lesser of both.

    A document with more than ``largest`` entities is not expanded; its members come as rows of the class (kind ``member``: ``a`` is
    the document, ``b`` the entity), which says in linear space that any two of them occur together.
    """
    members = vertices.select("entity_id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.explode(F.array_distinct("source_documents")).alias("doc")).filter("doc IS NOT NULL")
    sizes = members.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
    sized = join_one(cut(members), sizes, "doc")
    small = sized.filter(F.col("size") <= largest)
    a = small.select("doc", F.col("entity_id").alias("a"), F.col("confidence").alias("ca"))
    b = small.select("doc", F.col("entity_id").alias("b"), F.col("confidence").alias("cb"))
    pairs = a.join(b, "doc").filter("a < b").select("doc", "a", "b", F.least("ca", "cb").alias("confidence"), F.lit("pair").alias("kind"))
    return pairs.unionByName(sized.filter(F.col("size") > largest).select("doc", F.col("doc").alias("a"), F.col("entity_id").alias("b"), "confidence", F.lit("member").alias("kind")))


def shared_neighbours(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """``a, b, cn, aa``: pairs that share a neighbour, how many, and the Adamic-Adar sum.

    A neighbour with more than ``hub`` neighbours does not start pairs (its pairs would be as many as the square), but it
    is counted for every pair that some other neighbour starts: the pairs' hub neighbours are intersected as sets. Pairs
    that share hubs only are what ``hub_members`` says in linear space.
    """
    ways = both_ways(pairs)
    sized = cut(ways.join(ways.groupBy("node").agg(F.count(F.lit(1)).alias("k")), "node"))
    # from each neighbour's side: (via, x, k of via)
    via = sized.filter((F.col("k") > 1) & (F.col("k") <= hub)).select(F.col("node").alias("via"), "other", "k")
    a, b = via.select("via", F.col("other").alias("a"), "k"), via.select("via", F.col("other").alias("b"))
    near = a.join(b, "via").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cn"), F.sum(1 / F.log(F.col("k").cast("double"))).alias("aa"))
    hubs = sized.filter(F.col("k") > hub).select(F.col("other").alias("x"), F.struct(F.col("node"), F.col("k")).alias("h")).groupBy("x").agg(F.collect_set("h").alias("hubs"))
    with_hubs = (
        near.join(hubs.select(F.col("x").alias("a"), F.col("hubs").alias("ha")), "a", "left").join(hubs.select(F.col("x").alias("b"), F.col("hubs").alias("hb")), "b", "left")
        .withColumn("both", F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), F.array_intersect("ha", "hb")))
    )
    more = F.aggregate(F.coalesce("both", F.array().cast("array<struct<node:string,k:bigint>>")), F.lit(0.0), lambda s, h: s + 1 / F.log(h["k"].cast("double")))
    return with_hubs.select("a", "b", (F.col("cn") + F.coalesce(F.size("both"), F.lit(0)) * F.col("both").isNotNull().cast("int")).alias("cn"), (F.col("aa") + more).alias("aa"))


def hub_members(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """``hub, k, member``: the nodes with more than ``hub`` neighbours and each of these; any two members share the hub."""
    ways = both_ways(pairs)
    large = ways.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hub)
    return ways.join(large, "node").select(F.col("node").alias("hub"), "k", F.col("other").alias("member"))


def _composite(cn: Column, aa: Column, jaccard: Column, top: Column) -> Column:
    return 0.4 * cn / top + 0.4 * F.least(aa, F.lit(1.0)) + 0.2 * jaccard


def link_scores(pairs: DataFrame, least: float = 0.05, hub: int = HUB) -> DataFrame:
    """``a, b, cn, aa, jaccard, score, kind``: suggested links between nodes that share neighbours but no edge.

    Kind ``pair``: common neighbours, Adamic-Adar, Jaccard and their mix. Kind ``hub``: ``a`` is a node with more than ``hub``
    neighbours and ``b`` one of these; two members of a hub that are in no pair row share hubs only, and their figures follow
    from their hub rows (``cn`` is the hub's number of neighbours there, ``aa`` what it adds to a pair).
    """
    near = shared_neighbours(pairs, hub).join(pairs, ["a", "b"], "left_anti")
    k = both_ways(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    top = k.agg(F.max("k").alias("top"))  # one row
    joined = near.join(k.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b").crossJoin(F.broadcast(top))
    jaccard = F.col("cn") / (F.col("ka") + F.col("kb") - F.col("cn"))
    found = joined.select("a", "b", "cn", F.round("aa", 6).alias("aa"), F.round(jaccard, 6).alias("jaccard"), F.round(_composite(F.col("cn"), F.col("aa"), jaccard, F.col("top")), 6).alias("score"), F.lit("pair").alias("kind"))
    members = hub_members(pairs, hub).select(F.col("hub").alias("a"), F.col("member").alias("b"), F.col("k").alias("cn"), F.round(1 / F.log(F.col("k").cast("double")), 6).alias("aa"), F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("double").alias("score"), F.lit("hub").alias("kind"))
    return found.filter(F.col("score") >= least).unionByName(members)


def neighbourhood_overlap(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, cn, ka, kb`` of given node pairs: shared neighbours and the neighbours of each, hubs included.

    The neighbours of ``a`` are looked up in the edges by (neighbour, b), so the work is the sum of the asked nodes' degrees.
    """
    ways = both_ways(pairs)
    k = ways.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    small = asked.select("a", "b").distinct()
    sized = small.join(k.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a", "left").join(k.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b", "left")
    # start from the end with fewer neighbours
    turned = sized.withColumns({"x": F.when(F.col("ka") <= F.col("kb"), F.col("a")).otherwise(F.col("b")), "y": F.when(F.col("ka") <= F.col("kb"), F.col("b")).otherwise(F.col("a"))}).filter("ka > 0 AND kb > 0")
    via = turned.select("a", "b", "x", "y").join(ways.select(F.col("node").alias("x"), F.col("other").alias("via")), "x")
    shared = via.join(ways.select(F.col("node").alias("y"), F.col("other").alias("via")), ["y", "via"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cn"))
    return sized.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("cn", F.lit(0)).alias("cn"), F.coalesce("ka", F.lit(0)).alias("ka"), F.coalesce("kb", F.lit(0)).alias("kb"))


def hop_distances(pairs: DataFrame, source: DataFrame, most: int | None = None) -> DataFrame:
    """``node, hops, via``: least number of edges from the source nodes and the least previous node; up to ``most`` hops or all."""
    ways = cut(both_ways(pairs))
    reached = cut(source.select(F.col(source.columns[0]).alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")).dropna(subset=["node"]).distinct())
    front, n = reached, 0
    while most is None or n < most:
        n += 1
        # few nodes of the front have many rows in the edges, so the front's rows are what is spread
        step = front.select(F.col("node").alias("from")).join(ways, F.col("from") == F.col("node")).groupBy("other").agg(F.min("from").alias("via"))
        front = cut(step.select(F.col("other").alias("node"), F.lit(n).alias("hops"), "via").join(reached, "node", "left_anti"))
        if front.limit(1).count() == 0:
            break
        reached = cut(reached.unionByName(front))
    return reached


def shortest_path(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``step, node``: the nodes of a path of fewest edges from ``source`` to ``target`` (the least previous node on ties); no rows without one."""
    spark = pairs.sparkSession
    near = hop_distances(pairs, spark.createDataFrame([(source,)], "node string"))
    at = near.filter(F.col("node") == target).select("hops", "node", "via")
    found = at
    while at.filter("via IS NOT NULL").limit(1).count():  # once per hop, one row each
        at = cut(near.join(at.select(F.col("via").alias("node")), "node").select("hops", "node", "via"))
        found = found.unionByName(at)
    return found.select(F.col("hops").alias("step"), "node")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``node, rank`` on weighted directed edges ``src, dst, w``; rank of nodes without outgoing edges is spread evenly."""
    ids = cut(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    flow = edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w > 0")
    out = flow.groupBy("src").agg(F.sum("w").alias("total"))
    share = cut(flow.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    sinks = cut(ids.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    state = cut(ids.join(sinks.withColumn("sink", F.lit(True)), "node", "left").select("node", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / n).alias("rank")))
    lost = state.filter("sink").count() / n
    for _ in range(rounds):
        given = state.join(share, state["node"] == share["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = cut(
            state.join(given, state["node"] == given["dst"], "left")
            .select("node", "sink", F.col("rank").alias("old"), (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        )
        # the change of this round and the mass the next one spreads, in one pass
        change, lost = moved.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).first()
        state = moved.select("node", "sink", "rank")
        if change < n * tolerance:
            break
    return state.select("node", "rank")


def path_centrality(pairs: DataFrame, nodes: DataFrame, pivots: int | None = None, block: int = 512, held: int = HELD) -> DataFrame:
    """``node, betweenness, closeness``, normalised and undirected.

    Shortest paths are counted level by level from the sources, then credits flow back. Up to ``held`` edges every task gets the edges
    and a share of the sources. Above, each level of ``block`` sources at a time joins their front with the edges, and no
    task or driver holds anything of the graph. All nodes are sources and the result is exact when ``pivots`` is None or not less than their number; else
    the ``pivots`` nodes of least hash are, betweenness is scaled by their share, and closeness (of distances to the pivots) is an
    estimate likewise. The work grows with sources times edges; nodes of hanging trees are no sources in the tasks.
    """
    ways = cut(both_ways(pairs))
    ids = cut(nodes.select(F.col(nodes.columns[0]).alias("node")).dropna().unionByName(ways.select("node")).distinct())
    n = ids.count()
    if n < 2:
        return ids.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("closeness"))
    used = n if pivots is None else min(n, pivots)
    sources = ids if used == n else ids.orderBy(F.xxhash64("node"), "node").limit(used)
    between, far = (_paths_of_tasks if ways.count() <= 2 * held else _paths_of_joins)(pairs, ways, ids, sources, used == n, used, block)
    scale = n / used / ((n - 1) * (n - 2)) if n > 2 else 0.0
    # distances were measured to every node of the component, the node itself included, or to the pivots among them
    others = (F.col("near") - 1) if used == n else F.col("near") * (n / used) - F.lit(1.0)
    close = F.when(F.col("far") > 0, others * others / (F.col("far") * (n / used)) / (n - 1))
    return ids.join(between, "node", "left").join(far, "node", "left").select(
        "node", F.round(F.coalesce(F.col("b") * scale, F.lit(0.0)), 6).alias("betweenness"), F.round(F.coalesce(F.greatest(close, F.lit(0.0)), F.lit(0.0)), 6).alias("closeness")
    )


def _paths_of_joins(pairs: DataFrame, ways: DataFrame, ids: DataFrame, sources: DataFrame, every: bool, used: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``(node, b)`` and ``(node, far, near)``: what paths from the sources add to a node, and the distances from (``every``) or to it."""
    parts = max(1, -(-used // block))
    dealt = cut(sources.select(F.col("node").alias("s"), F.pmod(F.xxhash64(F.col("node")), F.lit(parts)).alias("part")))
    credits, spans = [], []
    for part in range(parts):
        front = cut(dealt.filter(F.col("part") == part).select("s", F.col("s").alias("node"), F.lit(1.0).alias("ways"), F.lit(0).alias("hops")))
        if front.limit(1).count() == 0:
            continue
        levels = [front]
        seen = front.select("s", "node")
        while True:
            step = front.join(ways, "node").groupBy("s", F.col("other").alias("node")).agg(F.sum("ways").alias("ways"))
            front = cut(step.join(seen, ["s", "node"], "left_anti").select("s", "node", "ways", F.lit(len(levels)).alias("hops")))
            if front.limit(1).count() == 0:
                break
            levels.append(front)
            # the next front meets only this level, the one before and nodes not seen
            seen = front.select("s", "node").unionByName(levels[-2].select("s", "node"))
        reached = reduce(DataFrame.unionByName, levels)
        end = "s" if every else "node"
        spans.append(reached.groupBy(F.col(end).alias("s")).agg(F.sum("hops").alias("far"), F.count(F.lit(1)).alias("near")))
        below = None
        for at in range(len(levels) - 1, 0, -1):
            level = levels[at]
            own = level.select("s", "node", "ways", F.lit(0.0).alias("credit")) if below is None else level.join(below, ["s", "node"], "left").select("s", "node", "ways", F.coalesce("credit", F.lit(0.0)).alias("credit"))
            own = cut(own)
            credits.append(own.groupBy("node").agg(F.sum("credit").alias("b")))
            above = levels[at - 1].select("s", F.col("node").alias("up"), F.col("ways").alias("up_ways"))
            below = (
                own.join(ways, "node").withColumnRenamed("other", "up").join(above, ["s", "up"])
                .groupBy("s", F.col("up").alias("node")).agg(F.sum(F.col("up_ways") / F.col("ways") * (1 + F.col("credit"))).alias("credit"))
            )
    empty = ids.limit(0).select("node", F.lit(0.0).alias("b"))
    between = reduce(DataFrame.unionByName, credits, empty).groupBy("node").agg(F.sum("b").alias("b"))
    return between, reduce(DataFrame.unionByName, spans).groupBy(F.col("s").alias("node")).agg(F.sum("far").alias("far"), F.sum("near").alias("near"))


def _paths_of_tasks(pairs: DataFrame, ways: DataFrame, ids: DataFrame, sources: DataFrame, every: bool, used: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The same over arrays: nodes are numbered by name, each task takes every so many-th source."""
    spark = pairs.sparkSession
    numbered, links = _numbered(ways.select("node", "other"), ids)
    known = numbered.join(sources, "node", "left_semi").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"))
    packed = links.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(known).repartition(1).mapInArrow(pack_pairs, "pairs binary, sources binary")  # one row
    parts = min(used, max(2 * spark.sparkContext.defaultParallelism, -(-used // (4 * block))))
    dealt = spark.range(0, parts, 1, parts).select(F.col("id").alias("part")).crossJoin(F.broadcast(packed))
    counted = dealt.mapInArrow(path_counts(numbered.count(), parts, every), "id long, b double, far long, near long")
    summed = cut(counted.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("b", "far", "near"))).join(numbered, "id"))
    return summed.select("node", "b"), summed.select("node", "far", "near")


def _numbered(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, id)`` in the order of names, and the edges (both ways) as ``x, y`` of ids."""
    numbered = cut(with_rank(nodes.select("node"), [F.asc("node")], "id").select("node", "id"))
    x = join_one(ways.select("node", "other"), numbered.select("node", F.col("id").alias("x")), "node")
    return numbered, cut(join_one(x, numbered.select(F.col("node").alias("other"), F.col("id").alias("y")), "other").select("x", "y"))


def communities(pairs: DataFrame, held: int = HELD) -> DataFrame:
    """``node, community``: greedy modularity, many merges a round; communities are named by their least node.

    Each round every community picks the neighbour whose merger raises modularity most; ties go by a hash of the two, so
    that they do not form chains. Two that pick each other merge: theirs is the best merger around. Communities with a single
    neighbour join it when they still gain with all that do, so stars take one round. Modularity rises every round and it
    ends when no merger gains. Gains are whole numbers (times twice the square of the edges), so they do not depend on
    the order of sums: once at most ``held`` pairs of communities are linked, one task does the rounds that are left.
    """
    m = pairs.count()
    if not m:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("community"))
    ways = both_ways(pairs)
    numbered, links = _numbered(ways, ways.select("node").distinct())
    # links between different communities, both ways, and the ends of edges in each
    links = links.withColumn("w", F.lit(1).cast("long"))
    mass = cut(links.groupBy("x").agg(F.sum("w").alias("ends")))
    label = numbered.select("node", F.col("id").alias("community"))
    renamed = lambda df, c, moved: df.join(moved.select(F.col("x").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    while links.count() > 2 * held:
        moved = _merged(links, mass, m)
        if moved.limit(1).count() == 0:
            break
        # a community that others join moves itself only when it is the larger name of a mutual pair, which they follow
        links = cut(renamed(renamed(links, "x", moved), "y", moved).filter("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")))
        mass = cut(renamed(mass, "x", moved).groupBy("x").agg(F.sum("ends").alias("ends")))
        label = cut(renamed(label, "community", moved))
    else:
        known = mass.select("x", F.lit(None).cast("long").alias("y"), F.col("ends").alias("w"), F.xxhash64("x").alias("mix"))
        rest = links.select("x", "y", "w", F.lit(None).cast("long").alias("mix")).unionByName(known).repartition(1)
        label = cut(renamed(label, "community", cut(rest.mapInArrow(merging(m), "x long, to long"))))
    named = label.groupBy("community").agg(F.min("node").alias("least"))
    return label.join(named, "community").select("node", F.col("least").alias("community"))


def _merged(links: DataFrame, mass: DataFrame, m: int) -> DataFrame:
    """``x, to``: the communities that one round of ``communities`` merges into others."""
    gain = 2 * m * F.col("w") - F.col("ends") * F.col("ends_y")
    known = links.join(mass, "x").join(mass.select(F.col("x").alias("y"), F.col("ends").alias("ends_y")), "y").withColumn("gain", gain)
    order = F.struct(F.col("gain"), F.xxhash64("x").bitwiseXOR(F.xxhash64("y")).alias("h"), F.col("y"))
    best = known.groupBy("x").agg(F.max(order).alias("o"), F.max_by(F.struct("ends", "ends_y", "w"), order).alias("p"), F.count(F.lit(1)).alias("k"))
    pick = cut(best.filter("o.gain > 0").select("x", F.col("o.y").alias("y"), "p.ends", "p.ends_y", "p.w", "k"))
    mutual = pick.join(pick.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"])
    pairs = mutual.filter("x < y").select(F.col("y").alias("x"), F.col("x").alias("to"), (F.col("ends") + F.col("ends_y")).alias("held"))
    into = pairs.select(F.col("x").alias("y"), "to", "held").unionByName(pairs.select(F.col("to").alias("y"), "to", "held"))
    alone = pick.filter("k = 1").join(mutual.select("x"), "x", "left_anti").join(into, "y", "left").select(
        "x", "ends", "w", F.coalesce("to", "y").alias("to"), F.coalesce("held", "ends_y").alias("held")
    )
    crowd = alone.groupBy("to").agg(F.sum("ends").alias("more"))
    joins = alone.join(crowd, "to").filter(2 * m * F.col("w") - F.col("ends") * (F.col("held") + F.col("more") - F.col("ends")) > 0).select("x", "to")
    return cut(pairs.select("x", "to").unionByName(joins))


def community_ranks(community: DataFrame) -> DataFrame:
    """``community, rank, size``: communities by size, the largest 0, ties by name."""
    sizes = community.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return with_rank(sizes, [F.desc("size"), F.asc("community")], "rank")


def dense_members(pairs: DataFrame, community: DataFrame, least: float = 0.9) -> DataFrame:
    """Nodes with two or more neighbours of which at least ``least`` are in the node's own community."""
    ways = both_ways(pairs)
    joined = ways.join(community, "node").join(community.select(F.col("node").alias("other"), F.col("community").alias("theirs")), "other")
    share = F.avg((F.col("community") == F.col("theirs")).cast("int"))
    return joined.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n_neighbours"), F.round(share, 6).alias("share")).filter((F.col("n_neighbours") >= 2) & (F.col("share") >= least))


def held_out(pairs: DataFrame, share: float = 0.4) -> DataFrame:
    """Edges with ``held``: every stride-th in the order of their ends, the stride being the edges over their ``share``, rounded down."""
    n = pairs.count()
    stride = max(1, n // max(1, int(n * share)))
    return with_rank(pairs, [F.asc("a"), F.asc("b")], "place").withColumn("held", F.col("place") % stride == 0).drop("place")


def strongest_neighbours(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Per node its ``k`` neighbours of highest confidence (None: all) and how many more there are."""
    real = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    ways = real.select(F.col("src").alias("node"), F.col("dst").alias("other"), "confidence").unionByName(real.select(F.col("dst").alias("node"), F.col("src").alias("other"), "confidence"))
    best = ways.groupBy("node", "other").agg(F.max("confidence").alias("confidence"))
    order = W.partitionBy("node").orderBy(F.desc("confidence"), "other")
    top = best.withColumn("place", F.row_number().over(order))
    if k is None:
        return top.select("node", "place", "other", "confidence", F.lit(0).cast("long").alias("n_more"))
    # the filter on row_number becomes a group limit before the shuffle, so a hub sends only k rows a task
    top = top.filter(F.col("place") <= k)
    more = best.groupBy("node").agg(F.count(F.lit(1)).alias("n_all"))
    return top.join(more, "node").select("node", "place", "other", "confidence", (F.col("n_all") - F.least(F.col("n_all"), F.lit(k))).alias("n_more"))
