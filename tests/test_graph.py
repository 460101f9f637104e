import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from caselattice.operators import graph as G

EDGE = "edge_id long, src string, dst string, relationship string, ts timestamp_ntz, source_record string, confidence double, weight double"
VERTEX = "entity_id string, type string, name string, aliases array<string>, source_documents array<string>, confidence double"


def graph(spark):
    people = [("A", "PERSON"), ("B", "PERSON"), ("C", "PERSON"), ("ph", "PHONE"), ("lo", "LOCATION"), ("ac", "ACCOUNT"), ("is", "ORGANIZATION")]
    vertices = spark.createDataFrame([(i, t, i, None, ["FIR_1"] if i in "AB" else ["FIR_2"], 0.5) for i, t in people], VERTEX)
    ends = [("A", "ph"), ("A", "B"), ("B", "lo"), ("B", "C"), ("C", "ac"), ("A", "B"), ("A", "A"), (None, "B"), ("A", "gone")]
    edges = spark.createDataFrame([(i, a, b, "APPEARS_IN_SAME_DOCUMENT", None, "FIR_1" if i == 1 else None, 0.4, 1.0) for i, (a, b) in enumerate(ends)], EDGE)
    return vertices, edges


def test_build_keeps_and_rejects(spark, rows):
    vertices, edges = graph(spark)
    kept, rejected = G.build(edges, vertices)
    assert rows(kept, "edge_id") == [(0,), (1,), (2,), (3,), (4,), (5,), (6,)] or len(rows(kept)) == 7
    assert rows(rejected, "edge_id", "unknown") == [(7, "source"), (8, "target")]


def test_types_follow_record_then_pair(spark):
    vertices, edges = graph(spark)
    kinds = {r["edge_id"]: r["kind"] for r in G.typed(edges, vertices).collect()}
    assert kinds[0] == "OWNS" and kinds[1] == "APPEARS_IN_CASE" and kinds[2] == "LOCATED_AT" and kinds[3] == "ASSOCIATED_WITH"
    shown = edges.filter("edge_id < 4").withColumn("relationship", F.lit("LOCATED_AT")).withColumn("confidence", F.lit(0.9))
    assert {r["kind"] for r in G.typed(shown, vertices).collect()} == {"LOCATED_AT"}
    record = edges.filter("edge_id = 0").withColumn("source_record", F.lit("transaction_7")).withColumn("confidence", F.lit(0.9))
    assert [(r["kind"], r["strength"]) for r in G.typed(record, vertices).collect()] == [("TRANSFERRED_MONEY_TO", 1.0)]


def test_degree_and_distance(spark):
    vertices, edges = graph(spark)
    pairs = G.simple_pairs(G.build(edges, vertices)[0])
    degree = {r["node"]: (r["n_neighbours"], r["degree"]) for r in G.degrees(pairs, vertices).collect()}
    assert degree["B"] == (3, 0.5) and degree["is"] == (0, 0.0)
    hops = {r["node"]: r["hops"] for r in G.hop_distances(pairs, spark.createDataFrame([("ph",)], "n string"), 9).collect()}
    assert hops == {"ph": 0, "A": 1, "B": 2, "lo": 3, "C": 3, "ac": 4}


def test_link_score_golden_row(spark):
    pairs = spark.createDataFrame([("a", "v"), ("b", "v"), ("a", "w"), ("v", "z")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in G.link_scores(pairs, 0.0).collect()}
    r = got["a", "b"]
    assert r["cn"] == 1 and r["aa"] == round(1 / math.log(3), 6) and r["jaccard"] == 0.5
    assert ("a", "v") not in got


def test_hub_neighbours_are_counted_for_other_pairs(spark):
    pairs = [("hub", f"n{i}") for i in range(9)] + [("m", "n0"), ("m", "n1")]
    df = spark.createDataFrame([tuple(sorted(p)) for p in pairs], "a string, b string")
    limited = {(r["a"], r["b"]): r["cn"] for r in G.shared_neighbours(df, hub=5).collect()}
    assert limited[("n0", "n1")] == 2
    assert G.hub_members(df, 5).count() == 9


def test_pagerank_sums_to_one_and_prefers_the_target(spark):
    edges = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("c", "t", 2.0), ("t", "a", 1.0)], "src string, dst string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("t",), ("alone",)], "n string")
    rank = {r["node"]: r["rank"] for r in G.pagerank(edges, nodes).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and max(rank, key=rank.get) == "t" and rank["b"] == pytest.approx(rank["alone"])


def brandes(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    between, n = dict.fromkeys(near, 0.0), len(near)
    for s in near:
        hops, ways, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in near[v]:
                if w not in hops:
                    hops[w], ways[w], before[w] = hops[v] + 1, 0.0, []
                    order.append(w)
                if hops[w] == hops[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        credit = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                credit[v] += ways[v] / ways[w] * (1 + credit[w])
            if w != s:
                between[w] += credit[w]
    return {v: round(b / ((n - 1) * (n - 2)), 6) for v, b in between.items()}


def test_path_centrality(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r["node"]: (r["betweenness"], r["closeness"]) for r in G.path_centrality(line, line.select("a")).collect()}
    assert got["b"] == (round(2 / 3, 6), 0.75) and got["a"] == (0.0, 0.5)
    rng = random.Random(1)
    edges = sorted({tuple(sorted((f"n{rng.randrange(14)}", f"n{rng.randrange(14)}"))) for _ in range(24)})
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["betweenness"] for r in G.path_centrality(spark.createDataFrame(edges, "a string, b string"), line.limit(0).select("a"), block=6).collect()}
    assert got == pytest.approx(brandes(edges), abs=2e-6)


def test_communities_of_two_cliques(spark):
    clique = lambda s: [(f"{s}{i}", f"{s}{j}") for i in range(4) for j in range(i + 1, 4)]
    pairs = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0")], "a string, b string")
    found = G.communities(pairs)
    got = {r["node"]: r["community"] for r in found.collect()}
    assert {got[f"a{i}"] for i in range(4)} == {"a0"} and {got[f"b{i}"] for i in range(4)} == {"b0"}
    assert {r["node"] for r in G.dense_members(pairs, found).collect()} == {"a1", "a2", "a3", "b1", "b2", "b3"}
    assert {(r["community"], r["rank"], r["size"]) for r in G.community_ranks(found).collect()} == {("a0", 0, 4), ("b0", 1, 4)}


def modularity(edges, label):
    m, inside, ends = len(edges), 0, {}
    for a, b in edges:
        inside += label[a] == label[b]
        for v in (a, b):
            ends[label[v]] = ends.get(label[v], 0) + 1
    return inside / m - sum((d / (2 * m)) ** 2 for d in ends.values())


def greedy(edges):
    """The best single merger again and again."""
    label = {v: v for e in edges for v in e}
    best = modularity(edges, label)
    while True:
        tries = [(modularity(edges, {v: (x if c == y else c) for v, c in label.items()}), x, y) for x, y in {(label[a], label[b]) for a, b in edges if label[a] != label[b]}]
        if not tries or max(tries)[0] <= best + 1e-12:
            return best
        best, x, y = max(tries)
        label = {v: (x if c == y else c) for v, c in label.items()}


def test_communities_are_as_good_as_single_mergers(spark):
    rng = random.Random(9)
    edges = set()
    while len(edges) < 40:
        g = rng.randrange(4)
        a, b = (f"v{g}{rng.randrange(6)}" for _ in range(2)) if rng.random() < 0.85 else (f"v{rng.randrange(4)}{rng.randrange(6)}" for _ in range(2))
        if a != b:
            edges.add(tuple(sorted((a, b))))
    edges = sorted(edges)
    label = {r["node"]: r["community"] for r in G.communities(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert modularity(edges, label) >= 0.93 * greedy(edges)


def test_a_hub_loses_no_pair(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted((rng.choice("hub h2".split() + [f"n{i}" for i in range(7)]), f"n{rng.randrange(7)}"))) for _ in range(26)})
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a string, b string")
    whole = {(r["a"], r["b"]): r["cn"] for r in G.link_scores(df, 0.0, 1_000).collect()}
    cut = G.link_scores(df, 0.0, 3).collect()
    near = {}
    for r in cut:
        if r["kind"] == "hub":
            near.setdefault(r["b"], set()).add(r["a"])
    pairs = {(r["a"], r["b"]): r["cn"] for r in cut if r["kind"] == "pair"}
    for a, b in itertools.combinations(sorted(near), 2):
        if (a, b) not in pairs and (a, b) not in edges and near[a] & near[b]:
            pairs[a, b] = len(near[a] & near[b])
    assert pairs == whole


def test_cooccurrences_and_hub_documents(spark, rows):
    vertices = spark.createDataFrame([(f"e{i}", "PERSON", "n", None, ["d1", "d1"] if i < 3 else ["d2"], 0.1 * i) for i in range(9)], VERTEX)
    found = G.cooccurrences(vertices, largest=4)
    assert rows(found.filter("kind = 'pair'"), "a", "b") == [("e0", "e1"), ("e0", "e2"), ("e1", "e2")]
    assert rows(found.filter("kind = 'member'"), "doc", "b") == [("d2", f"e{i}") for i in range(3, 9)]


def test_shortest_path_rows(spark, rows):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("q", "r")], "a string, b string")
    assert rows(G.shortest_path(pairs, "a", "d")) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert rows(G.shortest_path(pairs, "a", "q")) == []


def test_held_out_by_stride(spark, rows):
    pairs = spark.createDataFrame([(f"a{i}", "z") for i in range(8)], "a string, b string")
    assert [r[0] for r in rows(G.held_out(pairs).filter("held"), "a")] == ["a0", "a2", "a4", "a6"]


def test_strongest_neighbours(spark, rows):
    edges = spark.createDataFrame([(i, "x", f"n{i}", "R", None, None, i / 10, 1.0) for i in range(5)], EDGE)
    assert rows(G.strongest_neighbours(edges, 2).filter("node = 'x'"), "place", "other", "n_more") == [(1, "n4", 3), (2, "n3", 3)]


def _tangle(spark, seed, n, m):
    rng = random.Random(seed)
    edges = {tuple(sorted((f"n{int(n * rng.random() ** 2):03}", f"n{rng.randrange(n):03}"))) for _ in range(m)}
    return spark.createDataFrame(sorted((a, b) for a, b in edges if a != b) + [("x", "y"), ("y", "z"), ("y", "w")], "a string, b string")


def test_communities_in_one_task_are_those_of_joins(spark, rows):
    """The rounds that one task does are those of the joins; the task needs one job where the joins need some for every round."""
    pairs = _tangle(spark, 1, 20, 40)
    held = rows(G.communities(pairs))
    assert held == rows(G.communities(pairs, held=0)) == rows(G.communities(pairs, held=12))  # the last: some rounds by joins, the rest in a task


def test_dense_members_of_a_thousand_rounds(spark):
    """A path takes a number of rounds that the joins cannot do in a time of use."""
    path = spark.range(4_000).selectExpr("format_string('p%05d', id) AS a", "format_string('p%05d', id + 1) AS b")
    found = G.communities(path)
    assert found.select("community").distinct().count() < 200 and found.count() == 4_001
    assert G.dense_members(path, found).count() > 3_600


def test_paths_in_tasks_are_those_of_joins(spark, rows):
    pairs, alone = _tangle(spark, 3, 14, 26), spark.createDataFrame([("lonely",)], "node string")
    for pivots in (None, 5):
        tasks = {r["node"]: (r["betweenness"], r["closeness"]) for r in G.path_centrality(pairs, alone, pivots).collect()}
        joins = {r["node"]: (r["betweenness"], r["closeness"]) for r in G.path_centrality(pairs, alone, pivots, held=0).collect()}
        assert tasks.keys() == joins.keys() and "lonely" in tasks
        for node, found in tasks.items():
            assert found == pytest.approx(joins[node], abs=2e-6)


def test_measures_of_a_graph_of_many_nodes_are_exact(spark, tmp_path):
    """Priorities and the table of centralities rest on paths from all nodes, as ``betweenness`` does."""
    rng = random.Random(11)
    names = [f"v{i:03}" for i in range(400)]
    ends = [(i, rng.choice(names), rng.choice(names)) for i in range(600)]
    entities, edges = (spark.read.parquet(f"{contract.DATA}/{name}.parquet").limit(0) for name in ("entities", "edges"))
    spark.createDataFrame([(v,) for v in names], "entity_id string").join(entities, "entity_id", "left").write.parquet(f"{tmp_path}/entities.parquet")
    made = spark.createDataFrame(ends, "edge_id long, source string, target string")
    made.join(edges.drop("source", "target"), "edge_id", "left").write.parquet(f"{tmp_path}/edges.parquet")
    queries = contract.queries()
    exact, table = ({r["node"]: (r["betweenness"], r["closeness"]) for r in queries[name](spark, str(tmp_path)).collect()} for name in ("betweenness", "centrality_table"))
    assert len(exact) == len(names) and len({b for b, _ in exact.values()}) > 100
    for node, values in exact.items():
        assert table[node] == pytest.approx(values, abs=2e-6)
