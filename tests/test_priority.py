import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from caselattice.config import RULES
from caselattice.plans import patterns


def test_priority_has_every_term(spark):
    """Betweenness, PageRank, degree and all flags count, with their evidence."""
    queries = contract.queries()
    got = queries["priority_score"](spark, contract.DATA).collect()
    between = {r["node"]: r["betweenness"] for r in queries["betweenness"](spark, contract.DATA).collect()}
    dense = {r["node"] for r in queries["dense_cluster"](spark, contract.DATA).collect()}
    assert dense and [r["priority"] for r in got] == sorted((r["priority"] for r in got), reverse=True)
    for r in got:
        # at this size every node is a pivot, so betweenness is exact
        if r["node"] in between:
            assert r["betweenness"] == pytest.approx(between[r["node"]], abs=2e-6)
        assert ("DENSE_CLUSTER_MEMBERSHIP" in r["flags"]) == (r["node"] in dense)
        others = RULES.weight_degree * r["degree"] + RULES.weight_betweenness * r["betweenness"] + RULES.weight_pagerank * r["rank"]
        if not r["flags"]:
            assert r["priority"] == pytest.approx(others, abs=1e-4)
        else:
            assert r["priority"] >= others + RULES.weight_flags / RULES.flags_for_full - 2e-4
            assert all(f in r["evidence"] for f in r["flags"].split(","))


def _unlisted(monkeypatch):
    def listed(*_):
        raise AssertionError("the fund paths are listed")

    monkeypatch.setattr(patterns, "rapid_paths", listed)


def test_flagged_entities_list_no_fund_paths(spark, rows, monkeypatch):
    ranked = patterns.flag_ranking(spark, contract.DATA).join(patterns.carriers(spark, contract.DATA), "key")
    expected = rows(ranked, "entity_id", "type", "key", "flags", "n_flags", "flag_score")
    assert any("RAPID_FUND_MOVEMENT" in r[3] for r in expected)
    _unlisted(monkeypatch)
    assert rows(contract.queries()["flagged_entities"](spark, contract.DATA)) == expected


def test_flagged_bundles_list_no_fund_paths(spark, rows, monkeypatch):
    ranked = patterns.flag_ranking(spark, contract.DATA).join(patterns.carriers(spark, contract.DATA), "key")
    expected = rows(ranked, "entity_id", "key", "flags", "n_flags")
    _unlisted(monkeypatch)
    assert rows(contract.queries()["flagged_bundles"](spark, contract.DATA), "entity_id", "key", "flags", "n_flags") == expected


def test_flagged_bundles_hold_all_edges_and_neighbours(spark, rows, tmp_path):
    """A flagged phone with more edges than a short list would hold, one of them a loop and one a repeated pair."""
    for name in ("cdr", "bank_transactions", "subscribers", "documents"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{contract.DATA}/{name}.parquet")
    key = patterns.key_totals(spark, str(tmp_path)).filter("flags LIKE '%COMMUNICATION_SPIKE%'").agg(F.min("key")).first()[0]
    entities, edges = (spark.read.parquet(f"{contract.DATA}/{name}.parquet") for name in ("entities", "edges"))
    known = [("hub", "PHONE", key)] + [(f"n{i:02}", "PERSON", f"N {i}") for i in range(40)]
    spark.createDataFrame(known, "entity_id string, type string, name string").join(entities.limit(0).drop("type", "name"), "entity_id", "left").write.parquet(f"{tmp_path}/entities.parquet")
    others = [f"n{i:02}" for i in range(40)] + ["hub", "n07"]
    ends = [(900 - i, *(("hub", x) if i % 2 else (x, "hub")), (i % 7) / 10 if i % 5 else None, "CALLED" if i < 41 else "OWNS") for i, x in enumerate(others)]
    made = spark.createDataFrame(ends, "edge_id long, source string, target string, confidence double, relationship string")
    made.join(edges.limit(0).drop("source", "target", "confidence", "relationship"), "edge_id", "left").write.parquet(f"{tmp_path}/edges.parquet")
    near = {x: max([c for _, a, b, c, _ in ends if x in (a, b) and c is not None], default=-1.0) for x in others if x != "hub"}
    expected = (len(ends), ",".join(str(e[0]) for e in reversed(ends)), ",".join(sorted(near, key=lambda x: (-near[x], x))), 40)
    got = contract.queries()["flagged_bundles"](spark, str(tmp_path)).filter("entity_id = 'hub'")
    assert rows(got, "n_edges", "edges", "neighbours", "n_neighbours") == [expected]
