import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from caselattice.operators import funds
from caselattice.operators.chains import event_chains, path_totals, rapid_paths
from caselattice.operators.components import connected_components
from caselattice.operators.intervals import overlap_join, points_in
from caselattice.plans import temporal

START = datetime(2025, 1, 1)


def union(pairs, nodes=()):
    up = {n: n for n in nodes}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in up}


def test_components_of_chains_and_hubs(spark):
    pairs = [(f"p{i:04}", f"p{i + 1:04}") for i in range(120)] + [("hub", f"h{i}") for i in range(60)] + [("x", "x"), (None, "y"), ("p0003", "p0004")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    expected = union([p for p in pairs if None not in p and p[0] != p[1]])
    least = {}
    for n, r in expected.items():
        least[r] = min(least.get(r, n), n)
    assert got == {n: least[r] for n, r in expected.items()}


def test_isolated_and_empty(spark, rows):
    empty = spark.createDataFrame([], "src string, dst string")
    assert rows(connected_components(empty)) == []
    assert rows(connected_components(empty, spark.createDataFrame([("a",), (None,)], "n string"))) == [("a", "a")]


def test_chains_equal_all_pairs(spark):
    rng = random.Random(3)
    for _ in range(3):
        events = [(f"e{i:02}", START + timedelta(minutes=rng.randrange(0, 400)), [rng.choice("abcd"), rng.choice("abcd")]) for i in range(25)]
        pairs = [(x[0], y[0]) for x, y in itertools.combinations(events, 2) if set(x[2]) & set(y[2]) and abs(x[1] - y[1]) <= timedelta(minutes=30)]
        df = spark.createDataFrame(events, "event_id string, ts timestamp_ntz, participants array<string>")
        got = {r["event_id"]: r["chain"] for r in event_chains(df, 1800).collect()}
        assert got == {n: min(m for m, s in union(pairs).items() if s == r) for n, r in union(pairs).items()}


def brute_paths(hops, span, most):
    found = set()

    def walk(path, tail, lo, hi, n):
        if n >= 2:
            found.add(tuple(sorted(set(path))))
        if n == most or (n > 1 and hi - lo >= span):
            return
        for a, b, t in hops:
            if a == tail and max(hi, t) - min(lo, t) <= span:
                walk([*path, b], b, min(lo, t), max(hi, t), n + 1)

    for a, b, t in hops:
        walk([a, b], b, t, t, 1)
    return found


def test_rapid_paths_equal_search(spark):
    rng = random.Random(5)
    moves = [(rng.choice("ABCDE"), rng.choice("ABCDE"), START + timedelta(hours=rng.randrange(0, 200))) for _ in range(14)]
    moves.append((moves[0][1], "Z", moves[0][2] + timedelta(hours=48)))  # exactly on the boundary
    got = {tuple(r["accounts"].split(",")) for r in rapid_paths(spark.createDataFrame(moves, "src string, dst string, ts timestamp_ntz"), 48, 4).collect()}
    assert got == brute_paths([(a, b, (t - START).total_seconds()) for a, b, t in moves], 48 * 3600, 4)


def test_interval_joins(spark):
    rng = random.Random(7)
    a = [(i, rng.choice("xy"), s := rng.randrange(100), s + rng.randrange(0, 40)) for i in range(30)] + [(99, "x", 50, 40), (98, None, 1, 2)]
    b = [(i, rng.choice("xy"), s := rng.randrange(100), s + rng.randrange(0, 9)) for i in range(30)]
    left, right = spark.createDataFrame(a, "l long, k string, s long, e long"), spark.createDataFrame(b, "r long, k string, u long, v long")
    expected = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["l"], r["r"]) for r in overlap_join(left, right, "k", 10, "s", "e", "u", "v").collect()) == expected
    inside = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[2] <= x[3])
    assert sorted((r["l"], r["r"]) for r in points_in(right, left, "k", 10, "u", "s", "e").collect()) == inside


def test_calls_of_any_length_are_in_chains(spark, rows, tmp_path, monkeypatch):
    ts = lambda minute: datetime(2024, 1, 1, 10, minute)
    called = [("c1", "p", "q", ts(0), 20), ("c2", "q", "r", ts(20), None), ("c3", "r", "s", ts(45), 900), ("c4", "x", "y", ts(0), 5)]
    paid = [("t1", "A1", "A2", ts(50), 1.0)]
    monkeypatch.setattr(temporal, "calls", lambda *_: spark.createDataFrame(called, "call_id string, caller string, callee string, ts timestamp_ntz, duration_s int"))
    monkeypatch.setattr(temporal, "transfers", lambda *_: spark.createDataFrame(paid, "txn_id string, src string, dst string, ts timestamp_ntz, amount double"))
    spark.createDataFrame([("S", "s", "A1")], "person_id string, phone string, account string").write.parquet(f"{tmp_path}/subscribers.parquet")
    assert rows(temporal.event_chain_sizes(spark, str(tmp_path))) == [("c1", 4)]
    assert rows(temporal.pivot_steps(spark, str(tmp_path)), "chain", "n_steps") == [("c1", 4)]


def _long_calls(spark, monkeypatch):
    """Two calls of 40 and 45 minutes at one tower, longer than microseconds in 32 bits."""
    called = [("c1", "p", "q", datetime(2024, 1, 1, 10), 2400, "T"), ("c2", "q", "r", datetime(2024, 1, 1, 10, 1), 2700, "T")]
    monkeypatch.setattr(temporal, "calls", lambda *_: spark.createDataFrame(called, "call_id string, caller string, callee string, ts timestamp_ntz, duration_s int, place string"))


def test_overlap_of_calls_above_2147_seconds(spark, rows, monkeypatch):
    _long_calls(spark, monkeypatch)
    iou = round((2400 - 60) / (60 + 2700), 6)
    assert rows(temporal.interval_overlap_best(spark, "")) == [("c1", "c2", iou), ("c2", "c1", iou)]


def test_transfer_late_in_a_call_above_2147_seconds(spark, rows, tmp_path, monkeypatch):
    _long_calls(spark, monkeypatch)
    paid = [("t1", "A1", "A2", datetime(2024, 1, 1, 10, 40), 1.0), ("t2", "A1", "A2", datetime(2024, 1, 1, 10, 41), 1.0)]
    monkeypatch.setattr(temporal, "transfers", lambda *_: spark.createDataFrame(paid, "txn_id string, src string, dst string, ts timestamp_ntz, amount double"))
    spark.createDataFrame([("S", "p", "A1")], "person_id string, phone string, account string").write.parquet(f"{tmp_path}/subscribers.parquet")
    assert rows(temporal.point_in_interval(spark, str(tmp_path))) == [("c1", "t1", 1)]


def test_sets_of_paths_are_counted_without_a_list(spark, rows):
    """As many sets an account as listed, loops, returns and a span used up before the last transfer included."""
    for seed, n in ((1, 5), (2, 9)):
        rng = random.Random(seed)
        moves = [(rng.choice("ABCDEFGHI"[:n]), rng.choice("ABCDEFGHI"[:n]), START + timedelta(hours=rng.randrange(0, 150))) for _ in range(18)]
        moves += [(moves[0][1], "Z", moves[0][2] + timedelta(hours=48)), ("Z", "Y", moves[0][2]), (None, "A", START), ("A", "B", None), moves[3]]
        transfers = spark.createDataFrame(moves, "src string, dst string, ts timestamp_ntz")
        listed = {}
        for accounts in brute_paths([(a, b, (t - START).total_seconds()) for a, b, t in moves if a and t], 48 * 3600, 5):
            for a in accounts:
                listed[a] = listed.get(a, 0) + 1
        assert dict(rows(path_totals(transfers, 48, 5))) == dict(rows(path_totals(transfers, 48, 5, held=0))) == listed
    assert rows(path_totals(transfers.limit(0), 48, 5)) == []


def _listed(moves, hops, n):
    """The sets of ``funds.Walks`` over moves ``(src, dst, hour)`` of accounts by number; each is listed once and counted so often."""
    columns = np.array(sorted(set(moves)), np.int64).reshape(-1, 3).T
    walks = funds.Walks(*columns, 48, hops, n)
    found, total = [], np.zeros(n, np.int64)
    for least in range(9 if n > 9 else n):
        for got in walks.sets(least):
            found += zip(*(c.tolist() for c in got), strict=True)
        if n == 9:
            walks.count(least, total)
    assert n != 9 or total.tolist() == [sum(a in x for x in found) for a in range(9)]
    assert len({frozenset(x) for x in found}) == len(found) and all(len(set(x)) == len(x) for x in found)
    return {tuple(sorted(x)) for x in found}


@pytest.mark.parametrize(("few", "n"), [(20_000, 9), (0, 9), (0, 50_000), (0, 1_000_000)])
def test_sets_of_paths_are_listed_over_arrays(few, n, monkeypatch):
    """The same sets with and without dropping wider walks, in one number or several, some at a time."""
    for name, value in (("FEW", few), ("ROWS", 50), ("KEPT", 20), ("GIVEN", 3)):
        monkeypatch.setattr(funds, name, value)
    for seed in range(30 if n == 9 else 5):
        rng = random.Random(seed)
        moves = [(rng.randrange(9), rng.randrange(9), rng.choice((0, 12, 24, 48, 60, rng.randrange(0, 150)))) for _ in range(16)]
        got = _listed(moves, 5, n)
        assert got == {tuple(sorted(x)) for x in brute_paths(moves, 48, 5)}


def test_many_transfers_of_few_accounts_are_not_walked_one_by_one():
    """Some 10^11 walks, whose times enclose those of others."""
    got = _listed([(a, b, t) for a in range(3) for b in range(3) if a != b for t in range(200)], 5, 3)
    assert got == {(0, 1), (0, 2), (1, 2), (0, 1, 2)}


def test_listed_paths_equal_joined_ones(spark, rows):
    """Names of any length and script, loops and returns; more than one digit to a number of 64 bits."""
    names = ["A", "B1", "C22", "D333", "\u00c9", "\u0928\u0926", "AA", "\U00010400"]
    for used in (names, [f"N{i}" for i in range(8)]):
        rng = random.Random(4)
        moves = [(rng.choice(used), rng.choice(used), START + timedelta(hours=rng.randrange(0, 150))) for _ in range(30)] + [(None, used[0], START), (used[0], used[1], None)]
        transfers = spark.createDataFrame(moves, "src string, dst string, ts timestamp_ntz")
        listed = rows(rapid_paths(transfers, 48, 5))
        assert len(listed) == len(set(listed)) and sorted(listed) == sorted(rows(rapid_paths(transfers, 48, 5, held=0)))
    assert rows(rapid_paths(transfers.limit(0), 48, 5)) == []
