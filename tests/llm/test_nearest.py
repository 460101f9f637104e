from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caselattice.llm.nearest import nearest_in_time

START = datetime(2025, 3, 1)
SIDE = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 90))), max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=SIDE, right=SIDE)
def test_equals_brute_force(spark, left, right):
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    ls = [(f"t{i:02}", s, at(m)) for i, (s, m) in enumerate(left)]
    rs = [(f"c{i:02}", s, at(m)) for i, (s, m) in enumerate(right)]
    expected = {}
    for t, s, m in ls:
        near = [(abs(m - n), n, c) for c, r, n in rs if s and r == s and m and n and abs(m - n) <= timedelta(minutes=15)]
        if near:
            expected[t] = min(near)[2]
    # clashing extra columns, and every left row twice
    a = spark.createDataFrame(ls * 2, "txn string, subject string, at timestamp_ntz").selectExpr("*", "1 AS t", "2 AS cell")
    b = spark.createDataFrame(rs, "call string, subject string, at timestamp_ntz").selectExpr("*", "1 AS low", "2 AS cell")
    got = nearest_in_time(a, b, 900, "txn", "call").collect()
    assert {r["txn"]: r["call"] for r in got} == expected and len(got) == len(expected)


def test_bounds_and_ties(spark):
    t = START
    calls = [("late", "s", t + timedelta(seconds=100)), ("early", "s", t - timedelta(seconds=100)), ("same2", "s", t + timedelta(hours=1)), ("same1", "s", t + timedelta(hours=1))]
    moves = [("tie", "s", t), ("edge", "s", t + timedelta(seconds=1000)), ("out", "s", t + timedelta(seconds=1001)), ("twin", "s", t + timedelta(hours=1, minutes=15)), ("far", "s", t + timedelta(hours=1, seconds=901))]
    a, b = spark.createDataFrame(moves, "txn string, subject string, at timestamp_ntz"), spark.createDataFrame(calls, "call string, subject string, at timestamp_ntz")
    got = {r["txn"]: (r["call"], r["gap_us"]) for r in nearest_in_time(a, b, 900, "txn", "call").collect()}
    assert got == {"tie": ("early", 100_000_000), "edge": ("late", 900_000_000), "twin": ("same1", 900_000_000)}


def test_hot_subject_is_split_over_cells(spark):
    calls = spark.range(4000).selectExpr("concat('c', id) AS call", "'hot' AS subject", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 60) AS at")
    moves = spark.range(200).selectExpr("concat('t', id) AS txn", "'hot' AS subject", "timestamp_ntz'2025-01-01 00:00:20' + make_interval(0,0,0,0,0,id * 1200) AS at")
    got = {r["txn"]: r["call"] for r in nearest_in_time(moves, calls, 900, "txn", "call").collect()}
    assert got == {f"t{i}": f"c{i * 20}" for i in range(200)}


def test_owners_too_many_to_broadcast(spark, rows):
    from caselattice.llm.corpus_nearest import owned

    calls = spark.createDataFrame([(f"c{i}", "hot" if i < 30 else f"k{i}") for i in range(40)] + [("n", None)], "id string, key string")
    owners = spark.createDataFrame([("hot", "p"), ("hot", "q"), ("k31", "r")], "key string, subject string")
    assert rows(owned(calls, owners, 1)) == rows(owned(calls, owners))
