from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caselattice.operators import patterns as P
from caselattice.operators.rolling import first_over, forward_counts

START = datetime(2025, 1, 1)
EVENTS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 400))), max_size=40)


def frame(spark, events):
    rows = [(f"{i:03}", k, None if m is None else START + timedelta(minutes=m)) for i, (k, m) in enumerate(events)]
    return rows, spark.createDataFrame(rows, "id string, k string, ts timestamp_ntz")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=EVENTS)
def test_counts_equal_brute_force(spark, events):
    rows, df = frame(spark, events)
    good = [(i, k, t) for i, k, t in rows if k is not None and t is not None]
    width = timedelta(minutes=30)
    expected = {i: sum(k2 == k and t <= t2 <= t + width for _, k2, t2 in good) for i, k, t in good}
    got = {r["id"]: r["n_window"] for r in forward_counts(df, "k", "ts", 1800, "id").collect()}
    assert got == expected
    by_place = {}
    for k in ("a", "b"):
        seq = sorted((t, i) for i, k2, t in good if k2 == k)
        for n, (t, i) in enumerate(seq):
            by_place[i] = sum(t2 <= t + width for t2, _ in seq[n:])
    assert {r["id"]: r["n_window"] for r in forward_counts(df, "k", "ts", 1800, "id", ties="index").collect()} == by_place


def test_first_over(spark):
    df = spark.createDataFrame([("a", START, 5.0, "2"), ("a", START, 9.0, "1"), ("b", START, 1.0, "3"), ("c", None, None, "4")], "k string, ts timestamp_ntz, v double, id string")
    assert [tuple(r) for r in first_over(df, "k", "ts", "v", 5.0, "id").collect()] == [("a", START, "1", 9.0)]


@pytest.mark.parametrize("minutes, flagged", [((0, 10, 20, 30, 40), True), ((0, 1500, 3000, 4500, 6000), False)])
def test_spike_planted_and_clean(spark, minutes, flagged):
    rows = [("p", f"c{i}", START + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "phone string, call_id string, ts timestamp_ntz")
    assert (P.communication_spikes(df).count() == 1) is flagged


def test_colocation_equals_pairs(spark):
    rows = [(p, f"{p}{i}", START + timedelta(hours=7 * i + len(p)), place) for i in range(12) for p in ("x", "yy", "zzz") for place in ("T1",) if (i + len(p)) % 3]
    df = spark.createDataFrame(rows, "phone string, call_id string, ts timestamp_ntz, place string")
    expected = {}
    for p, _, t, place in rows:
        near = sum(q != p and abs(u - t) <= timedelta(hours=24) and w == place for q, _, u, w in rows)
        if near:
            n, total = expected.get((p, place), (0, 0))
            expected[p, place] = n + 1, total + near
    assert {(r["phone"], r["place"]): (r["n_calls"], r["n_near"]) for r in P.colocations(df).collect()} == expected


def test_off_hours_golden_row(spark):
    hours = [23] * 6 + [12] * 11
    df = spark.createDataFrame([("p", START.replace(hour=h)) for h in hours], "phone string, ts timestamp_ntz")
    [r] = P.off_hour_motifs(df).collect()
    assert (r["n_off"], r["n_peak"], r["ratio"]) == (6, 11, 1.6364)


def test_empty_tables_give_no_rows(spark):
    parties = spark.createDataFrame([], "phone string, call_id string, ts timestamp_ntz, duration_s int, place string")
    moves = spark.createDataFrame([], "txn_id string, src string, dst string, ts timestamp_ntz, amount double, remarks string")
    for df in (P.communication_spikes(parties), P.burst_scores(parties), P.off_hour_motifs(parties), P.colocations(parties), P.frequency_anomalies(moves), P.fan_in(moves), P.transfer_profiles(moves), P.large_singles(moves)):
        assert df.count() == 0
