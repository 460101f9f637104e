from datetime import datetime

from caselattice.operators.references import Child, Parent, orphan_references, orphan_report

PARENT = "id string, loaded timestamp_ntz, gone timestamp_ntz, extra int"
CHILD = "rid long, ref string, at timestamp_ntz, extra string"
T = datetime(2025, 10, 10)


def day(n):
    return datetime(2025, 10, n)


def run(spark, parents, children):
    p = Parent("s", spark.createDataFrame(parents, PARENT), "id", "loaded", "gone")
    return orphan_references([p], [Child("edges", "s", spark.createDataFrame(children, CHILD), "ref", "rid", "at")])


def test_every_status_and_no_reference(spark, rows):
    parents = [("A", day(1), None, 0), (" b ", day(1), day(5), 0), ("C", day(20), None, 0), (None, day(1), None, 0), ("", day(1), None, 0)]
    children = [
        (1, "a ", T, "x"), (2, "B", T, "x"), (3, "b", day(4), None), (4, "c", T, ""), (5, "zz", T, ""), (6, None, T, ""), (7, "  ", T, ""),
        (8, "zz", None, ""), (9, "B", None, ""), (5, "zz", T, ""), (10, "b", day(5), ""), (11, "c", day(20), ""),
    ]
    assert rows(run(spark, parents, children), "ref_id", "status", "period") == sorted(
        [(2, "deleted", "2025-10"), (4, "late", "2025-10"), (5, "missing", "2025-10"), (8, "missing", "unknown"), (10, "deleted", "2025-10")], key=repr
    )


def test_empty_tables(spark, rows):
    assert rows(run(spark, [], [(1, "a", T, "")]), "ref_id", "status") == [(1, "missing")]
    assert rows(run(spark, [("A", T, None, 0)], [])) == []


def test_hot_key_is_whole(spark):
    children = [(i, "hot", T, "") for i in range(3000)] + [(9000 + i, f"k{i}", T, "") for i in range(50)]
    found = run(spark, [("k1", day(1), None, 0)], children)
    assert found.count() == 3049
    report = {(r["status"], r["period"]): r["n_refs"] for r in orphan_report(found).collect()}
    assert report == {("missing", "2025-10"): 3049}
