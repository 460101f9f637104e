from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselattice.functions import scalar as S
from caselattice.functions import text as T
from caselattice.operators import metrics as M
from caselattice.operators import resolve as E
from caselattice.operators import retrieval as R
from caselattice.operators import segments as G
from caselattice.operators.blocks import classify, line_blocks, rebuild, register
from caselattice.operators.validation import ENTITY_CHECKS, checked


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first()["v"]


def test_scalar_forms(spark):
    assert one(spark, S.phone_form, "+91 98765-43210") == "9876543210"
    assert one(spark, S.phone_form, "098765 43210") == "9876543210"
    assert one(spark, S.phone_form, "12345") is None and one(spark, S.phone_form, None) is None
    assert one(spark, S.account_form, " acc-12345 ") == "ACC12345" and one(spark, S.account_form, "--") is None
    assert one(spark, S.name_case, "  raNI  si DAS ") == "Rani SI Das"
    assert one(spark, S.plate_form, "ol-12 iq") == "011210"
    assert one(spark, S.clean, "a\x00 \t b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, lambda c: S.stable_id(F.lit("PERSON"), c), "x").startswith("PER_")
    assert one(spark, lambda c: S.clock(c.cast("double")), "125.9") == "02:05"
    assert one(spark, lambda c: S.first_timestamp(c, "yyyy-MM-dd HH:mm:ss"), "no date") is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [3.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    assert tuple(df.select(S.cosine("a", "b") if False else S.cosine(F.col("a"), F.col("b")), S.cosine(F.col("a"), F.col("c")), S.cosine(F.col("a"), F.col("z"))).first()) == (0.0, 1.0, 0.0)


def test_extraction(spark):
    text = "Call +91-9876543210 or 09876500000, ACC12345 paid Rs. 1,200 on 02-03-2024; car QX12AB1234."
    assert one(spark, lambda c: T.found(c, T.PHONE), text) == ["9876543210", "9876500000"]
    assert one(spark, lambda c: T.found(c, T.PHONE), "98765432101 and 9876543210,9876543211") == ["9876543210", "9876543211"]  # no phone inside a longer number
    assert one(spark, lambda c: T.found(c, T.PLATE), "QX12AB12345 xQX12AB1234 (QX12AB1234)") == ["QX12AB1234"]
    assert one(spark, T.accounts, "acc12345, ACC123456, ACC_dac31588, a/c no. 123456789012") == ["acc12345", "ACC_dac31588", "123456789012"]
    assert one(spark, lambda c: T.found(c, T.LISTED_NAME), "1. Rakesh\n 2. Anna-Maria Das") == ["Rakesh", "Anna-Maria Das"]
    assert one(spark, T.amounts, text) == [1200] and one(spark, lambda c: T.found(c, T.DATE), None) == []
    assert one(spark, T.mixed, "woh ghar par tha aur gaya") is True and one(spark, T.mixed, "plain words") is False
    assert one(spark, T.sentences, "One. Two!\nthree") == ["One.", "Two!", "three"]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000)) + "\nend"
    got = T.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "t", 400, 80).collect()
    assert {r["id"] for r in got} == {1} and [r["start"] for r in sorted(got, key=lambda r: r["start"])] == [0, 320, 640, 960]
    assert all(text[r["start"] : r["start"] + 400] == r["chunk"] for r in got)


def test_line_blocks(spark, rows):
    text = "Case No.: 1/25\nDate: today\n\nHe came.\nShe left.\n-----\nName|Age|Place\nA|3|X\nB|4|Y\n"
    kinds = [b[0] for b in classify(text)]
    assert kinds == ["HEADER_FIELD", "HEADER_FIELD", "NARRATIVE", "NOISE", "TABLE_ROW", "TABLE_ROW", "TABLE_ROW"]
    assert classify(text)[2][1:3] == (4, 5)
    df = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "k string, t string")
    blocks = line_blocks(df, "k", "t")
    assert blocks.count() == 7 and "-----" not in rebuild(blocks, "k").first()["text"]
    register(spark)
    assert spark.sql("SELECT kind FROM line_blocks('A: b')").first()["kind"] == "HEADER_FIELD"


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_equals_dynamic_programme(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert E.lcs_length(a, b) == table[-1][-1]


def test_similarities():
    assert E.ratio("abcd", "abxd") == 75.0 and E.ratio("", "a") == 0.0
    assert E.token_sort_ratio("ravi kumar", "kumar ravi") == 100.0 and E.partial_ratio("kumar", "ravi kumar das") == 100.0


def test_resolution_links_components(spark):
    forms = [("PERSON", "c", "Ravi Kumar", 3), ("PERSON", "c", "Kumar Ravi", 1), ("PERSON", "c", "Ravi Kumaar", 1), ("PERSON", "d", "Ravi Kumar", 1), ("PHONE", "c", "98", 1), ("PHONE", "c", "99", 1), ("PERSON", "c", "Zed Own", 1)]
    got = E.resolve(spark.createDataFrame(forms, "type string, case string, text string, n_mentions long"), "case").collect()
    names = {(r["scope"], r["text"]): (r["name"], r["entity"]) for r in got}
    assert names["c", "Kumar Ravi"] == names["c", "Ravi Kumar"] == names["c", "Ravi Kumaar"] and names["c", "Ravi Kumar"][0] == "Ravi Kumar"
    assert names["d", "Ravi Kumar"][1] != names["c", "Ravi Kumar"][1] and names["c", "98"] != names["c", "99"]


def test_incremental_merge(spark, rows):
    known = spark.createDataFrame([("a", ["x"], "old", None), ("b", None, "b", "t")], "id string, docs array<string>, name string, kind string")
    new = spark.createDataFrame([("a", ["y", "x"], "new", "k"), ("c", ["z"], "c", "t")], "id string, docs array<string>, name string, kind string")
    assert rows(E.merge_incrementally(known, new, "id", ["docs"], ["name", "kind"])) == [("a", ["x", "y"], "old", "k"), ("b", [], "b", "t"), ("c", ["z"], "c", "t")]


def test_across_types_and_confidence(spark, rows):
    given = [("c", "PERSON", "p", "Ravi Kumar"), ("c", "ORGANIZATION", "o", "Kumar Ravii"), ("c", "LOCATION", "l", "Zed"), ("d", "LOCATION", "m", "Ravi Kumar"), (None, "LOCATION", "n", "Ravi Kumar")]
    assert rows(E.across_types(spark.createDataFrame(given, "k string, type string, entity_id string, name string"), "k"), "kept", "dropped") == [("p", "o")]
    rated = spark.createDataFrame([("a", ["spacy", "x"], 0.8, 3, 2), ("b", [], 0.5, 1, 0)], "id string, methods array<string>, base double, n_docs int, n_aliases int")
    assert rows(E.confidence(rated), "id", "confidence", "needs_review") == [("a", 0.73, False), ("b", 0.375, True)]


def test_blocks_are_read_in_their_own_way(spark, rows):
    from caselattice.operators.blocks import routed_mentions

    text = "Case No.: 1\nSr|Name|Age\n1|Ravi Das|30\n2|Anna|41\n\nHe rang 9876543210.\n1. Meera Rao\n--- END OF DOCUMENT ---\n1. Nobody Here\n"
    found = routed_mentions(spark.createDataFrame([("d", text), ("n", None)], "k string, t string"), "k", "t")
    assert rows(found, "type", "value", "method") == [("PERSON", "Anna", "table"), ("PERSON", "Meera Rao", "list"), ("PERSON", "Ravi Das", "table"), ("PHONE", "9876543210", "regex")]


def test_names_of_any_length_are_found(spark, rows):
    from caselattice.operators.views import name_mentions

    texts = spark.createDataFrame([("t", "At Oakmere Marine Carriers Co-operative Society today; Oakmere Marine"), ("u", "Oakmere Marine Carriers Co-operative Bank"), ("n", None)], "k string, t string")
    names = spark.createDataFrame([("long", "Oakmere Marine Carriers Co-operative Society"), ("short", "Marine"), ("none", None)], "i string, n string")
    assert rows(name_mentions(texts, "k", "t", names, "i", "n")) == [("t", "long"), ("t", "short"), ("u", "short")]


def test_validation_keeps_every_row(spark, rows):
    df = spark.createDataFrame([("1", "PERSON", "n", 0.5, "c"), ("2", "X", " ", 7.0, None), ("3", None, None, None, "c")], "entity_id string, type string, name string, confidence double, circle string")
    good, bad = checked(df, ENTITY_CHECKS)
    assert rows(good, "entity_id") == [("1",)]
    assert rows(bad, "entity_id", "errors") == [("2", "name,type,confidence,circle"), ("3", "name,type,confidence")]


def test_measures(spark):
    scored = [(0.9, True), (0.8, False), (0.8, True), (0.3, False), (None, True)]
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p, a in scored if a and p is not None for n, b in scored if not b]
    assert M.auc(spark.createDataFrame(scored, "s double, p boolean"), "s", "p").first()["auc"] == sum(pairs) / len(pairs)
    found, truth = spark.createDataFrame([("x", 1), ("x", 2)], "t string, k int"), spark.createDataFrame([("x", 2), ("y", 3)], "t string, k int")
    got = {r["t"]: (r["precision"], r["recall"], r["f1"]) for r in M.prf(found, truth, ["k"], "t").collect()}
    assert got == {"x": (0.5, 1.0, round(2 / 3, 6)), "y": (0.0, 0.0, 0.0)}
    values = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 3, 9)] + [("b", 2.0), ("b", None), (None, 1.0)], "g string, v double")
    assert {tuple(r) for r in M.percentiles(values, "g", "v").collect()} == {("a", 5, 3.0, 8.2, 1.0, 9.0), ("b", 1, 2.0, 2.0, 2.0, 2.0)}
    ranked, wanted = spark.createDataFrame([("c", "x", 1), ("c", "y", 4), ("d", "z", 1)], "c string, e string, k int"), spark.createDataFrame([("c", "y"), ("d", "z"), ("d", "q")], "c string, e string")
    assert tuple(M.hit_rate(ranked, wanted, "c", "e", "k", 3).first()) == (2, 1, 0.5)
    a = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert M.same_outputs(a, a.orderBy(F.desc("i"))).first()["same"] is True
    assert M.same_outputs(a, a.filter("i = 1")).first()["same"] is False


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=8).round(3).tolist() for i in range(60)} | {60: [0.0] * 8, 61: None, 62: [1.0]}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "id long, v array<double>")
    got = {(r["query_id"], r["place"]): r["row_id"] for r in R.vector_topk(df.filter("id % 20 = 0 AND id < 60"), df, "id", "id", "v", 3).collect()}
    unit = {i: np.asarray(v, np.float32).astype(float) / (np.linalg.norm(v) or 1) for i, v in vectors.items() if v and len(v) == 8}
    for q in (0, 20, 40):
        best = sorted((-round(float(unit[q] @ u), 9), i) for i, u in unit.items() if i != q)[:3]
        assert [got[q, p] for p in (1, 2, 3)] == [i for _, i in best]


def test_folds(spark, rows):
    turns = spark.createDataFrame([("s", 0.0, 4.0, 1), ("s", 5.0, 9.0, 2), ("s", 9.0, 12.0, 3), ("t", 1.0, 2.0, 4), (None, 1.0, 2.0, 5)], "k string, a double, b double, id int")
    assert rows(G.merge_turns(turns, "k", "a", "b", "id", 10.0)) == [("s", 0.0, 9.0, 2), ("s", 9.0, 12.0, 1), ("t", 1.0, 2.0, 1)]
    frames = spark.createDataFrame([("v", 0.0, ["car"], 1), ("v", 1.0, ["car", "man"], 2), ("v", 2.0, ["dog"], 3), ("v", 3.0, None, 4), ("v", 4.0, [], 5)], "k string, a double, l array<string>, id int")
    assert [r[1:4] for r in rows(G.label_segments(frames, "k", "a", "l", "id", 0.5, 5.0))] == [(0.0, 1.0, 2), (2.0, 2.0, 1), (3.0, 3.0, 1), (4.0, 4.0, 1)]
    vectors = spark.createDataFrame([("v", 0.0, [1.0, 0.0], 1), ("v", 1.0, [0.9, 0.1], 2), ("v", 2.0, [0.0, 1.0], 3)], "k string, a double, x array<double>, id int")
    assert [r[3] for r in rows(G.vector_segments(vectors, "k", "a", "x", "id", 0.85, 5.0))] == [2, 1]
    ticks = spark.createDataFrame([("v", t / 2, i) for i, t in enumerate(range(10))], "k string, a double, id int")
    assert [r[2] for r in rows(G.throttled(ticks, "k", "a", "id", 2.0))] == [0.0, 2.0, 4.0]


def test_folds_over_gaps_equal_one_pass(spark, rows):
    import random

    rng = random.Random(6)
    rows_ = sorted({("k", float(rng.randrange(0, 400)), i) for i in range(60)}, key=lambda r: (r[1], r[2]))
    data = [(k, a, a + rng.randrange(0, 5), i) for k, a, i in rows_]
    expected, open_ = [], None
    for _, a, b, _ in data:
        if open_ and b - open_[0] <= 10:
            open_ = (open_[0], max(open_[1], b), open_[2] + 1)
        else:
            expected += [open_] if open_ else []
            open_ = (a, b, 1)
    expected.append(open_)
    got = rows(G.merge_turns(spark.createDataFrame(data, "k string, a double, b double, id int"), "k", "a", "b", "id", 10.0), "first", "last", "n_rows")
    assert sorted(got) == sorted(expected)


def test_mentions(spark, rows):
    from caselattice.operators import mentions as N

    schema = "doc string, type string, text string, start int, end int, method string, confidence double"
    found = spark.createDataFrame(
        [
            ("d", "PHONE", "98765 43210", 5, 16, "regex", 0.9), ("d", "PERSON", "43210 Ravi", 11, 21, "model", 0.7), ("d", "ORGANIZATION", "9876543210", -1, -1, "model", 0.7),
            ("d", "PERSON", "Ravi Nagar", 40, 50, "model", 0.8), ("e", "PERSON", "9876543210", -1, -1, "model", 0.7), ("d", "PERSON", None, -1, -1, "model", 0.1),
        ],
        schema,
    )
    kept = N.patterns_first(found)
    assert rows(kept, "doc", "text") == sorted([("d", "98765 43210"), ("d", "Ravi Nagar"), ("e", "9876543210"), ("d", None)], key=repr)
    assert rows(N.places(kept.filter("text = 'Ravi Nagar'")), "type", "confidence") == [("LOCATION", 0.72)]
    reasons = {r["text"]: r["r"] for r in found.select("text", N.junk_reason(F.col("type"), F.col("text")).alias("r")).collect()}
    assert reasons[None] == "empty" and reasons["98765 43210"] is None
    named = [("PERSON", "Kapur"), ("PERSON", "Kanpur Sharma"), ("PERSON", "Andheri East"), ("ORGANIZATION", "Lake Road Private Ltd"), ("PERSON", "Block Sector 22")]
    moved = N.places(spark.createDataFrame([(t, x, 0.5) for t, x in named], "type string, text string, confidence double"))
    assert {r["text"]: r["type"] for r in moved.collect()} == {"Kapur": "PERSON", "Kanpur Sharma": "PERSON", "Andheri East": "LOCATION", "Lake Road Private Ltd": "ORGANIZATION", "Block Sector 22": "LOCATION"}
    odd = [("PHONE", "12345", "phone"), ("VEHICLE", "QX1", "plate"), ("DATE", "1021", "number"), ("PERSON", "Search Engine", "technical"), ("ORGANIZATION", "Search Group", None), ("PERSON", "milkar ek", "fragment"), ("LOCATION", "on 01/02/2024", "date")]
    judged = spark.createDataFrame(odd, "type string, text string, reason string").withColumn("r", N.junk_reason(F.col("type"), F.col("text")))
    assert all(r["r"] == r["reason"] for r in judged.collect())
    assert one(spark, N.is_fragment, "aur Ravi") is True and one(spark, N.is_fragment, "Ravi Das") is False
    assert N.patterns_first(found.limit(0)).count() == 0
