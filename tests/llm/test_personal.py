import pytest
from pyspark.sql import functions as F

from caselattice.llm.corpus_personal import p1_redacted
from caselattice.llm.personal import Finder, NameBook, found_rows, learn, name_parts, redact, redacted_rows, vocabulary

PERSONS = ["Ravik Dumoray", "Sunel Karapati", "Ravik Karapati", "Sunel Dumoray"]


@pytest.fixture(scope="module")
def finder():
    parts = [("dense", n, 2) for n in ("李玉山", "李晓文", "周玉山", "周晓文", "สมหญิง")]
    return Finder(NameBook(parts, PERSONS))


def kinds(finder, text):
    return [(k, text[a:b]) for k, a, b in finder(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Insp. Ravik Dumoray and R. Karapati came.", [("NAME", "Ravik Dumoray"), ("NAME", "R. Karapati")]),
        ("Sunel K.'s brother SUNEL DUMORAY alias Tinku fled", [("NAME", "Sunel K."), ("NAME", "SUNEL DUMORAY"), ("NAME", "Tinku")]),
        ("The Ravik Marg Post Office and Ravik Memorial School", []),
        ("mail a.b+c@post.test. Next, x [at] mail [dot] post [dot] test", [("EMAIL", "a.b+c@post.test"), ("EMAIL", "x [at] mail [dot] post [dot] test")]),
        ("call +91 98765 43210, (0712) 233 8846 or 0091.8123.456709", [("PHONE", "+91 98765 43210"), ("PHONE", "(0712) 233 8846"), ("PHONE", "0091.8123.456709")]),
        ("number six two nine nine one six four one one eight was", [("PHONE", "six two nine nine one six four one one eight")]),
        ("helpline 112 and 1800-281-1772, ref 77-7807611292, IMEI 358540351715768", []),
        ("card 4821 7730 9164, ABCXE1234F, K7150384, abc1234567, MX41-20097751823", [("ID", "4821 7730 9164"), ("ID", "ABCXE1234F"), ("ID", "K7150384"), ("ID", "abc1234567"), ("ID", "MX41-20097751823")]),
        ("plate QX68BT7038, account ACC35419, firm 88THSSC5819U9Z7, order 45003698123", []),
        ("r/o Door No. 232, Surapur Street, Meligaon 811 950, was bound", [("ADDRESS", "Door No. 232, Surapur Street, Meligaon 811 950")]),
        ("to 121/22, 2nd Cross, Garhagaon Layout, Vishnogarh, but", [("ADDRESS", "121/22, 2nd Cross, Garhagaon Layout, Vishnogarh")]),
        ("Village Tolanagar, P.O. Suragaon, PIN 157124, but", [("ADDRESS", "Village Tolanagar, P.O. Suragaon, PIN 157124")]),
        ("नोटिस घर क्रमांक 73, सूरागंज मार्ग, विष्णोगढ़ - 503401 पर", [("ADDRESS", "घर क्रमांक 73, सूरागंज मार्ग, विष्णोगढ़ - 503401")]),
        ("报案人李晓文称", [("NAME", "李晓文")]),
        ("นายสมหญิงให้การ", [("NAME", "สมหญิง")]),
        ("मोबाइल ८६७९१७६९५३ से", [("PHONE", "८६७९१७६९५३")]),
        ("", []),
    ],
)
def test_cases_and_counter_cases(finder, text, expected):
    assert kinds(finder, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("House No. 5, Park Street, Kolkata 700016 was shut", [("ADDRESS", "House No. 5, Park Street, Kolkata 700016")]),
    ("Flat 12, MG Road, Mumbai 400001.", [("ADDRESS", "Flat 12, MG Road, Mumbai 400001")]),
    ("He lives at Flat 12, MG Road, Delhi.", [("ADDRESS", "Flat 12, MG Road, Delhi")]),
    ("Flat 12, MG Road, Somebody said no", []),
    ("see https://x.y/u?mail=a@b.co and mail q@w.co", [("EMAIL", "q@w.co")]),
])
def test_addresses_by_structure_and_links(finder, text, expected):
    assert [(k, text[a:b]) for k, a, b in finder(text)] == expected


def test_indic_names_follow_the_latin_ones(finder):
    assert kinds(finder, "श्री. रविक दुमोरय की दुकान") == [("NAME", "रविक दुमोरय")]


def test_redaction_keeps_the_rest(finder):
    assert redact("Dr. Ravik Dumoray (98765 43210) left.", finder) == "Dr. <NAME> (<PHONE>) left."
    assert redact(None, finder) is None and redact("", finder) == ""


def test_names_are_learned_from_labels_and_lists():
    text = "Complainant Name: Asha Devpal\nDate: 1.1.2024\n\nPERSONS OF INTEREST:\n1. Milo Devpal (9876543210)\n- B. Ran\n\nShe left.\n- not a Name"
    assert list(name_parts(text)) == [("first", "asha"), ("last", "devpal"), ("first", "milo"), ("last", "devpal"), ("last", "ran")]


def test_names_are_learned_from_all_texts(spark):
    text = F.when(F.col("id") < 20_000, "nothing here").when(F.col("id") % 2 == 0, "Complainant Name: Asha Devpal").otherwise("报案人: 李玉山")
    df = spark.range(0, 20_004, 1, 4).select(text.alias("body"))
    assert kinds(Finder(learn(df, "body")), "Asha Devpal 与李玉山") == [("NAME", "Asha Devpal"), ("NAME", "李玉山")]


def test_only_the_vocabulary_leaves_the_executors(spark, rows):
    df = spark.createDataFrame([("Name: Asha Devpal\n报案人: 李玉山",), ("Name: Milo Devpal",), (None,)], "body string")
    persons = spark.createDataFrame([("Ravik Dumoray",), ("Single",), (None,)], "full_name string")
    assert rows(vocabulary(df, "body", persons)) == [("dense", "李玉山", 1), ("first", "ravik", 2), ("last", "devpal", 2), ("last", "dumoray", 2)]


def test_rows_edge_cases(spark, rows):
    long = "x " * 60_000 + "mail me@post.test end"
    df = spark.createDataFrame([("a", "write to me@post.test", 1), ("a", "write to me@post.test", 2), ("n", None, 3), ("e", "", 4), ("l", long, 5)], "k string, body string, start_off int")
    persons = spark.createDataFrame([(p,) for p in PERSONS] + [(None,)], "full_name string")
    f = Finder(learn(df, "body", persons))
    assert rows(found_rows(df, "t", "k", "body", f)) == [("t", "a", "EMAIL", 9, 21), ("t", "l", "EMAIL", 120_005, 120_017)]
    assert rows(redacted_rows(df.filter("k <> 'l'"), "k", "body", f)) == sorted([("a", "write to <EMAIL>"), ("a", "write to <EMAIL>"), ("n", None), ("e", "")], key=repr)
    empty = df.limit(0)
    assert found_rows(empty, "t", "k", "body", Finder(learn(empty, "body"))).count() == 0


def test_files_and_snippets_are_redacted(spark, rows, tmp_path):
    for name, columns, values in (
        ("case_files", "doc_key string, raw_text string", [("d1", "Complainant Name: Asha Devpal"), ("d2", "write to me@post.test")]),
        ("top3_results", "result_id long, text_snippet string", [(7, "... call 98765 43210"), (8, "by Sunel Karapati"), (9, None), (7, "... call 98765 43210")]),
        ("subscribers", "full_name string", [("Sunel Karapati",)]),
    ):
        spark.createDataFrame(values, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(p1_redacted(spark, str(tmp_path)), "src_table", "row_key", "text") == [
        ("case_files", "d1", "Complainant Name: Asha Devpal"), ("case_files", "d2", "write to <EMAIL>"),
        ("top3_results", "7", "... call <PHONE>"), ("top3_results", "7", "... call <PHONE>"), ("top3_results", "8", "by <NAME>"), ("top3_results", "9", None),
    ]
