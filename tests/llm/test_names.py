import pytest

from caselattice.llm.names import entity_groups, firm_form, fold, lcs_ratio, linked_pairs, person_forms, token_match

SCHEMA = "entity_id string, type string, circle string, name string, aliases array<string>, tokens int"
#: names that make the tokens of the cases established
CROWD = [(f"x{i}_{j}", "PERSON", f"far{j}", n, None, 0) for j in range(4) for i, n in enumerate(["Rachand Dumoray", "Suthiv Karapati", "Melita Nibagore", "Rasika Dumoray", "Suthiv Dumoray", "Melita Karapati", "Khosan Dumoray"])]


def pairs(spark, cases, nick=None):
    given = spark.createDataFrame(nick or [("Suthiv", "Papku")], "formal string, nickname string")
    found = linked_pairs(entity_groups(spark.createDataFrame(CROWD + cases, SCHEMA), given)).collect()
    return sorted((r["entity_id_a"], r["entity_id_b"]) for r in found if not r["entity_id_a"].startswith("x"))


def test_folds_and_forms():
    assert fold("Shichata") == fold("Seechaata") == fold("शिचता") and fold("Yaqsha") == fold("Yaxa")
    assert person_forms("Shri Rachand Dumoray s/o Suthiv Dumoray")[0][0] == person_forms("DUMORAY Rachand")[0][0][::-1]
    assert person_forms("Dumoray, Rachand")[0] == ([fold("Dumoray"), fold("Rachand")], True)
    assert firm_form("M/s Annavi Agro Wks (P) Ltd.")[0] == firm_form("Annavi Agro Works Private Limited")[0]
    assert firm_form("A.A.W. Ltd")[1] is True and lcs_ratio("abcd", "abd") == 6 / 7
    assert token_match("kosan", 50, "kunim", 60) == 0.0  # two established names are never variants
    assert token_match(fold("Rachand"), 50, fold("Rachnad"), -1) > 0


@pytest.mark.parametrize("variant", ["Shri Rachand Dumoray", "Dumoray, Rachand", "RACHAND DUMORAY", "Rachnad Dumoray", "Raachand Dumoray", "RachandDumoray", "रचंद दुमोरय", "R. Dumoray", "Rachand D.", "Rachand Dumoray s/o Melita Dumoray"])
def test_variants_link(spark, variant):
    assert pairs(spark, [("a", "PERSON", "c1", "Rachand Dumoray", None, 0), ("b", "PERSON", "c1", variant, [None, ""], 0), ("c", "PERSON", "c1", "Melita Nibagore", [], 0), ("d", "PERSON", "c2", "Rachand Dumoray", [], 0)]) == [("a", "b")]


def test_different_people_and_ambiguity(spark):
    cases = [
        ("a", "PERSON", "c1", "Rachand Dumoray", None, 0), ("b", "PERSON", "c1", "Rasika Dumoray", None, 0), ("c", "PERSON", "c1", "R. Dumoray", None, 0),
        ("d", "PERSON", None, "Rachand Dumoray", None, 0), ("e", "PERSON", "c1", "", None, 0), ("f", "PERSON", "c1", None, ["Rasika Dumoray"], 0), ("a", "PERSON", "c1", "Rachand Dumoray", None, 0),
    ]
    assert pairs(spark, cases) == [("b", "f")]  # the initial fits two people and joins neither


def test_nicknames_given_and_seen(spark):
    cases = [("a", "PERSON", "c1", "Suthiv Karapati", None, 0), ("b", "PERSON", "c1", "Papku Karapati", None, 0), ("c", "PERSON", "c1", "Melita Nibagore", ["Tinku Nibagore"], 0), ("d", "PERSON", "c1", "Tinku Nibagore", None, 0)]
    assert pairs(spark, cases) == [("a", "b"), ("c", "d")]


def test_firms(spark):
    cases = [
        ("a", "ORGANIZATION", "c1", "Annavi Agro Works Ltd", None, 0), ("b", "ORGANIZATION", "c1", "M/s Agro Works, Annavi", None, 0), ("c", "ORGANIZATION", "c1", "AAW Limited", None, 0),
        ("d", "ORGANIZATION", "c1", "Annavi Jewel Works Ltd", None, 0), ("e", "PERSON", "c1", "Annavi Agro", None, 0),
    ]
    assert pairs(spark, cases) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_empty(spark):
    assert entity_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_blocks_are_refined_and_split(spark, monkeypatch):
    from caselattice.llm import names

    monkeypatch.setattr(names, "COMMON", 3)
    crowd = [(f"y{i}", "PERSON", "c1", f"{n} Dumoray", None, 0) for i, n in enumerate(["Rasika", "Rohita", "Ravana", "Rukmat", "Rishon", "Relova", "Rachita"])]
    cases = [*crowd, ("a", "PERSON", "c1", "Rachand Dumoray", None, 0), ("b", "PERSON", "c1", "Rachnad Dumoray", None, 0), ("c", "PERSON", "c1", "Rachand Domuray", None, 0)]
    assert ("a", "b") in pairs(spark, cases) and ("a", "c") in pairs(spark, cases)
