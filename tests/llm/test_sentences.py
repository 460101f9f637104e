import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselattice.llm.sentences import BLANK, sentence_units, split, thai_words


def units(text):
    return [text[a:b] for a, b in split(text)]


@pytest.mark.parametrize(
    "expected",
    [
        ["He left at 9.15 p.m. on Monday.", "Dr. R. Kumar of P.S. Ganj paid Rs. 5,000 vide Cr. No. 12/24.", "Who came?", "She ran!!!"],
        ["The goods came from Annavi Jewel & Co.", "Meanwhile, ropes, pipes, etc. were sold near Station Rd..", "iPhone box no. 4 was found."],
        ['"Is that all?" asked Insp. Rao twice.', 'The witness said, "Yes. At 9 I saw him."', "All denied."],
        ["Nothing was found... only a torn page of a book.", "It ended..."],
        ['गवाह ने कहा, "मुझे मत मारो। मैं सब बता दूँगा।" और वह चला गया।', "श्री. राम की दुकान से रु. 10 गए।", "कब?"],
        ["डॉ. पटिया यांनी तपासणी केली.", "झडतीमध्ये 3.5 कि.ग्रॅ. धान्य सापडला.", "पैसे कुठे गेले?"],
        ["گواہ نے کہا، \"مجھے مت مارو۔ میں سب بتا دوں گا۔\" اور وہ رونے لگا۔", "کیا ہوا؟"],
        ["证人说：“站住！别过来。”随后便跑开了。", "该案仍在调查。"],
        ["彼は「金はどこだ？」と尋ねたが、誰も答えなかった。", "現在も捜査を続けている。"],
    ],
)
def test_sentences_of_a_line(expected):
    assert units(" ".join(expected)) == expected


def test_no_space_after_the_mark():
    assert units("The file was sent for orders.G. Rao's brother came.As per him, no.") == ["The file was sent for orders.", "G. Rao's brother came.", "As per him, no."]


def test_structure_lines():
    text = "﻿FIRST REPORT\nCase No.: 12/25\nName: A. Rao\n\nHe left.\n\nWITNESSES:\n1. B. Rao (98)\n- C. Das\n"
    assert units(text) == ["FIRST REPORT", "Case No.: 12/25", "Name: A. Rao", "He left.", "WITNESSES:", "1. B. Rao (98)", "- C. Das"]


def test_wrapped_lines_and_lines_without_mark():
    wrapped = "The cash book of the firm showed three entries for the\nmonth and the clerk could not explain any of them to the\nofficer. The report of the lab is awaited and no one has\nasked for it since."
    assert len(units(wrapped)) == 2
    listed = "The drawer was empty\nNo one claimed the bag for several days after that\nHe left\nThe report is awaited"
    assert units(listed) == listed.split("\n")


def test_thai_gaps():
    text = "คดีนี้ยังอยู่ระหว่างการสอบสวน เจ้าหน้าที่ยึดของกลางหนัก 5.2 กิโลกรัมไว้ตรวจสอบ รถทะเบียน QX1 ออกจากที่เกิดเหตุเวลา 16.54 น. และไม่กลับมาอีก ต่อมาพยานตกใจ"
    assert units(text) == ["คดีนี้ยังอยู่ระหว่างการสอบสวน", "เจ้าหน้าที่ยึดของกลางหนัก 5.2 กิโลกรัมไว้ตรวจสอบ", "รถทะเบียน QX1 ออกจากที่เกิดเหตุเวลา 16.54 น. และไม่กลับมาอีก", "ต่อมาพยานตกใจ"]
    assert thai_words("เจ้าหน้าที่ยึดของกลาง") == ("เจ้าหน้าที่", "ยึด", "ของกลาง")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .!?\n\"“”।。ก ่น1-:(é　﻿", max_size=60))
def test_units_cover_every_character_once(text):
    found = split(text)
    assert all(a < b and text[a] not in BLANK and text[b - 1] not in BLANK for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    inside = [False] * len(text)
    for a, b in found:
        inside[a:b] = [True] * (b - a)
    assert all(ok or ch in BLANK for ok, ch in zip(inside, text, strict=True))


def test_rows(spark, rows):
    df = spark.createDataFrame([(1, "One. Two.", 9), (1, "One. Two.", 9), (2, None, 9), (3, " \n﻿", 9), (4, "word " * 30_000 + "end.", 9)], "doc_id long, text string, end_off int")
    got = rows(sentence_units(df, "doc_id", "text"))
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 150_004)]
    assert sentence_units(df.limit(0), "doc_id", "text").count() == 0


def test_a_quotation_of_any_length_is_one():
    text = 'He said, "' + "I saw it. " * 600 + 'I did." Then he left.'
    assert [text[a:b] for a, b in split(text)][-1] == "Then he left." and len(split(text)) == 2


def test_lattice_takes_the_cheapest_path():
    from caselattice.llm.sentences import cjk_last, lattice_words

    assert lattice_words("abcab", frozenset(["ab", "abc"]), 3) == ("abc", "ab")
    assert cjk_last("彼は帰りました") == "ました" and cjk_last("他说") == "说"
