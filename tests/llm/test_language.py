import pytest

from caselattice.llm.language import LanguageFilter, document_languages, fit, judge, line_languages, plain, segments, sentence_languages, sentence_rows

SAMPLES = [
    ("en", "The witness heard a loud cry near the gate."), ("en", "No one came to the counter for four days."), ("en", "The report of the lab is awaited."), ("en", "He was last seen near the bridge with a trunk."),
    ("hi-Latn", "Dukaan ka taala toota hua mila aur galla khaali tha."), ("hi-Latn", "Woh baar baar phone karta tha aur daraata tha."), ("hi-Latn", "Jaanch abhi chal rahi hai."), ("hi-Latn", "Usne kaha ki main kuch nahi jaanta."),
    ("hi", "दुकान का ताला टूटा हुआ मिला और गल्ला खाली था।"), ("hi", "मामले की जाँच अभी चल रही है।"), ("hi", "वह कई दिनों से घर नहीं लौटा है।"),
    ("mr", "दुकानाचे कुलूप तुटलेले आढळले आणि गल्ला रिकामा होता."), ("mr", "पुढील तपास सुरू आहे."), ("mr", "तो अनेक दिवसांपासून घरी आलेला नाही."),
    ("ja", "現在も捜査を続けている。"), ("zh", "该案仍在进一步调查之中。"), ("th", "คดีนี้ยังอยู่ระหว่างการสอบสวน"),
]


@pytest.fixture(scope="module")
def languages():
    return LanguageFilter(SAMPLES)


def name(f, text):
    i, _ = judge(f.counts(plain(text), [(0, len(text))])[0])
    return f.languages[i] if i >= 0 else None


@pytest.mark.parametrize(
    "text, lang",
    [
        ("The guard heard a cry near the counter.", "en"), ("Phir woh dukaan ka taala tod kar chala gaya.", "hi-Latn"), ("जाँच चल रही है और वह घर नहीं लौटा।", "hi"), ("तपास सुरू आहे आणि तो घरी आला नाही.", "mr"),
        ("捜査を続けている。", "ja"), ("该案在调查之中。", "zh"), ("คดีอยู่ระหว่างการสอบสวน", "th"), ("12345 @@ 99", None),
    ],
)
def test_sentences(languages, text, lang):
    assert name(languages, text) == lang


def test_filter_has_no_false_negatives(languages):
    for lang, text in SAMPLES:
        counts = languages.counts(plain(text), [(0, len(text))])[0]
        assert counts.argmax() == languages.languages.index(lang)


def test_codes_and_names_do_not_mix(languages):
    found = sentence_languages("वह कई दिनों से CCTV 1234 post@x.test घर नहीं लौटा है।", languages)
    assert [languages.languages[f[2]] for f in found] == ["hi"]


def test_rows(spark, rows):
    filter_ = fit(spark.createDataFrame([*SAMPLES, (None, "x"), ("en", None)], "lang string, text string"))
    mixed = "Case No.: 1/25\nThe report of the lab is awaited. मामले की जाँच अभी चल रही है।\nNo one came for days."
    df = spark.createDataFrame([("m", mixed, 7), ("p", "पुढील तपास सुरू आहे.", 7), ("n", None, 7), ("e", " \n", 7)], "k string, body string, lang int")
    assert rows(document_languages(df, ["k"], "body", filter_), "k", "line_no", "lang") == [("m", 0, "en"), ("p", 0, "mr")]
    assert rows(line_languages(df, ["k"], "body", filter_), "k", "line_no", "lang") == [("m", 0, "en"), ("m", 2, "en"), ("m", 2, "hi"), ("m", 3, "en"), ("p", 0, "mr")]
    parts = rows(segments(sentence_rows(df, ["k"], "body", filter_), "k"), "k", "segment", "lang")
    assert parts == [("m", 0, "en"), ("m", 1, "hi"), ("m", 2, "en"), ("p", 0, "mr")]
    assert all(0 <= r["confidence"] <= 1 for r in document_languages(df, ["k"], "body", filter_).collect())
    assert line_languages(df.limit(0), ["k"], "body", filter_).count() == 0


def test_words_are_learned_from_labelled_texts(spark, languages):
    from caselattice.llm.language import learn_words

    texts = [(f"k{i}", "en", f"The gadget was seen near the river by the watchman number {i}.") for i in range(6)] + [("x", None, "gadget"), ("y", "en", None)]
    taught = learn_words(languages, spark.createDataFrame(texts, "k string, lang string, text string"), "k", "text", "lang")
    assert [taught.languages[b] for b in taught.words["gadget"]] == ["en"]


def test_long_texts_are_counted_in_linear_memory(languages):
    text = "The watchman saw the lorry leave the yard at night. " * 4_000
    assert {languages.languages[f[2]] for f in sentence_languages(text, languages)} == {"en"}
