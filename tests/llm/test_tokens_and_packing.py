import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselattice.llm.packing import best_fit_plan, pack, pack_specs
from caselattice.llm.tokens import VOCABULARIES, PieceEncoder, byte_alphabet, character_spans, decode, decode_rows, encode, load_tokenizer, token_counts

PATH = f"{VOCABULARIES}/byte_bpe_50k.json"
TEXTS = ["", "plain words", "don't 's 't", "a  b\n\n  c\t", "<|endoftext|> stays text", "क़ ß/ẞ état 🚗💨", "。店の鍵は2025年8月", "a\x1c!\x1d b", "x" * 3000 + "漢字。" * 60, "﻿bom", " lead"]


@pytest.fixture(scope="module")
def coder():
    if not os.path.exists(PATH):
        pytest.skip("no vocabulary files")
    return load_tokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_give_the_ids_of_the_whole(text):
    if not os.path.exists(PATH):
        return
    got = np.frombuffer(PieceEncoder(PATH)([text])[0], np.int32).tolist()
    assert got == load_tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert decode(got, PATH) == text


def test_small_table_gives_the_same(coder):
    encoder = PieceEncoder(PATH)
    encoder.KEPT = 4
    for _ in range(2):
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder(TEXTS)] == [coder.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_spans_cover_the_text(coder):
    assert len(byte_alphabet()) == 256
    for text in TEXTS:
        spans = character_spans(coder.encode(text, add_special_tokens=False).ids, PATH)
        assert (not text and not spans) or (spans[0][0] == 0 and spans[-1][1] == len(text))
        assert all(b <= a2 + 1 and a <= a2 for (a, b), (a2, _) in zip(spans, spans[1:], strict=False))
    emoji = coder.encode("🚗", add_special_tokens=False).ids
    assert len(emoji) > 1 and set(character_spans(emoji, PATH)) == {(0, 1)} and decode(emoji[:1], PATH) == "�"


def test_rows(spark, rows, coder):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = sorted(encode(df, "doc_id", "text", PATH).collect())
    assert [(r["doc_id"], r["ids"]) for r in got] == [(1, coder.encode("a b").ids)] * 2 + [(2, []), (3, [])]
    assert [r["n_tokens"] for r in sorted(token_counts(df, "doc_id", "text", PATH).collect())] == [2, 2, 0, 0]
    assert rows(decode_rows(encode(df, "doc_id", "text", PATH), "doc_id", "ids", PATH)) == [(1, "a b"), (1, "a b"), (2, ""), (3, "")]
    spans = encode(df, "doc_id", "text", PATH, offsets=True).filter("doc_id = 1").first()
    assert (spans["starts"], spans["ends"]) == ([0, 1], [1, 3])
    assert encode(df.limit(0), "doc_id", "text", PATH).count() == 0


def items_of_plan(plan):
    for length, a, b, per, start, position in plan:
        for rank in range(a, b):
            yield length, rank, start + (rank - a) // per, position + (rank - a) % per * length


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12), st.integers(40, 60))
def test_plan_is_whole_and_fits(histogram, capacity):
    placed = list(items_of_plan(best_fit_plan(histogram, capacity)))
    assert sorted((n, r) for n, r, _, _ in placed) == sorted((n, r) for n, k in histogram.items() for r in range(k))
    taken: dict = {}
    for n, _, container, position in placed:
        taken.setdefault(container, []).append((position, position + n))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(taken) == list(range(len(taken)))
    # best fit decreasing leaves no two containers that could be one
    fill = sorted(sum(b - a for a, b in s) for s in taken.values())
    assert len(fill) < 2 or fill[0] + fill[1] > capacity


def test_pack_whole_items(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 7, 7, 7, 19, 64, 65, 128, 130, 200]) for _ in range(400)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").selectExpr("k", "size", "1 AS container", "'x' AS piece")
    got = pack(df, "k", "size", 64).collect()
    by_item: dict = {}
    held: dict = {}
    for r in got:
        by_item.setdefault(r["k"], []).append((r["part_no"], r["start"], r["n"]))
        if r["container"] is not None:
            held.setdefault(r["container"], []).append((r["position"], r["position"] + r["n"]))
    assert set(by_item) == set(range(401))
    for k, parts in by_item.items():
        parts.sort()
        assert sum(n for _, _, n in parts) == (sizes[k] or 0) and (len(parts) == 1 or sizes[k] > 64)
        assert [p for p, _, _ in parts] == list(range(len(parts))) and all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))
    for spans in held.values():
        spans.sort()
        assert spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert pack(df.limit(0), "k", "size", 64).count() == 0


def test_the_plan_does_not_grow_with_the_items():
    """Ten thousand times the items give about as many plan lines: they are bounded by the capacity."""
    rng = random.Random(2)
    small = {length: rng.randrange(1, 40) for length in rng.sample(range(1, 2001), 600)}
    large = {length: n * 10_000 + rng.randrange(10_000) for length, n in small.items()}
    lines = len(best_fit_plan(large, 2_000))
    assert lines <= 4 * 2_000 and lines <= 4 * len(best_fit_plan(small, 2_000))


def test_specs_in_one_pass_equal_one_by_one(spark, rows):
    items = [(f"k{i}", (i * 37) % 23) for i in range(60)] + [("long", 55), ("none", None)]
    df = spark.createDataFrame(items, "k string, size long")
    both = df.selectExpr("1 AS spec_id", "10 AS capacity", "*").unionByName(df.selectExpr("2 AS spec_id", "25 AS capacity", "*"))
    found = pack_specs(both, "k", "size", {1: 10, 2: 25})
    for spec, capacity in ((1, 10), (2, 25)):
        assert rows(found.filter(f"spec_id = {spec}").drop("spec_id")) == rows(pack(df, "k", "size", capacity))
