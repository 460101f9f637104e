"""Linking variant spellings of the names of persons and firms.

Each name and alias becomes a form: titles, relations and legal endings removed, other scripts transliterated, spelling
habits folded (doubled letters, e/i, o/u, w/v, q/k, x/ksh, dropped h), tokens ordered as first, middle and last name by how often a
token stands last in the whole corpus. Forms are compared inside blocks of the suffix index: a block is a token suffix of
at least three letters, refined by the initial of another token, within type and circle; a refined block that is still
common is left to longer suffixes, and blocks of whole tokens are never left out. Pairs are compared token by token with
the longest-common-subsequence ratio; a difference counts as a typing error only when one of the two tokens is rare beside
the other in the whole corpus, so that two established names never count as variants of each other.

Links are made in two steps. Forms with full first and last names connect entities (components). Entities known only by
initials, acronyms or nicknames then join the one component that fits best, and none when several fit equally well.
Nicknames are the given table's and those the corpus itself shows (one entity under two first names and one last name).

Defined results: rows with a null id, type or circle link with nothing; an empty name is judged by the aliases, a row
without any usable form links with nothing; null and empty aliases are skipped; repeated rows count once; names of any
length are compared whole; an empty table gives no rows; extra columns do not pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.resolve import lcs_length
from ..session import cut

#: Least letters of a suffix, and forms in a refined block from which longer suffixes take over.
SUFFIX, COMMON = 3, 120
#: Least LCS ratio of two spellings of a token of three, up to five and more letters, of two rare ones, and how rare the
#: wrong one must be beside the right one.
RATIOS, RATIO_RARE, RARE = (0.66, 0.75, 0.79), 0.85, 0.12
#: A token is established when it has at least this share of the entities of the commonest token of its type.
ESTABLISHED = 0.1

# Words around names, in natural order.
TITLES = frozenset("shri sri shree smt sh mr mrs ms miss dr km kum kumari late prof adv insp si asi const श्री श्रीमती डॉ सुश्री कु".split())
LEGAL = frozenset("limited private pvt ltd p company co sons bros brothers cooperative coop society soc cs llp inc corp corporation and n".split())
LEGAL_KINDS = {"pvt": "pvt", "private": "pvt", "p": "pvt", "ltd": "ltd", "limited": "ltd", "co": "co", "company": "co", "sons": "sons", "coop": "coop", "cooperative": "coop", "soc": "coop", "cs": "coop", "bros": "bros", "brothers": "bros", "corp": "corp", "corporation": "corp"}
LEGAL_LONG = ("limited", "private", "company", "cooperative", "society", "brothers", "corporation")
SHORT_WORDS = {
    "wks": "works", "logs": "logistics", "assoc": "associates", "inds": "industries", "exp": "exports", "fin": "finance",
    "tdrs": "traders", "carr": "carriers", "tex": "textile", "agri": "agro", "ent": "enterprises", "engg": "engineering",
}
#: Devanagari letters and the Latin they are written with.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(), strict=True))
VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a a i i u u ri e ai o au".split(), strict=True))
SIGNS = dict(zip("ािीुूृेैोौंँः", "a i i u u ri e ai o au n n h".split(), strict=True))
DIGIT_LETTERS = str.maketrans("013457", "olesst")

_RELATION = re.compile(r"\s*(?:\b[sdwch]\s?/\s?o\b|\b(?:son|daughter|wife|care|husband) of\b|\br\s?/\s?o\b).*$", re.I | re.S)
_ALSO = re.compile(r"\s+(?:urf|alias|a\.?k\.?a\.?|उर्फ)\s+|\s*@\s*", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_NAME = re.compile(r"[^\w\sऀ-ॿ]|_")


def latin(token: str) -> str:
    """A Devanagari token in Latin letters; the last inherent vowel is silent."""
    out: list[str] = []
    bare = False
    for ch in unicodedata.normalize("NFC", token).replace("ड़", "ड").replace("ढ़", "ढ"):
        if ch in CONSONANTS:
            out += ["a"] * bare + [CONSONANTS[ch]]
            bare = True
        elif ch in SIGNS:
            if ch in "ंँः":
                out += ["a"] * bare
            out.append(SIGNS[ch])
            bare = False
        elif ch == "्":
            bare = False
        elif ch != "़":
            out += ["a"] * bare + [VOWELS.get(ch, ch if ch.isascii() else "")]
            bare = False
    return "".join(out)


@lru_cache(maxsize=100_000)
def fold(token: str) -> str:
    """A token without the habits in which spellings differ."""
    if any("ऀ" <= c <= "ॿ" for c in token):
        token = latin(token)
    t = token.lower()
    if any(c.isdigit() for c in t):
        t = t.translate(DIGIT_LETTERS)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalpha())
    t = t.replace("x", "ksh").replace("q", "k").replace("w", "v").replace("e", "i").replace("o", "u")
    t = re.sub("(?<=[bcdfgjkprstvz])h", "", t)
    return re.sub(r"(.)\1+", r"\1", t)


def person_forms(name: str) -> list[tuple[list[str], bool]]:
    """``(tokens, surname is first)`` for each name written in ``name``; one-letter tokens are initials."""
    forms = []
    for part in _ALSO.split(unicodedata.normalize("NFKC", name)):
        part = _RELATION.sub("", part)
        comma = part.split(",", 1)
        words = []
        for word in _NOT_NAME.sub(" ", _CAMEL.sub(" ", part)).split():
            if not words and word.lower() in TITLES and word not in ("S", "M"):
                continue
            words.append(word)
        upper = [w.isupper() and len(w) > 1 for w in words]
        first = len(comma) == 2 and bool(comma[1].strip()) and len(comma[0].split()) <= 2
        first = first or (len(words) > 1 and upper[0] and not any(upper[1:]) and any(len(w) > 1 for w in words[1:]))
        tokens = [t for t in map(fold, words) if t]
        if tokens:
            forms.append((tokens, first))
    return forms


def firm_form(name: str) -> tuple[list[str], bool] | None:
    """``(tokens, whether they are the letters of an acronym)``; the kind of legal ending is a last token like ``+ltd``."""
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"^\s*m\s?/\s?s\.?\s+", "", text, flags=re.I)
    text = re.sub(r"co-op", "coop", text, flags=re.I)
    text = re.sub(r"\(p\)", " pvt ", text, flags=re.I)
    dotted = re.match(r"\s*((?:[A-Za-z]\.){2,5})", text)
    if dotted:
        text = dotted[1].replace(".", "").upper() + " " + text[dotted.end() :]
    words = _NOT_NAME.sub(" ", _CAMEL.sub(" ", text).replace("&", " and ")).split()
    kept, kinds = [], set()
    for i, word in enumerate(words):
        low = word.lower()
        near = low if low in LEGAL else next((x for x in LEGAL_LONG if i > 1 and lcs_ratio(low, x) >= 0.8), "")
        if near:
            kinds.add(LEGAL_KINDS.get(near, ""))
        else:
            kept.append(word)
    legal = next((["+" + k] for k in ("coop", "pvt", "ltd", "sons", "co", "bros", "corp") if k in kinds), [])
    if len(kept) == 1 and kept[0].isupper() and 2 <= len(kept[0]) <= 5:
        return [fold(c) for c in kept[0]] + legal, True
    tokens = [t for t in (fold(SHORT_WORDS.get(w.lower(), w)) for w in kept) if t]
    return (tokens + legal, False) if tokens else None


@lru_cache(maxsize=200_000)
def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the lengths."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_match(a: str, na: int, b: str, nb: int) -> float:
    """1 for equal tokens, the LCS ratio for a likely typing error, else 0; rare tokens have negative counts."""
    if a == b:
        return 1.0
    if len(a) < 3 or len(b) < 3 or abs(len(a) - len(b)) > 3:
        return 0.0
    low, high = sorted((abs(na), abs(nb)))
    both = na < 0 and nb < 0
    if not both and low > max(1, RARE * high):
        return 0.0
    ratio = lcs_ratio(a, b)
    return ratio if ratio >= (RATIO_RARE if both else RATIOS[(min(len(a), len(b)) > 3) + (max(len(a), len(b)) > 5)]) else 0.0


def _name_part(a: str, na: int, b: str, nb: int) -> float:
    """Like ``token_match``; an initial fits a token it begins (0.9)."""
    if len(a) == 1 or len(b) == 1:
        return (1.0 if a == b else 0.9) if a[0] == b[0] else 0.0
    return token_match(a, na, b, nb)


def person_match(a: list[str], na: list[int], b: list[str], nb: list[int]) -> float:
    """How well two forms ``[first, middle or "", last]`` fit, 0 when they do not."""
    last = _name_part(a[2], na[2], b[2], nb[2])
    first = _name_part(a[0], na[0], b[0], nb[0])
    if not last or not first:
        return 0.0
    middle = _name_part(a[1], na[1], b[1], nb[1]) if a[1] and b[1] else 1.0
    if not middle or (min(first, last) < 0.75 and max(first, last) < 0.85):
        return 0.0
    return (first + last) / 2 - 0.1 * (1 - middle)


def firm_match(a: list[str], na: list[int], b: list[str], nb: list[int]) -> float:
    """How well the tokens of two firms fit one another in any order, 0 when one does not fit."""
    a, na = zip(*[(t, n) for t, n in zip(a, na, strict=True) if t[0] != "+"], strict=True)
    b, nb = zip(*[(t, n) for t, n in zip(b, nb, strict=True) if t[0] != "+"], strict=True)
    if abs(len(a) - len(b)) > (1 if min(len(a), len(b)) >= 3 else 0):
        return 0.0
    if len(a) > len(b):
        a, na, b, nb = b, nb, a, na
    free = list(range(len(b)))
    total = 0.0
    for x, nx in sorted(zip(a, na, strict=True), key=lambda p: -len(p[0])):
        best, at = 0.0, -1
        for j in free:
            m = token_match(x, nx, b[j], nb[j])
            if m > best:
                best, at = m, j
        if not best:
            return 0.0
        free.remove(at)
        total += best
    return total / len(a) - 0.05 * len(free)


def acronym_match(a: list[str], b: list[str]) -> float:
    """How well an acronym fits the initials of a firm, the kind of legal ending counting a little."""
    if sorted(t[0] for t in a if t[0] != "+") != sorted(t[0] for t in b if t[0] != "+"):
        return 0.0
    legal = {t for t in a if t[0] == "+"}, {t for t in b if t[0] == "+"}
    return 0.9 if not all(legal) else 0.95 if legal[0] == legal[1] else 0.8


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for kind, circle, entity, name, aliases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = set()
            for text in [name, *(aliases or [])]:
                if not text or not text.strip():
                    continue
                if kind == "PERSON":
                    found = [(t, s, False) for t, s in person_forms(text)]
                else:
                    form = firm_form(text)
                    found = [(form[0], False, form[1])] if form else []
                for tokens, surname_first, acronym in found:
                    key = (" ".join(tokens), surname_first, acronym)
                    if key not in seen:
                        seen.add(key)
                        out.append((kind, circle, entity, len(seen), tokens, surname_first, acronym))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["type", "circle", "entity_id", "form_no", "tokens", "surname_first", "acronym"])


def _order(tokens: list[tuple[str, int, float]], surname_first: bool) -> tuple[list[str], list[int]]:
    """First, middle and last of the ``(token, entities, share as last)`` of a person's form."""
    if len(tokens) == 1:
        return ["", "", tokens[0][0]], [0, 0, tokens[0][1]]
    head, tail = tokens[0], tokens[-1]
    if not surname_first and len(head[0]) > 1:
        known = abs(head[1]) >= 3 and head[2] > 0.6
        surname_first = known and (len(tail[0]) == 1 or abs(tail[1]) < 3 or tail[2] < 0.4)
    if surname_first:
        tokens = [*tokens[1:], head]
    middle = tokens[1:-1]
    kept = [tokens[0], (" ".join(m[0] for m in middle), min((m[1] for m in middle), key=abs, default=0), 0.0), tokens[-1]]
    return [k[0] for k in kept], [k[1] for k in kept]


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, circle, entity, surname_first, acronym, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = [(k["token"], k["n"] or 0, (k["n_last"] or 0) / max(1, abs(k["n"] or 0))) for k in known]
            if kind == "PERSON":
                names, counts = _order(tokens, surname_first)
                sort = "full" if len(names[0]) > 1 and len(names[2]) > 1 else "part" if not names[0] or (len(names[0]) == 1 and len(names[2]) == 1) else "short"
            else:
                ordered = sorted((t[0], t[1]) for t in tokens)
                names, counts = [t for t, _ in ordered], [n for _, n in ordered]
                sort = "short" if acronym else "full" if sum(t[0] != "+" for t in names) > 1 else "part"
            if sort != "part":
                out.append((kind, circle, entity, sort, names, counts))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["type", "circle", "entity_id", "sort", "tokens", "counts"])


def _keys(kind: str, sort: str, tokens: list[str]) -> list[tuple[str, str, str, str]]:
    """``(slot, suffix, other, level)`` of a form: a slot is a pair of tokens, its keys are the suffixes of the first.

    Level ``1`` refines a suffix by the initial of the other token, level ``2``, of the shortest suffix alone, by its two first letters;
    level ``w`` is the whole first token with the initial.
    """
    parts = [tokens[0], tokens[2]] if kind == "PERSON" else [t for t in tokens if t[0] != "+"]
    if kind != "PERSON" and sort == "short":
        return [("=", "".join(sorted(parts)), "=", "w")]
    found = []
    for i, t in enumerate(parts):
        if len(t) < 2:
            continue
        for j, other in enumerate(parts):
            if i != j and other:
                place = "" if kind != "PERSON" else "fl"[i]
                for start in range(max(1, len(t) - SUFFIX + 1)):
                    found.append((f"{i}{j}", t[start:], place + other[0], "1" if start else "w"))
                    if len(other) > 1 and 0 < start == len(t) - SUFFIX:
                        found.append((f"{i}{j}", t[start:], place + other[:2], "2"))
    if kind != "PERSON":
        found.append(("=", "".join(sorted(t[0] for t in parts)), "=", "w"))
    return found


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, cells = [], []
        kinds, sorts, tokens = (batch.column(n).to_pylist() for n in ("type", "sort", "tokens"))
        for i, (kind, sort, toks) in enumerate(zip(kinds, sorts, tokens, strict=True)):
            # one entry of a form in a block, or its size would be counted too high
            for slot, suffix, other, level in {(k[1], k[2]): k for k in _keys(kind, sort, toks)}.values():
                rows.append(i)
                cells.append((slot, suffix, other, level))
        columns = list(zip(*cells, strict=True)) if cells else [()] * 4
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(n).take(take) for n in ("type", "circle", "row")] + [pa.array(c, pa.string()) for c in columns],
            names=["type", "circle", "row", "slot", "suffix", "other", "level"],
        )


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, sa, sb, ta, na, tb, nb = (batch.column(n).to_pylist() for n in ("type", "sort_a", "sort_b", "tokens_a", "counts_a", "tokens_b", "counts_b"))
        scores = []
        for i, kind in enumerate(kinds):
            if kind == "PERSON":
                scores.append(person_match(ta[i], na[i], tb[i], nb[i]))
            elif (sa[i] == "short") != (sb[i] == "short"):
                scores.append(acronym_match(ta[i], tb[i]))
            else:
                scores.append(firm_match(ta[i], na[i], tb[i], nb[i]))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("a", "b", "sort_b")] + [pa.array(scores, pa.float64())], names=["a", "b", "sort_b", "score"])


def parse_forms(entities: DataFrame) -> DataFrame:
    """``(type, circle, entity_id, sort, tokens, counts, form)`` of every usable form of every entity; ``form`` is a 64-bit hash of the rest."""
    rows = (
        entities.select("type", "circle", "entity_id", "name", "aliases")
        .filter("type IN ('PERSON', 'ORGANIZATION') AND circle IS NOT NULL AND entity_id IS NOT NULL")
    )
    parsed = cut(
        rows.mapInArrow(_parse, "type string, circle string, entity_id string, form_no int, tokens array<string>, surname_first boolean, acronym boolean")
        .dropDuplicates(["entity_id", "type", "circle", "tokens", "surname_first", "acronym"])
        .withColumn("form_no", F.xxhash64("entity_id", "type", "circle", "tokens", "surname_first", "acronym"))
    )
    exploded = parsed.select("type", "circle", "entity_id", "form_no", "surname_first", "acronym", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    last = (F.col("pos") == F.col("size") - 1) != (F.col("surname_first") & F.col("pos").isin(0) & (F.col("size") > 1))
    last = F.when(F.col("surname_first"), F.col("pos") == 0).otherwise(last)
    stats = (
        exploded.filter("length(token) > 1 AND NOT acronym AND NOT startswith(token, '+')")
        .groupBy("type", "token", "entity_id").agg(F.max(last.cast("int")).alias("last"))
        .groupBy("type", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("last").alias("n_last"))
    )
    top = stats.groupBy("type").agg(F.max("n").alias("top"))  # one row per type
    stats = stats.join(F.broadcast(top), "type").select(
        "type", "token", "n_last", F.when(F.col("n") >= F.greatest(F.lit(3), F.col("top") * ESTABLISHED), F.col("n")).otherwise(-F.col("n")).alias("n")
    )
    known = (
        exploded.join(stats, ["type", "token"], "left")
        .groupBy("type", "circle", "entity_id", "form_no", "surname_first", "acronym")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token", "n", "n_last"))), lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"), x["n_last"].alias("n_last"))).alias("known"))
    )
    return (
        known.select("type", "circle", "entity_id", "surname_first", "acronym", "known")
        .mapInArrow(_canonical, "type string, circle string, entity_id string, sort string, tokens array<string>, counts array<long>")
        .withColumn("form", F.xxhash64("type", "circle", "sort", "tokens"))
        .dropDuplicates(["entity_id", "type", "circle", "form"])
    )


def _nicknames(forms: DataFrame, given: DataFrame | None) -> DataFrame:
    """``(nick, formal)``, both ways: first names one entity has beside one last name, and the given pairs."""
    full = forms.filter("type = 'PERSON' AND sort = 'full'").select("entity_id", F.element_at("tokens", 1).alias("first"), F.element_at("tokens", 3).alias("last"), F.element_at("counts", 1).alias("n"))
    other = full.select("entity_id", F.col("first").alias("other"), "last", F.col("n").alias("m"))
    # an entity has a handful of forms, so this join stays small
    seen = (
        full.join(other, ["entity_id", "last"]).filter("first <> other AND abs(n) > 1 AND abs(m) > 1")
        .filter(F.levenshtein("first", "other") > F.greatest(F.lit(2), F.floor(F.least(F.length("first"), F.length("other")) / 3)))
        .select(F.col("first").alias("nick"), F.col("other").alias("formal"))
    )
    if given is not None:
        folded = given.mapInArrow(_fold_pairs, "nick string, formal string")
        seen = seen.unionByName(folded).unionByName(folded.select(F.col("formal").alias("nick"), F.col("nick").alias("formal")))
    return seen.distinct()


def _fold_pairs(batches):
    for batch in batches:
        pairs = [(fold(a), fold(b)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if a and b]
        yield pa.RecordBatch.from_arrays([pa.array([b for _, b in pairs], pa.string()), pa.array([a for a, _ in pairs], pa.string())], names=["nick", "formal"])


def _blocks(shown: DataFrame) -> DataFrame:
    """``(row, block, size)``: the blocks each row is compared in, and how many rows each has.

    Of each slot the shortest suffix whose block is not common, else the whole token: whoever shares a longer one shares it too.
    Where the shortest suffix of all is common, the shortest that is not when refined by a second letter is kept beside it, so
    an error before a common ending still meets.
    """
    index = cut(
        shown.select("type", "circle", "row", "sort", "tokens").mapInArrow(_index, "type string, circle string, row long, slot string, suffix string, other string, level string")
        .select("row", "slot", "level", F.length("suffix").alias("n"), F.xxhash64("type", "circle", "suffix", "other").alias("block"))
    )
    sizes = index.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    usable = index.join(sizes, "block").filter((F.col("size") <= COMMON) | (F.col("level") == "w"))
    one, two = F.col("level") != "2", F.col("level") == "2"
    least = lambda which: F.min(F.when(which, F.struct("n", "block", "size")))
    kept = usable.groupBy("row", "slot").agg(least(one).alias("one"), least(two).alias("two"))
    finer = F.when(F.col("two").isNotNull() & (F.col("one").isNull() | (F.col("two.n") < F.col("one.n"))), F.col("two"))
    return kept.select("row", F.explode(F.array_compact(F.array("one", finer))).alias("k")).select("row", "k.block", "k.size").distinct()


def _candidates(shown: DataFrame) -> DataFrame:
    """Pairs of rows that share a block, a full form on the left, each pair once.

    A row carries all its blocks; a pair is taken in the least block both have, so copies need no second shuffle. The rows of a common block
    are dealt into pieces on one side and repeated for each piece on the other.
    """
    blocks = cut(_blocks(shown))
    carried = blocks.groupBy("row").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    whole = cut(shown.join(carried, "row").withColumn("block", F.explode("blocks")).join(blocks.filter(F.col("size") > COMMON).select("row", "block", "size"), ["row", "block"], "left"))
    pieces = F.ceil(F.coalesce("size", F.lit(1)) / COMMON).cast("int")
    a = whole.filter("sort = 'full'").withColumn("piece", F.pmod(F.xxhash64("row"), pieces).cast("int")).select(
        "block", "piece", "type", F.col("form").alias("a"), F.col("sort").alias("sort_a"), F.col("tokens").alias("tokens_a"), F.col("counts").alias("counts_a"), F.col("blocks").alias("blocks_a")
    )
    b = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        "block", "piece", F.col("form").alias("b"), F.col("sort").alias("sort_b"), F.col("tokens").alias("tokens_b"), F.col("counts").alias("counts_b"), F.col("blocks").alias("blocks_b")
    )
    # one full form on the left; pairs of full forms once
    return a.join(b, ["block", "piece"]).filter("a <> b AND (sort_b <> 'full' OR a < b)").filter(F.element_at(F.array_intersect("blocks_a", "blocks_b"), 1) == F.col("block"))


def entity_groups(entities: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """``(entity_id, type, circle, component)``: entities of one component are the same person or firm.

    ``entities`` needs ``entity_id, type, circle, name, aliases``; ``nicknames`` is ``(formal, nickname)``.
    """
    forms = cut(parse_forms(entities))
    distinct = forms.groupBy("form", "type", "circle", "sort").agg(F.first("tokens").alias("tokens"), F.first("counts").alias("counts"))
    nick = _nicknames(forms, nicknames)
    # a form under a nickname stands for the same form under each formal name as well
    expanded = (
        distinct.filter("type = 'PERSON' AND sort <> 'part' AND length(tokens[0]) > 1")
        .join(nick, F.element_at("tokens", 1) == F.col("nick"))
        .select("form", "type", "circle", F.lit("nick").alias("sort"), F.array("formal", F.col("tokens")[1], F.col("tokens")[2]).alias("tokens"),
                F.array(F.lit(1_000_000_000).cast("long"), F.col("counts")[1], F.col("counts")[2]).alias("counts"))
    )
    shown = cut(distinct.select("form", "type", "circle", "sort", "tokens", "counts").unionByName(expanded).withColumn("row", F.xxhash64("form", "sort", "tokens")))
    scored = cut(
        _candidates(shown).select("type", "a", "b", "sort_a", "sort_b", "tokens_a", "counts_a", "tokens_b", "counts_b")
        .mapInArrow(_score, "a long, b long, sort_b string, score double").filter("score > 0")
    )

    # an entity stands on its full forms, or on its short ones when it has no other; each is tied to the first
    held = forms.filter("sort IN ('full', 'short')").groupBy("entity_id", "type", "circle").agg(
        F.collect_set(F.when(F.col("sort") == "full", F.col("form"))).alias("full"), F.collect_set(F.when(F.col("sort") == "short", F.col("form"))).alias("short")
    )
    based = cut(held.select("entity_id", "type", "circle", F.sort_array(F.when(F.size("full") > 0, F.col("full")).otherwise(F.col("short"))).alias("base")).withColumn("first", F.col("base")[0]))
    ties = based.filter("size(base) > 1").select(F.col("first").alias("src"), F.explode(F.slice("base", 2, 1_000_000_000)).alias("dst"))
    links = scored.filter("sort_b = 'full'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = cut(connected_components(ties.unionByName(links), based.select(F.explode("base").alias("node"))))

    weak = scored.filter("sort_b <> 'full'")
    best = (
        weak.join(groups.select(F.col("node").alias("a"), F.col("component").alias("target")), "a")
        .join(groups.select(F.col("node").alias("b"), F.col("component").alias("source")), "b")
        .groupBy("source", "target").agg(F.countDistinct("b").alias("n"), F.max("score").alias("score"))
    )
    order = W.partitionBy("source").orderBy(F.desc("n"), F.desc(F.round("score", 3)))
    joined = (
        best.withColumn("place", F.rank().over(order))
        .withColumn("ties", F.count_if(F.col("place") == 1).over(W.partitionBy("source")))
        .filter("place = 1 AND ties = 1 AND source <> target")
        .select(F.col("source").alias("src"), F.col("target").alias("dst"))
    )
    merged = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    members = based.select("entity_id", "type", "circle", F.col("first").alias("node")).join(groups, "node")
    return members.join(merged, "component", "left").select("entity_id", "type", "circle", F.coalesce("merged", "component").alias("component"))


def linked_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of different entities of a component, the smaller id first."""
    a = groups.select("component", F.col("entity_id").alias("entity_id_a"))
    b = groups.select("component", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "component").filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()
