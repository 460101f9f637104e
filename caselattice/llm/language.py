"""Languages of texts and of the segments of mixed texts, by bitmask filters over character n-grams.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a word with two bits per language (any n-gram,
and those of several samples), an n-gram sets its language's bits in ``HASHES`` slots, and the AND of
those slots is the set of languages that contain the n-gram.
Per sentence the bits are counted per language, an n-gram known to few languages counting more, and each count is reduced
by what the language's fill rate makes expected by chance. The largest count decides; its lead over the next is the
confidence. The filter is fitted once on a bounded table of labelled sentences and shipped with the tasks; hashes and
look-ups of many texts together are vectorised.

Whole function words count besides. Codes, numbers, e-mail addresses and punctuation are blanked first, so that names and codes of another language inside a sentence weigh little; a sentence without evidence takes the language of the sentence before it, else the main one.

Defined results: null, empty and blank texts have no language and no segments; headings, label lines and list items are
not running text, but decide when a text has nothing else; a text whose evidence is nil has a null language and
confidence 0; repeated rows give repeated rows; ties go to the language first in order; an empty table gives no rows;
extra columns do not pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sentences

#: n-gram sizes, slots of the filter (a power of two) and hash functions.
SIZES, SLOTS, HASHES = (1, 2, 3, 4, 5), 1 << 18, 3
#: Weights of an n-gram of several samples and of a whole function word beside 1 for any n-gram, and characters counted at once.
STRONG, WORD, GROUP_CHARS = 1.0, 15.0, 200_000
#: Words of a run of one script that can be a sentence of its own.
WORDS = 4
#: Lead under which a sentence is given to the main language when that comes second.
DOUBT = 0.08
#: Labelled sentences and labelled texts read for fitting, at most.
FIT_ROWS, FIT_TEXTS = 20_000, 4_000
#: Texts a word must be seen in, and its share of one language, to be a word of it.
WORD_TEXTS, WORD_SHARE = 4, 0.85

# Closed classes of words (pronouns, postpositions, auxiliaries, conjunctions, particles) of the languages that share
# a script with another, as grammars list them.
FUNCTION_WORDS = {
    "en": "the a an of and or but to in on at for from with by about into over under between was were is are be been being has have had do does did not no"
    " he she it they we you i his her its their our my this that these those which who whom whose what when where why how if then than as so there here",
    "hi-Latn": "ka ke ki ko se mein par aur ya ne bhi hi toh jo tha thi the hai hain ho hua hui hue gaya gayi gaye raha rahi rahe kya kaun kisne kab kahan kyun kaise"
    " woh yeh usne uske usko uska uski unke unka mera meri mere hum humne main maine mujhe aap tum nahi koi kuch sab jab tab phir lekin magar kar liye saath",
    "hi": "का के की को से में पर और या ने भी ही तो जो था थी थे है हैं हूँ हो हुआ हुई हुए गया गई गए रहा रही रहे क्या कौन किसने कब कहाँ क्यों कैसे वह यह वे ये उस इस उन इन उसने इसने"
    " उसके उसका उसकी उनके उनका उनकी इसके मेरा मेरी मेरे मैं मैंने मुझे हम हमने आप तुम अपना अपनी अपने उन्होंने नहीं कोई कुछ सब जब तब फिर लेकिन मगर अगर कि क्योंकि इसलिए वाला वाली वाले"
    " कर करके किया की लिया दिया लिए तक साथ बाद द्वारा यहाँ वहाँ अब सकता सकते चाहिए होता होती होते",
    "mr": "चा ची चे च्या ला ना नी ने शी त आणि व किंवा पण परंतु तो ती ते तें हा ही हे या जो जी जे होता होती होते होतो आहे आहेत आहेस नाही नाहीत झाला झाली झाले केला केली केले गेला गेली गेले"
    " काय कोण कोणी कोणीही कुठे कधी का कसे मी आम्ही तू तुम्ही आपण माझा माझी माझे माझ्या आमचा आपला आपली आपले आपल्या त्याने तिने त्याचा त्याची त्याचे त्याच्या तिच्या त्यांनी त्यांचा त्यांची त्यांच्या"
    " यांनी यांच्या येथे तेथे जवळ वरून मधून पासून पर्यंत साठी मुळे नंतर असून असे अशी असा म्हणून म्हणजे की जर तर जेव्हा तेव्हा आला आली आले",
}
_CODES = re.compile(
    r"[A-Za-z0-9.+_-]+\s?(?:@|[\[(]at[\])])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]+)*"
    r"|[A-Za-z0-9०-९০-৯.,:/()+-]*[0-9०-९০-৯][A-Za-z0-9०-९০-৯.,:/()+-]*|<[^>\s]*>|\b[A-Za-z]:\\\S*"
)
_MARKS = re.compile(r"[^\w\sऀ-෿฀-๿\u200c\u200d]+|[_\s]+")
_LATIN, _OTHER = re.compile("[A-Za-z]{2}"), re.compile("[\u0370-\uffef]")
_SPACED = re.compile(r"\S+")
_NAME = re.compile(r"(?<![A-Za-z\"“])[A-Z][A-Za-z.]*")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BASE = np.uint64(1_099_511_628_211)


def plain(text: str, starts: Iterable[int] = (0,)) -> str:
    """The text with codes, numbers, capitalised words inside sentences and punctuation blanked; offsets stay."""
    first = set(starts)
    blank = lambda m: " " * len(m[0])
    bare = _NAME.sub(lambda m: m[0] if m.start() in first else " " * len(m[0]), _CODES.sub(blank, text))
    return _MARKS.sub(blank, bare).translate(_LOWER)


def _slots(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For every n-gram size the slots of all n-grams, one row per hash function; longer n-grams are hashed from shorter ones."""
    found = []
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for n in range(1, max(SIZES) + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
            power = power * _BASE
            if n in SIZES:
                x = h + np.uint64(n) * power
                x ^= x >> np.uint64(29)
                rows = []
                for mix in _MIX[:HASHES]:
                    y = x * mix
                    rows.append(((y ^ (y >> np.uint64(32))) & np.uint64(SLOTS - 1)).astype(np.int64))
                found.append((n, np.stack(rows)))
    return found


class LanguageFilter:
    """A fitted filter: ``languages`` in bit order, ``slots`` and the chance ``p`` of a false bit per language."""

    def __init__(self, samples: Iterable[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in samples:
            if lang and text:
                texts.setdefault(lang, []).append(text)
        self.languages = sorted(texts)
        if 2 * len(self.languages) > 64:
            raise ValueError("a slot has 64 bits, two per language")
        # the upper half of a slot's bits holds the n-grams of several samples
        self.slots = np.zeros(SLOTS, np.uint64)
        self.words: dict[str, list[int]] = {}
        for bit, lang in enumerate(self.languages):
            seen = np.zeros(SLOTS, np.uint16)
            for text in texts[lang]:
                for n, slots in _slots(self._codes(plain(text))):
                    once = np.unique(slots, axis=1)
                    self._set(once, bit)
                    if n > 1:
                        self._set(once[:, seen[once].min(axis=0) > 0], bit + len(self.languages))
                        seen[np.unique(once)] += 1
            for word in dict.fromkeys(FUNCTION_WORDS.get(lang, "").split()):
                self.words.setdefault(word, []).append(bit)
                for _, slots in _slots(self._codes(word)):
                    self._set(slots, bit)
        bits = (self.slots[:, None] >> np.arange(2 * len(self.languages), dtype=np.uint64)) & np.uint64(1)
        self.p = bits.mean(axis=0) ** HASHES

    def _set(self, slots: np.ndarray, bit: int) -> None:
        self.slots[slots.ravel()] |= np.uint64(1 << bit)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        squeezed = f" {text} "
        return np.frombuffer(squeezed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def counts(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Corrected weighted counts per span and language; spans are in order and do not overlap. Work and memory are linear in the text."""
        count = len(self.languages)
        total = np.zeros((len(spans), count))
        if not spans:
            return total
        codes = self._codes(text)
        lows = np.array([a for a, _ in spans])
        highs = np.array([b for _, b in spans]) + 2  # the blank before and after belong to the span
        owner = np.searchsorted(lows, np.arange(len(codes)), side="right") - 1
        blanks = np.concatenate([[0], np.cumsum(codes == 32)])
        shift = np.arange(2 * count, dtype=np.uint64)
        masks, rows = [], []
        for at, (n, slots) in enumerate(_slots(codes)):
            mask = self.slots[slots[0]]
            for more in slots[1:]:
                mask &= self.slots[more]
            row = owner[: len(mask)]
            blank = blanks[n:] - blanks[:-n] > (0 if n == 1 else min(n - 1, 2))  # no n-grams of blanks
            kept = (row >= 0) & (np.arange(len(mask)) < highs[row] - n + 1) & ~blank
            masks.append(mask[kept])
            rows.append(row[kept] * len(SIZES) + at)
        row = np.concatenate(rows)
        known, which = np.unique(np.concatenate(masks), return_inverse=True)
        bits = ((known[:, None] >> shift) & np.uint64(1)).astype(np.float64)
        for half in (bits[:, :count], bits[:, count:]):
            sharing = half.sum(axis=1, keepdims=True)
            np.divide(half, sharing, out=half, where=sharing > 0)
        cells = len(spans) * len(SIZES)
        grams = np.bincount(row, minlength=cells)
        for lang in range(2 * count):
            found = np.bincount(row, weights=bits[which, lang], minlength=cells)
            clear = np.maximum(0, found - grams * self.p[lang]) / (1 - self.p[lang])
            total[:, lang % count] += clear.reshape(len(spans), -1).sum(axis=1) * (1.0 if lang < count else STRONG)
        for row, (low, high) in enumerate(spans):
            for word in text[low:high].split():
                for bit in self.words.get(word, ()):
                    total[row, bit] += WORD / len(self.words[word])
        return total


def judge(counts: np.ndarray) -> tuple[int, float]:
    """The index of the largest count (-1 without evidence) and its lead over the next as a share of it."""
    best = int(np.argmax(counts))
    if counts[best] <= 0:
        return -1, 0.0
    rest = np.delete(counts, best)
    return best, float(1 - rest.max() / counts[best]) if len(rest) else 1.0


def _running(text: str) -> tuple[list[tuple[int, int]], str]:
    """The sentences of the running text and the text they are counted in."""
    units = sentences.split(text)
    running = [v for u in units if not is_structure(text, *u) for v in by_script(text, *u)] or units
    return running, plain(text, [a for a, _ in running])


def _decide(running: list[tuple[int, int]], counts: np.ndarray) -> list[tuple[int, int, int, float]]:
    found = [(*u, *judge(c)) for u, c in zip(running, counts, strict=True)]
    main = main_language(found)[0]
    known = []
    before = main
    for a, b, lang, sure in found:
        if lang < 0:
            lang, sure = before, 0.0
        elif sure < DOUBT and main >= 0 and counts[len(known)][main] >= (1 - DOUBT) * counts[len(known)][lang]:
            lang = main  # too close to call against the language of the text
        before = lang
        known.append((a, b, lang, sure))
    return known


def texts_languages(texts: list[str], filter_: LanguageFilter) -> Iterator[list[tuple[int, int, int, float]]]:
    """``(start, end, language index, confidence)`` of each sentence of the running text of each text, n-grams counted together."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < GROUP_CHARS):
            group.append(_running(texts[at]))
            size += len(texts[at])
            at += 1
        spans, offset = [], 0
        for running, shown in group:
            spans += [(a + offset, b + offset) for a, b in running]
            offset += len(shown) + 2  # a blank of its own on both sides of every text
        counts = filter_.counts("  ".join(shown for _, shown in group), spans)
        done = 0
        for running, _ in group:
            yield _decide(running, counts[done : done + len(running)])
            done += len(running)


def sentence_languages(text: str, filter_: LanguageFilter) -> list[tuple[int, int, int, float]]:
    """``texts_languages`` of one text."""
    return next(texts_languages([text], filter_))


def by_script(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A unit cut where one script's run of ``WORDS`` words or more follows another's: sentences without a mark between."""
    if not (_OTHER.search(text, start, end) and _LATIN.search(text, start, end)):
        return [(start, end)]
    runs: list[list] = []  # script, words, start
    for m in _SPACED.finditer(plain(text[start:end])):
        kind = next((s for s in map(sentences.script, m[0]) if s), "")
        if not kind:
            continue
        if runs and runs[-1][0] == kind:
            runs[-1][1] += 1
        else:
            runs.append([kind, 1, start + m.start()])
    long = [r for r in runs if r[1] >= WORDS]
    cuts = [b[2] for a, b in zip(long, long[1:], strict=False) if a[0] != b[0]]
    return [(a, b) for a, b in zip([start, *cuts], [*cuts, end], strict=True)]


def main_language(found: list[tuple[int, int, int, float]]) -> tuple[int, float]:
    """The language of most characters, and the mean confidence of its sentences weighted by their length."""
    size: Counter = Counter()
    sure: Counter = Counter()
    for a, b, lang, confidence in found:
        if lang >= 0:
            size[lang] += b - a
            sure[lang] += (b - a) * confidence
    if not size:
        return -1, 0.0
    best = min(size, key=lambda x: (-size[x], x))
    return best, sure[best] / size[best]


def is_structure(text: str, start: int, end: int) -> bool:
    """Whether a unit that fills its line is a heading, a ``Label: value`` line or a list item."""
    low = text.rfind("\n", 0, start) + 1
    high = text.find("\n", end)
    line = (text[low:start] + text[end : high if high >= 0 else len(text)]).strip(sentences.BLANK)
    return not line and sentences.structural(text, start, end)


def _tagger(filter_: LanguageFilter, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = filter_.languages
        for batch in batches:
            rows: list[int] = []
            cells: list[tuple] = []
            given = [(i, t) for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if t and t.strip(sentences.BLANK)]
            for (i, text), found in zip(given, texts_languages([t for _, t in given], filter_), strict=True):
                lang, sure = main_language(found)
                if what in ("main", "lines"):
                    rows.append(i)
                    cells.append((0, names[lang] if lang >= 0 else None, round(sure, 4)))
                if what == "main" or (what == "lines" and len({f[2] for f in found}) < 2):
                    continue
                line, at, by_line = 1, 0, {}
                for a, b, lang, sure in found:
                    line += text.count("\n", at, a)
                    at = a
                    last = line + text.count("\n", a, b)
                    if what == "sentences":
                        rows.append(i)
                        cells.append((line, names[lang] if lang >= 0 else None, round(sure, 4), last, a, b))
                    else:
                        for n in range(line, last + 1):
                            by_line[n, lang] = max(sure, by_line.get((n, lang), 0.0))
                for (n, lang), sure in by_line.items():
                    rows.append(i)
                    cells.append((n, names[lang], round(sure, 4)))
            columns = list(zip(*cells, strict=True)) if cells else [()] * 6
            keys = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[:-1]]
            found = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())]
            names_ = [*batch.schema.names[:-1], "line_no", "lang", "confidence"]
            if what == "sentences":
                found += [pa.array(c, pa.int64()) for c in columns[3:6]]
                names_ += ["last_line", "start_off", "end_off"]
            yield pa.RecordBatch.from_arrays([*keys, *found], names=names_)

    return run


def _tag(df: DataFrame, keys: list[str], text: str, filter_: LanguageFilter, what: str) -> DataFrame:
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    tail = ", last_line long, start_off long, end_off long" if what == "sentences" else ""
    return df.select(*keys, text).mapInArrow(_tagger(filter_, what), f"{head}, line_no long, lang string, confidence double{tail}")


def fit(samples: DataFrame, lang: str = "lang", text: str = "text") -> LanguageFilter:
    """A filter fitted on at most ``FIT_ROWS`` labelled rows."""
    return LanguageFilter((r[lang], r[text]) for r in samples.select(lang, text).dropna().limit(FIT_ROWS).collect())


def learn_words(filter_: LanguageFilter, labelled: DataFrame, key: str, text: str, lang: str) -> LanguageFilter:
    """The filter with the words that texts labelled right use in one language only.

    Reads the ``FIT_TEXTS`` labelled texts of least key hash. A text whose main language by n-grams is its label teaches all its words (few texts are mixed, and
    a word must lean to one language); only words seen
    in ``WORD_TEXTS`` texts leave the executors. Without labelled texts the filter stays as it is.
    """
    sample = labelled.select(key, lang, text).dropna().orderBy(F.xxhash64(key), key).limit(FIT_TEXTS).select(lang, text)
    names = filter_.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(l, t) for l, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if l in names and t.strip(sentences.BLANK)]
            seen: Counter = Counter()
            for (label, value), found in zip(rows, texts_languages([t for _, t in rows], filter_), strict=True):
                bit = names.index(label)
                if main_language(found)[0] != bit:
                    continue
                shown = plain(value, [f[0] for f in found])
                seen.update((label, w) for w in {w for a, b, *_ in found for w in shown[a:b].split() if len(w) <= 20})
                seen[label, ""] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    counted = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    texts: dict[str, int] = {}
    rates: dict[str, dict[str, float]] = {}
    rows = counted.filter((F.col("n") >= WORD_TEXTS) | (F.col("word") == "")).collect()
    texts.update((r["lang"], r["n"]) for r in rows if not r["word"])
    for r in rows:
        if r["word"]:
            rates.setdefault(r["word"], {})[r["lang"]] = r["n"] / texts[r["lang"]]
    for word, by in rates.items():
        best = max(by, key=lambda x: (by[x], x))
        if by[best] >= WORD_SHARE * sum(by.values()):
            filter_.words[word] = [names.index(best)]
    return filter_


def document_languages(df: DataFrame, keys: list[str], text: str, filter_: LanguageFilter) -> DataFrame:
    """``(*keys, line_no = 0, lang, confidence)``: the main language of every text that is not blank."""
    return _tag(df, keys, text, filter_, "main")


def sentence_rows(df: DataFrame, keys: list[str], text: str, filter_: LanguageFilter) -> DataFrame:
    """``(*keys, line_no, lang, confidence, last_line, start_off, end_off)`` of every sentence of the running text."""
    return _tag(df, keys, text, filter_, "sentences")


def line_languages(df: DataFrame, keys: list[str], text: str, filter_: LanguageFilter) -> DataFrame:
    """``(*keys, line_no, lang, confidence)``: line 0 has the main language; texts with sentences of several languages also
    have a row for each line and language of a sentence in it."""
    return _tag(df, keys, text, filter_, "lines")


def segments(rows: DataFrame, key: str) -> DataFrame:
    """Runs of sentences of one language: ``(key, segment, lang, confidence, start_off, end_off)`` of ``sentence_rows``.

    The window runs inside one document, whose sentences come from one text.
    """
    order = W.partitionBy(key).orderBy("start_off")
    turned = F.coalesce((F.col("lang") != F.lag("lang").over(order)).cast("int"), F.lit(0))
    return (
        rows.distinct()
        .withColumn("turn", turned)
        .withColumn("segment", F.sum("turn").over(order))
        .groupBy(key, "segment").agg(
            F.first("lang").alias("lang"),
            F.round(F.sum(F.col("confidence") * (F.col("end_off") - F.col("start_off"))) / F.sum(F.col("end_off") - F.col("start_off")), 4).alias("confidence"),
            F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"),
        )
    )
