"""Personal information in free text: finding it and replacing it by typed placeholders.

Aho-Corasick finds the anchors of a text in one pass: at-signs and their written forms, schemes, the first elements of
addresses, alias cues and the known parts of names in every script. A deterministic parser expands each anchor to its
boundaries and validates it; numbers (phones and identity numbers) are found by shape, since they need no cue. What stands in
a link is no e-mail address of a person. An address runs over comma-separated elements (streets, blocks, sectors) to its last town,
known by its ending, by the PIN code after it, or by its place at the end of the clause after a street.

Parts of names are learned, not listed: a table of known persons gives first and last names, and the values of name
labels and the items of witness lists of all texts give those of all scripts. They are counted in the executors; only the
vocabulary comes to the driver. Names of unspaced scripts are split into the beginnings and endings that several names share.

Defined results: null, empty and blank texts have no occurrences and stay as they are; offsets count code points of the
text as given; occurrences never overlap (an e-mail address, address or number wins over a name inside it, the longer over
the shorter); texts of any length are read whole; copies of a row count once in ``found_rows`` (equal output rows collapse);
an empty table gives no rows; extra columns do not pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import fold

#: Times a part of a name must be seen in the texts.
SEEN = 2

# Labels before names, headers of witness lists, cues of aliases and first elements of addresses.
NAME_LABELS = (
    "complainant name", "complainant", "name", "shikayatkarta", "शिकायतकर्ता", "फरियादी", "तक्रारदार", "अर्जदार", "অভিযোগকারী", "புகார்தாரர்", "مدعی", "报案人", "届出人", "ผู้แจ้ง",
)
LIST_HEADS = ("persons of interest", "witnesses", "gawah", "गवाह", "साक्षीदार", "সাক্ষী", "சாட்சிகள்", "گواہان", "证人", "証人", "พยาน")
ALIAS_CUES = ("alias", "urf", "known as", "aka", "उर्फ", "عرف", "ওরফে", "என்கிற")
HOUSE_CUES = (
    "door no", "house no", "h.no", "h. no", "flat", "plot", "village", "c/o", "qr. no", "quarter no", "मकान नं", "मकान क्रमांक", "घर क्रमांक", "घर नं", "फ्लैट", "प्लॉट", "गाँव", "ग्राम",
)
SCHEMES = ("http://", "https://", "ftp://", "www.")
THAI_TITLES = ("นางสาว", "นาย", "นาง", "ด.ช.", "ด.ญ.", "คุณ")
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()

GAP = r"[ \t\x0b\x0c\r\xa0﻿]*(?:\n[ \t\x0b\x0c\r\xa0﻿]*)?"
_SP = r"(?=[\s\xa0﻿])" + GAP
_DIGITS = {0x660 + i: 48 + i for i in range(10)} | {0x6F0 + i: 48 + i for i in range(10)}
for _base in (0x966, 0x9E6, 0xA66, 0xAE6, 0xBE6, 0xC66, 0xCE6, 0xE50, 0xFF10):
    _DIGITS |= {_base + i: 48 + i for i in range(10)}
_LOWER = {c: c + 32 for c in range(65, 91)}
_B, _E = r"(?<![A-Za-z0-9])(?<![0-9][-/.])", r"(?![A-Za-z0-9])(?![-/][0-9])"
_PHONE = re.compile(
    _B + rf"(?:(?:\+91|0091|\+{GAP}91)[\s.\-\xa0]?{GAP}|0(?=[6-9])|91(?=[6-9][0-9]{{9}}(?![0-9]))|\+91\(0\))?"
    r"(?:[6-9][0-9]{9}|[6-9][0-9]{4}[ \-\xa0][0-9]{5}|[6-9][0-9]{2}[- ][0-9]{3}[- ][0-9]{4}|[6-9][0-9]{3}[ -][0-9]{3}[ -][0-9]{3}|[6-9][0-9]{3}\.[0-9]{6})" + _E
    + r"|\((?:\+91[ -]?)?0?[6-9][0-9]{2,4}\)[ -]?[0-9]{3}[ -]?[0-9]{3,4}(?![0-9])"
)
_SPOKEN = re.compile(rf"\b(?:(?:plus{_SP})?nine{_SP}one{_SP}|zero{_SP})?(?:six|seven|eight|nine)(?:{_SP}(?:{'|'.join(DIGIT_WORDS)})){{9}}\b", re.I)
_ID = re.compile(
    _B + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}|[0-9]{12}|[A-Za-z]{5}[0-9]{4}[A-Za-z]|[A-Za-z][0-9]{7}|[A-Za-z]{3}[0-9]{7}|[A-Za-z]{2}[0-9]{2}[ -]?[0-9]{11})" + _E
)
_AT_LEFT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*[ \xa0]?$")
_DOT = r"(?:\.|[ \xa0]?[\[(]dot[\])][ \xa0]?)"
_AT_RIGHT = re.compile(rf"[ \xa0]?(?:[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9-]+)+|[A-Z0-9][A-Z0-9-]*(?:\.[A-Z0-9-]+)+)")
_TOWN = r"[A-Z][a-z]{2,}(?:pur|pura|ganj|gaon|nagar|wadi|palem|garh|khera|abad|patti|puri|kot|halli|ur)"
#: A town by its place alone: capitalised words right before a PIN code, or after a street where the clause ends.
_PLACED = rf"[A-Z][a-z]{{2,}}(?:{_SP}[A-Z][a-z]{{2,}})?"
_PIN = r"(?:[ \xa0]*[-–][ \xa0]*[0-9]{3}[ ]?[0-9]{3}|[ \xa0]+[0-9]{3}[ ]?[0-9]{3})(?![0-9])"
_ELEMENT = re.compile(
    rf"(?:(?P<pin>PIN{GAP}[:\-]?{GAP}[0-9]{{3}}[ ]?[0-9]{{3}}(?![0-9]))|P\.?{GAP}O\.?{_SP}[A-Z][a-z]+|Block{_SP}[A-Z0-9]+\b|Sector{_SP}[0-9]+\b|Near{_SP}[A-Z][a-z]+(?:{_SP}[A-Z][a-z]+){{0,2}}"
    rf"|[0-9]+(?:st|nd|rd|th){_SP}Cross|(?:[A-Z][a-z]+{_SP}){{1,2}}(?:Street|Apartments|Layout|Lane|Colony|Road|Rd\.|Marg|Nagar|Society|Extn\.)"
    rf"|(?P<town>{_TOWN}\b|{_PLACED}(?={_PIN}))(?P<code>{_PIN})?)"
)
_ROAD = re.compile(rf"(?:[A-Z][A-Za-z.]*{_SP}){{1,3}}(?:Street|Apartments|Layout|Lane|Colony|Road|Rd\.?|Marg|Nagar|Society|Extn\.?|Avenue|Main|Enclave|Vihar)(?![A-Za-z])")
_LAST_TOWN = re.compile(rf"{_PLACED}(?={GAP}(?:[.;)]|$|\n))")
_HOUSE = re.compile(
    rf"(?:(?:Door|House){_SP}No\.?{GAP}[0-9]+[A-Z]?|H\.{GAP}No\.?{GAP}[0-9]+[A-Z]?|Flat{_SP}[0-9]+[A-Z]?|Plot{_SP}(?:[A-Z]-?)?[0-9]+[A-Z]?|Village{_SP}[A-Z][a-z]+"
    rf"|C/o{_SP}(?:Shop|House|Flat|Plot){_SP}[0-9]+[A-Z]?|Q(?:r|uarter)\.?{_SP}No\.?{GAP}(?:[A-Z]/)?[0-9]+|[0-9]{{1,4}}/[0-9]{{1,4}}(?={GAP},{GAP}[0-9]+(?:st|nd|rd|th){_SP}Cross))"
)
_SLASHED = re.compile(rf"(?<![0-9/A-Za-z])[0-9]{{1,4}}/(?:[0-9]{{1,4}}(?={GAP},{GAP}[0-9]+(?:st|nd|rd|th){_SP}Cross)|[क-ह](?={GAP},))")
_DEVA = r"[ऀ-ॣ॰-ॿ]+"
_HOUSE_DEVA = re.compile(rf"(?:मकान|घर){_SP}(?:नं\.?|क्रमांक){GAP}[0-9]+|(?:फ्लैट|प्लॉट){_SP}[0-9]+|(?:गाँव|ग्राम){_SP}{_DEVA}|[0-9]{{1,4}}/[क-ह]")
_ELEMENT_DEVA = re.compile(rf"(?:गली{_SP}[0-9]+|{_DEVA}{_SP}(?:मार्ग|अपार्टमेंट|कॉलोनी|नगर|रोड|चौक|सोसायटी)|(?P<town>{_DEVA})(?P<code>{_PIN})?)")
_COMMA = re.compile(rf"{GAP},{GAP}")
_LABEL_LINE = re.compile(r"[ \t\xa0\x0b\x0c﻿]*([^:：\n]{2,40}?)[ \t\xa0\x0b\x0c]*[:：][ \t\xa0\x0b\x0c]*([^\n]*)")
_ITEM = re.compile(r"[ \t\xa0\x0b\x0c﻿]*(?:[-•*]|[0-9]{1,3}[.)]|\([a-z]{1,3}\))[ \t\xa0\x0b\x0c]+([^\n(（]*)")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-෿‌‍])*")
_INITIAL = re.compile(r"[A-Z]\.")
_ALIAS = re.compile(rf"{_SP}([^\W\d_](?:[^\W\d_]|[ऀ-෿‌‍])*)")


def squeeze(text: str) -> str:
    return re.sub(r"[\s\x0b\x0c﻿]+", " ", text).strip()


def kind_of(token: str) -> str:
    """Script group of a name token: ``latin``, ``indic`` (spaced), ``arabic`` or ``dense`` (no spaces)."""
    o = ord(token[0])
    if o < 0x250:
        return "latin"
    if 0x0E00 <= o < 0x0E80 or o >= 0x3040:
        return "dense"
    return "arabic" if 0x600 <= o < 0x780 else "indic"


def name_parts(text: str) -> Iterator[tuple[str, str]]:
    """``(role, token)`` of the names in the labels and witness lists of a text; roles are first, last, dense."""
    listing = False
    for line in text.split("\n"):
        value = None
        if (m := _ITEM.match(line)) and listing:
            value = m[1]
        elif (m := _LABEL_LINE.match(line)) is not None:
            label = squeeze(m[1]).lower()
            listing = label in LIST_HEADS and not m[2].strip()
            if label in NAME_LABELS:
                value = m[2]
        elif line.strip():
            listing = False
        if not value:
            continue
        words = [w for w in unicodedata.normalize("NFC", squeeze(value)).split(" ") if w]
        if not words or len(words) > 4 or any(c.isdigit() for w in words for c in w):
            continue
        if kind_of(words[0]) == "dense":
            if len(words) == 1 and 2 <= len(words[0]) <= 14:
                yield "dense", words[0]
            continue
        for i, w in enumerate(words):
            w = w.strip(".,()-")
            if len(w) > 1 and _WORD.fullmatch(w):
                yield ("last" if i == len(words) - 1 and len(words) > 1 else "first"), w.lower()


def person_parts(name: str) -> Iterator[tuple[str, str]]:
    """``(role, token)`` of a known person's name; a name of one word has none."""
    words = name.lower().split()
    if len(words) > 1:
        yield from (("first", w) for w in words[:-1])
        yield "last", words[-1]


class NameBook:
    """Known parts of names by role; Indic tokens are also known by the fold of their Latin spelling."""

    def __init__(self, parts: Iterable[tuple[str, str, int]], persons: Iterable[str] = ()):
        roles: dict[str, Counter] = {"first": Counter(), "last": Counter(), "dense": Counter()}
        for role, token, n in parts:
            roles[role][token] += n
        for name in persons:
            for role, token in person_parts(name):
                roles[role][token] += SEEN
        keep = lambda c: {t for t, n in c.items() if n >= SEEN}
        first, last = keep(roles["first"]), keep(roles["last"])
        # a token seen in both roles belongs to the one it has far more often
        self.first = {t for t in first if roles["first"][t] * 3 >= roles["last"][t]}
        self.last = {t for t in last if roles["last"][t] * 3 >= roles["first"][t]}
        self.folded_first, self.folded_last = (
            {f for t in known if kind_of(t) == "latin" for f in (fold(t), fold(t).replace("v", "b"))} for known in (self.first, self.last)
        )
        self.dense = self._dense(roles["dense"])

    @staticmethod
    def _dense(names: Counter) -> set[str]:
        """The names seen, and family names joined to given names of the same group.

        A name is cut where beginning and ending both recur in most other names; groups are the beginnings and endings
        connected by names, so that those of two languages are not mixed.
        """
        seen = {n for n, k in names.items() if k >= SEEN}
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        for n in names:  # parts that recur make up for names seen once
            for i in range(1, len(n) if ord(n[0]) >= 0x3040 else 1):  # scripts with family names first
                heads.setdefault(n[:i], set()).add(n[i:])
                tails.setdefault(n[i:], set()).add(n[:i])
        cuts: dict[str, set[str]] = {}
        for n in names:
            weight, i = max(((min(len(heads[n[:i]]), len(tails[n[i:]])), -i) for i in range(1, len(n)) if n[:i] in heads), default=(0, 0))
            if weight > 1:
                cuts.setdefault(n[:-i], set()).add(n[-i:])
        groups: list[tuple[set[str], set[str]]] = []
        for head, given in cuts.items():
            near = [g for g in groups if g[1] & given]
            groups = [g for g in groups if not g[1] & given] + [({head}.union(*(g[0] for g in near)), given.union(*(g[1] for g in near)))]
        return seen | {h + t for hs, ts in groups for h in hs for t in ts}

    def is_first(self, token: str) -> bool:
        t = unicodedata.normalize("NFC", token).lower()
        return t in self.first or (kind_of(t) == "indic" and _spelt(t, self.folded_first))

    def is_last(self, token: str) -> bool:
        t = unicodedata.normalize("NFC", token).lower()
        return t in self.last or (kind_of(t) == "indic" and _spelt(t, self.folded_last))


def to_deva(token: str) -> str:
    """A Bengali token in the Devanagari letters at the same places of their blocks."""
    return "".join(chr(ord(c) - 0x80) if "ঀ" <= c <= "৿" else c for c in token)


def _spelt(token: str, folded: set[str]) -> bool:
    """Whether an Indic token spells a known Latin one; Bengali writes b for v."""
    form = fold(to_deva(token))
    return form in folded or ("ঀ" <= token[0] <= "৿" and form.replace("v", "b") in folded)


class Finder:
    """Finds the occurrences in a text, with a name book."""

    def __init__(self, book: NameBook):
        import ahocorasick

        self.book = book
        self.roles: dict[str, str] = {}
        machine = ahocorasick.Automaton()
        for at in ("@", "(at)", "[at]", "（at）"):
            machine.add_word(at, ("at", len(at)))
        for cue in HOUSE_CUES:
            machine.add_word(cue, ("house", len(cue)))
        for cue in ALIAS_CUES:
            machine.add_word(cue, ("alias", len(cue)))
        for scheme in SCHEMES:
            machine.add_word(scheme, ("scheme", len(scheme)))
        for name in book.dense:
            machine.add_word(name, ("dense", len(name)))
        for part in book.first | book.last:
            if not machine.exists(part):
                machine.add_word(part, ("part", len(part)))
        machine.make_automaton()
        self.machine = machine

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in order, without overlaps."""
        plain = text.translate(_DIGITS)
        hits: list[tuple[int, int, int, str]] = []  # rank, start, end, kind
        dense: list[tuple[int, int]] = []
        parts: list[tuple[int, int]] = []
        linked = 0  # where the last link ends: its parts are no address of a person
        for end, (what, size) in self.machine.iter(plain.translate(_LOWER)):
            start, end = end - size + 1, end + 1
            if what == "part":
                parts.append((start, end))
            elif what == "scheme":
                if start >= linked and not (start and plain[start - 1].isalnum()):
                    linked = _LINK.match(plain, end).end()
            elif what == "at":
                if start < linked:
                    continue
                left = _AT_LEFT.search(plain, max(0, start - 80), start)
                right = _AT_RIGHT.match(plain, end)
                if left and right:
                    hits.append((0, left.start(), right.end(), "EMAIL"))
            elif what == "house":
                if span := self._address(plain, start):
                    hits.append((1, *span, "ADDRESS"))
            elif what == "alias":
                before = plain[start - 1 : start]
                m = _ALIAS.match(plain, end)
                if m and not (before and before.isalnum()) and self._alias(plain, m):
                    hits.append((3, m.start(1), m.end(1), "NAME"))
            else:
                dense.append((start, end))
        for m in _SLASHED.finditer(plain):
            if span := self._address(plain, m.start()):
                hits.append((1, *span, "ADDRESS"))
        for m in _PHONE.finditer(plain):
            hits.append((2, m.start(), m.end(), "PHONE"))
        for m in _SPOKEN.finditer(plain):
            hits.append((2, m.start(), m.end(), "PHONE"))
        for m in _ID.finditer(plain):
            hits.append((2, m.start(), m.end(), "ID"))
        hits += [(3, a, b, "NAME") for a, b in self._names(plain, parts)]
        hits += [(3, a, b, "NAME") for a, b in dense if self._dense_name(plain, a, b)]
        hits.sort(key=lambda h: (h[0], h[1] - h[2], h[1]))
        taken: list[tuple[str, int, int]] = []
        used = bytearray(len(text))
        for _, a, b, kind in hits:
            if not any(used[a:b]):
                used[a:b] = b"\x01" * (b - a)
                taken.append((kind, a, b))
        return sorted(taken, key=lambda t: t[1])

    @staticmethod
    def _address(text: str, start: int) -> tuple[int, int] | None:
        """An address from its first element to its last town or PIN code."""
        if start and (text[start - 1].isalnum() and ord(text[start - 1]) < 0x3040):
            return None
        house, element = _HOUSE.match(text, start), _ELEMENT
        if not house:
            house, element = _HOUSE_DEVA.match(text, start), _ELEMENT_DEVA
        if not house:
            return None
        end = last = house.end()
        closed = street = False
        while not closed:
            comma = _COMMA.match(text, end)
            part = element.match(text, comma.end()) if comma else None
            if not part and comma and element is _ELEMENT:
                if road := _ROAD.match(text, comma.end()):
                    end, street = road.end(), True
                    continue
                if street and last == house.end() and (town := _LAST_TOWN.match(text, comma.end())):
                    last = town.end()
                break
            if not part:
                break
            end = part.end()
            groups = part.groupdict()
            if groups.get("pin") or groups.get("code"):
                last, closed = end, True
            elif groups.get("town"):
                last = end
                if element is _ELEMENT_DEVA:
                    closed = True
            else:
                street = True
        return (start, last) if last > house.end() else None

    def _alias(self, text: str, m: re.Match) -> bool:
        word = m[1]
        if kind_of(word) == "latin":
            return word[0].isupper() and len(word) > 2
        return True

    @staticmethod
    def _dense_name(text: str, start: int, end: int) -> bool:
        """A name of an unspaced script; Thai names need a title or a line of their own before them."""
        if "ก" <= text[start] <= "๛":
            before = text[max(0, start - 8) : start]
            return before.endswith(THAI_TITLES) or not before or not ("ก" <= before[-1] <= "๛")
        return True

    def _names(self, text: str, parts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Names of spaced scripts: first names and initials, then a last name or its initial.

        ``parts`` are the anchors; those that are whole words count. Words of other scripts than Latin are also known by how a Latin part is spelt.
        """
        tokens: list[tuple[int, int, str]] = []  # start, end, role: f, l, b(oth), i
        taken = set()
        for a, b in parts:
            if not (a and _IN_WORD.match(text, a - 1)) and not _IN_WORD.match(text, b):
                tokens.append((a, b, self._role(text[a:b])))
                taken.add(a)
        tokens += [(m.start(), m.end(), "i") for m in _INITIAL_TOKEN.finditer(text)]
        tokens += [(m.start(), m.end(), self._role(m[0])) for m in _SPELT_TOKEN.finditer(text) if m.start() not in taken]
        tokens.sort()
        i = 0
        while i < len(tokens):
            role = tokens[i][2]
            if role not in "fbi" or (role == "i" and not self._free(text, tokens[i][0])):
                i += 1
                continue
            j, full, stop = i, False, -1
            while True:
                r = tokens[j][2]
                full = full or r in "fb"
                if r in "lb" and j > i:
                    stop = j
                    break
                if r == "i" and j > i and full and stop < 0:
                    stop = j  # an initial may stand for the last name
                if j - i >= 4 or j + 1 >= len(tokens) or tokens[j + 1][2] not in "flbi" or not tokens[j + 1][2]:
                    break
                if not _JOINT.fullmatch(text, tokens[j][1], tokens[j + 1][0]):
                    break
                j += 1
            if stop > i and (full or tokens[stop][2] in "lb"):
                yield tokens[i][0], tokens[stop][1]
                i = stop + 1
            else:
                i += 1

    @staticmethod
    def _free(text: str, start: int) -> bool:
        return not (start and (text[start - 1].isalnum() or _DOTTED.search(text, max(0, start - 2), start)))

    def _role(self, word: str) -> str:
        known = self.roles.get(word)
        if known is None:
            first, last = self.book.is_first(word), self.book.is_last(word)
            known = "b" if first and last else "f" if first else "l" if last else "-"
            if len(self.roles) > 200_000:
                self.roles.clear()
            self.roles[word] = known
        return known


_DOTTED = re.compile(r"[^\W\d_]\.$")
_INITIAL_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?<![A-Za-z]\.)[A-Z]\.")
_IN_WORD = re.compile("[^\\W\\d_]|[ऀ-෿‌‍̀-ͯ]")
_SPELT_TOKEN = re.compile("(?<![ऀ-෿‌‍\u0600-\u06ff])(?:(?![٠-٩۰-۹])[ऀ-෿\u0600-\u06ff])(?:[^\\W\\d_]|[ऀ-෿‌‍̀-ͯ])+")
_LINK = re.compile(r"\S*")
_JOINT = re.compile(rf"{GAP}")


def redact(text: str | None, finder: Finder) -> str | None:
    """The text with each occurrence replaced by its kind in angle brackets and all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in finder(text):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def _counted(df: DataFrame, column: str, parts: Callable[[str], Iterator[tuple[str, str]]], weight: int) -> DataFrame:
    """``(role, token, n)`` of the parts in a column, counted within each batch, each occurrence ``weight`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0).to_pylist():
                seen.update(parts(value))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] * weight for k in keys], pa.int64())],
                names=["role", "token", "n"],
            )

    return df.select(column).dropna().mapInArrow(run, "role string, token string, n long")


def vocabulary(texts: DataFrame, text: str, persons: DataFrame | None = None, name: str = "full_name") -> DataFrame:
    """``(role, token, n)``: the parts of names in all texts and of all known persons that a name book uses.

    First and last names seen less than ``SEEN`` times stay in the executors: they are in no book and never outweigh the other
    role. Names of unspaced scripts come whole, since those seen once still show where the others are split. The rows grow with
    the distinct names of the corpus, not with its texts.
    """
    parts = _counted(texts, text, name_parts, 1)
    if persons is not None:
        parts = parts.unionByName(_counted(persons, name, person_parts, SEEN))
    return parts.groupBy("role", "token").agg(F.sum("n").alias("n")).filter((F.col("n") >= SEEN) | (F.col("role") == "dense"))


def learn(texts: DataFrame, text: str, persons: DataFrame | None = None, name: str = "full_name") -> NameBook:
    """A name book from the labels and lists of all texts and from all known persons."""
    return NameBook((r["role"], r["token"], r["n"]) for r in vocabulary(texts, text, persons, name).collect())


def found_rows(df: DataFrame, table: str, key: str, text: str, finder: Finder) -> DataFrame:
    """``(src_table, row_key, pii_type, start_off, end_off)`` of every occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for kind, a, b in finder(value) if value else ():
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([table] * len(rows), pa.string()), batch.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["src_table", "row_key", "pii_type", "start_off", "end_off"],
            )

    keyed = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "src_table string, row_key string, pii_type string, start_off long, end_off long").distinct()


def redacted_rows(df: DataFrame, key: str, text: str, finder: Finder) -> DataFrame:
    """``(row_key, text)`` of every row, occurrences replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t, finder) for t in batch.column(1).to_pylist()], pa.string())], names=["row_key", "text"])

    return df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).mapInArrow(run, "row_key string, text string")
