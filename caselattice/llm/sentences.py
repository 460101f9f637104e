"""Sentence units of texts in spaced and spaceless scripts.

A text is read line by line. Headings, ``Label: value`` lines and list items are units of their own; the other lines form
running blocks. A line break inside a block either comes from wrapping (the next word would not have fitted into the
width the text is wrapped at) or ends a sentence. Inside a block

* spaced scripts go through a lattice of terminators: each mark, alone or in a run, is judged by the token before it
  (abbreviation, initial, number), by what follows and by the quotation it stands in; a quotation belongs to its sentence;
* Thai, which has neither spaces between words nor end marks, is cut into words by the cheapest path through a dictionary
  lattice; each gap is then judged by the last word before it (can it end a sentence?) and the first word after it (can it
  open one?). Lines of Chinese and Japanese without an end mark are judged by the same particles and openers.

Defined results: null, empty and blank texts have no units; a byte-order mark is white space; offsets count code points;
every character that is not white space lies in exactly one unit; texts of any length are split whole; repeated rows give
repeated units; an empty table gives no rows; extra columns do not pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Word lists of the ten languages, in natural order.
#: Abbreviations after which a sentence goes on, whatever follows.
PREFIXES = frozenset(
    "mr mrs ms dr sh smt km shri insp asi si ps po gd dy sub dsp sp-ct const hav no nos ref rs inr hon addl asst dist govt"
    " st sec art cl qr vol wt net approx viz vide ie eg cf fig pvt cr pp u/s r/w s/o d/o w/o c/o m/s prof col capt maj gen rev"
    " jr sr messrs tel ph mob regd ext".split()
)
#: Abbreviations that may end a sentence when an opener follows.
CLOSERS = frozenset(
    "etc co ltd bros corp inc rd extn hosp commr sgt am pm hrs min mins sec secs kg cm km jan feb mar apr jun jul aug sep"
    " sept oct nov dec app fsl rto sp dc cid cbi".split()
)
#: English and romanised Hindi words that open sentences, for use after an initial or an acronym.
OPENERS = frozenset(
    "The A An On In At He She It They We His Her Their No None Nothing Nobody This That These Those There Then Thereafter"
    " Meanwhile Later After Before As According Prima To During Who Why What When Where Which How Did Is Was Were Are Do"
    " Does Has Have Had If But And Or So Yet Hence Therefore Accordingly Further Furthermore Moreover Also All Both Some"
    " Several Many Each Every Approx Copies Case Cards Ropes Bills Notice One Two Three From For With Upon Under By My Our"
    " Mr Mrs Ms Smt Dr Insp Phir Uske Usi Usne Police Gawah Asal Sach Jab Tab Woh Yeh Hum Mera Meri Mere Dukaan Gaadi Bank"
    " Screen Driver Kya Kaun Kisne Jaanch Sabko Maine Aapne Chaabi Taala Shikayat Chowkidar Paisa Lekin Aur Magar".split()
)
#: Words after which no English or romanised Hindi sentence ends.
OPEN_ENDS = frozenset(
    "the a an of at by to and or in on for from with into near under was were is are be been has have had his her its their"
    " not no that which who as than ka ke ki ko se mein par aur ne bhi hi toh jo jiska wahan yahan kisi".split()
)
#: Copulas, with which a clause ends, and words that join another clause to it.
COPULAS = frozenset("hai hain hoon tha thi है हैं था थी थे हूँ आहे आहेत होता होती होते ছিল ছিলেন ہے ہیں تھا تھی تھے ہوں".split())
CONJUNCTIONS = frozenset("aur lekin ki kyunki jo jab toh और कि तो लेकिन मगर जो जब क्योंकि आणि पण की म्हणून এবং আর কিন্তু যে তবে اور کہ لیکن مگر جو جب".split())
#: Last words of romanised Hindi sentences.
ROMAN_FINALS = frozenset("hai hain hoon tha thi gaya gayi gaye hua hui diya liya mila bola kaha aaya uthaya".split())
#: Abbreviations written in other scripts.
ABBREVIATIONS = frozenset(
    "श्री श्रीमती सुश्री कु डॉ प्रो पु.नि पो.नि मु.अ.सं मु.अ सं रु नं क्र क्रमांक मो मा स्व जि ता पु पो नि अ मि ले ई वि"
    " মো ডা ডাঃ শ্রী শ্রীমতী নং রু ড অধ্যা திரு திருமதி டாக்டர் ரூ எண் செல்வி.த பேரா கி.மீ ڈاکٹر نمبر น พ.ศ ค.ศ ด.ต ร.ต พ.ต".split()
)
#: Words that open a sentence in scripts without capitals; they count after a quotation.
SCRIPT_OPENERS = (
    "इसके बाद", "उसी दिन", "पुलिस के", "बयान के", "पूछताछ में", "आगे,", "त्यानंतर", "त्याच दिवशी", "पोलिसांच्या", "चौकशीत", "जबाबानुसार",
    "এরপর", "সেদিনই", "পুলিশের মতে", "জবানবন্দি", "அதன் பிறகு", "அதே நாளில்", "வாக்குமூலத்தின்படி", "اس کے بعد", "اسی دن", "پولیس کے", "بیان کے",
    "当天，", "随后，", "经查，", "据了解，", "その後、", "同日、", "なお、", "調べによると、",
)
#: Last words (or endings) of sentences in scripts without capitals.
FINAL_WORDS = frozenset(
    "है हैं था थी थे हूँ हो गया गई गए दिया दी लिया हुआ हुई मिला मिली बताया कहा दिखे लगा भेजा आहे आहेत होता होती होते केला केली केले"
    " गेला गेली दिसले सांगितले नाही झाला झाली मिळाली आली घेतली फोडली होती दिला सापडला सापडली सापडले"
    " ছিল ছিলেন হয় হয়েছে দেয় যায় যান ফেরেনি চলছে হয়নি পড়ে করেন চালাতেন জানান ফেলেন গেল ভাঙল দেখেছিল থাকি পাঠিয়েছিল"
    " ہے ہیں تھا تھی تھے ہوں گیا گئی گئے دیا دی کیا ہوا ہوئی آیا ملا گا گے آئی نکلی".split()
)
FINAL_ENDINGS = ("ார்", "ார்கள்", "னர்", "ன", "து", "வில்லை", "றது", "டது", "கிறேன்", "டேன்", "ஆகும்", "ளார்", "வான்", "யார்")
#: Helping verbs that continue the sentence of the line before.
HELPERS = frozenset("है हैं था थी थे हूँ हो गया गई गए दिया दी लिया रहा रही रहे हुआ हुई मिला मिली आहे आहेत होता होती होते केला केली गेला गेली नाही ہے ہیں تھا تھی تھے ہوں گیا گئی دیا رہا رہی ہوا ہوئی না হয় যায় দেয় ছিল".split())
#: Chinese and Japanese function words for the lattice: those that end a sentence and those after which it goes on.
CJK_FINALS = frozenset("です ます でした ました ません ない だ だった である た る か ね よ せん いる ある した する なる 了 吗 呢 吧 啊 过 着".split())
CJK_NONFINALS = frozenset(
    "は が を に で と も の へ や から まで より ので のに けど ながら および または という として について によって に対して て し ば"
    " 的 和 与 及 或 在 把 被 对 从 向 于 为 将 并 而 但 因 由 以 跟 给 到 是 有 该 其 这 那".split()
)
CJK_WORDS = CJK_FINALS | CJK_NONFINALS
#: Thai words: those that open a sentence, that go on with one, and that cannot end one; the rest fill the lattice.
THAI_OPENERS = frozenset(
    "เจ้าหน้าที่ จากการตรวจค้น จากการสอบสวน จากการ รถ รถทะเบียน กุญแจ กุญแจร้าน ตำรวจ ไม่มี ไม่มีใคร พยาน คดี คดีนี้ ผู้ต้องหา ผู้เสียหาย ผู้แจ้งความ"
    " ข้อความ ข้อความข่มขู่ นาง นาย นางสาว เพื่อนบ้าน เจ้าของร้าน ต่อมา ในวันเดียวกัน หมายเลขโทรศัพท์ หลังจากนั้น วันนี้ เขา เธอ มัน พวกเขา ฉัน ผม เรา"
    " ทั้งนี้ อย่างไรก็ตาม นอกจากนี้ ดังนั้น ร้าน บ้าน ใคร ทำไม เหตุใด".split()
)
THAI_CONTINUERS = frozenset(
    "และ แต่ หรือ ที่ ซึ่ง อัน เพื่อ โดย ตามที่ ตาม เมื่อ เมื่อคืนนี้ ว่า จึง ก็ แล้ว กับ ของ จน จนถึง เพราะ เนื่องจาก ถึง บาท กิโลกรัม เครื่อง ชิ้น คน น. วัน ปี"
    " ออกจาก ออก ไว้ ใน บน ใต้ จาก ให้ ไป มา อีก".split()
)
THAI_NONFINAL = frozenset("คือ ว่า ของ ที่ เมื่อวันที่ วันที่ หนัก เวลา พบ อีเมล ทะเบียน โทรศัพท์ เงิน โอนเงิน ถอนเงิน และ แต่ หรือ กับ โดย จาก ใน เลขที่ หมายเลข ชื่อ อายุ ราคา จำนวน".split())
THAI_WORDS = THAI_OPENERS | THAI_CONTINUERS | THAI_NONFINAL | frozenset(
    "ยึด ของกลาง ตรวจสอบ ตรวจค้น โอน ถอน ปิด ทันที หลบหนี เกิดเหตุ ไม่ กลับ บ้าน มา หลาย นาน แล้ว ให้การ ชาย แปลกหน้า สอง หมู่บ้าน เห็น เลย หรือไม่"
    " ส่ง ข่มขู่ คืน นี้ งัด ลิ้นชัก ว่างเปล่า ร้องไห้ ตกใจ บอก จะ เล่า ทุกอย่าง ฟัง ได้รับ แจ้งความ เป็น หนังสือ สถานีตำรวจ ยัง อยู่ ระหว่าง สอบสวน ขน กล่อง ป้าย"
    " ซุกซ่อน เบาะ ถูก จด ตลาด ท่าเรือ คลอง ริม มี ป้ายทะเบียน".split()
)

BLANK = " \t\r\n\x0b\x0c\x85\xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B))) + "\x1c\x1d\x1e\x1f"
_INK = re.compile(f"[^{re.escape(BLANK)}]")
_THAI = "ก-๛"
_ITEM = re.compile(r"(?:[-•*–—▪]|\(?[0-9०-९০-৯]{1,3}[.)]|\([a-zA-Zivx]{1,4}\)|[a-z]\))[ \t\xa0]+\S")
_BULLET = re.compile(r"(?:[-•*▪]|\([a-z]\))[ \t\xa0]")
_LABEL = re.compile(r"[^\W\d][^:：0-9\"“「(（,，。।!?\n]{0,40}(?::(?=[ \t\xa0]|$)|：(?![“「\"]))")
_LIST_HEAD = re.compile(r"[^\n0-9,，。!?]{1,40}[:：]\s*\n\s*" + _ITEM.pattern)
_ENDED = re.compile(r"[.!?。！？।॥؟۔…][\"”’」』)\]]*$|[\"”」』]$")
_MARKS = re.compile(r"(?P<mark>[.!?。！？।॥؟۔…]+)|(?P<quote>[\"“”「」『』])|(?P<line>\n)")
_STRONG = re.compile("[!?。！？।॥؟۔]")
_TOKEN = re.compile(r"[^\s﻿\"“(\[「]*$")
_WORD = re.compile(r"[^\W\d_][^\s,.;:!?\"]*")
_THAI_GAP = re.compile(f"(?<=[{_THAI}])[\\s\\ufeff]+|[\\s\\ufeff]+(?=[{_THAI}])")
_THAI_RUN = re.compile(f"[{_THAI}]+")
_ACRONYM = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]\.)+[A-Za-z]$")
_INNER = re.compile(r"^.*[a-z]{3,}[.!?]+(?=[A-Z])")
_MIXED = re.compile(r"[a-z]-?[A-Z]")


def script(ch: str) -> str:
    """A coarse script of a letter: ``latin``, ``thai``, ``cjk``, ``indic``, ``arabic`` or ``""``."""
    o = ord(ch)
    if o < 0x250:
        return "latin" if ch.isalpha() else ""
    if 0x900 <= o < 0xE00:
        return "indic"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x600 <= o < 0x780:
        return "arabic"
    if 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "cjk"
    return ""


def lattice_words(run: str, lexicon: frozenset[str], longest: int) -> tuple[str, ...]:
    """The cheapest path through the lattice of a run's dictionary words; unknown characters cost more than words."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        cost, start = best[end - 1][0] + 1.2, end - 1
        for size in range(1, min(end, longest) + 1):
            if best[end - size][0] + 1 < cost and run[end - size : end] in lexicon:
                cost, start = best[end - size][0] + 1, end - size
        best.append((cost, start))
    words: list[str] = []
    end = len(run)
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return tuple(reversed(words))


@lru_cache(maxsize=20_000)
def thai_words(run: str) -> tuple[str, ...]:
    return lattice_words(run, THAI_WORDS, 18)


@lru_cache(maxsize=20_000)
def cjk_last(run: str) -> str:
    """The last word of a run of Chinese or Japanese on its lattice."""
    return lattice_words(run, CJK_WORDS, 4)[-1]


def _thai_opens(text: str, at: int) -> str:
    """``open``, ``go`` or ``maybe`` for the Thai run that begins at ``at``."""
    run = _THAI_RUN.match(text, at)[0]
    words = thai_words(run)
    # a word of the list may also be the longest beginning of a longer compound
    if words[0] in THAI_OPENERS or any(run.startswith(w) for w in ("นางสาว", "นาย", "นาง")):
        return "open"
    return "go" if words[0] in THAI_CONTINUERS else "maybe"


def _thai_gap(text: str, start: int, end: int, low: int, high: int) -> bool:
    """Whether the white space ``text[start:end]`` beside Thai ends a sentence; the block is ``text[low:high]``."""
    left, right = text[start - 1], text[end]
    if script(left) == "thai":
        last = thai_words(_last_run(text, start, low))[-1]
        if last in THAI_NONFINAL:
            return False
        if script(right) == "thai":
            return _thai_opens(text, end) != "go"
        if script(right) in ("indic", "cjk", "arabic"):
            return True
        rest = re.split(f"[{_THAI}]", text[end : min(high, end + 160)], maxsplit=1)[0].split()
        plain = [w for w in rest if re.fullmatch(r"[\"“]?[A-Za-z][a-zA-Z'./]*[,.?!\"]*", w)]
        return len(plain) >= 3 or (len(plain) >= 2 and len(plain) == len(rest))
    return script(right) == "thai" and _thai_opens(text, end) == "open"


def _last_run(text: str, end: int, low: int) -> str:
    start = end
    while start > low and "ก" <= text[start - 1] <= "๛":
        start -= 1
    return text[start:end]


def _stop_ends(text: str, start: int, end: int, low: int, high: int) -> bool:
    """Whether the full stops ``text[start:end]`` (with something after them in the block) end a sentence."""
    nxt = text[end]
    at = end
    while at < high and text[at] in BLANK:
        at += 1
    if at >= high:
        return True
    ch = text[at]
    spaced = at > end
    token = _TOKEN.search(text, max(low, start - 40), start)[0]
    if "." in token:  # a mark without a space after it
        token = _INNER.sub("", token)
    size = end - start
    if ch in ",;:)]}，、；：":
        return False
    if ch.islower() and not _MIXED.match(text, at):
        # only a plain word or number before the mark makes a lower-case beginning a new sentence
        word = token.rsplit("-", 1)[-1]
        plain = word.isalpha() and len(word) > 2 and word.lower() not in PREFIXES and word.lower() not in CLOSERS
        return spaced and size == 1 and script(ch) == "latin" and (plain or token[-1:].isdigit())
    if size > 1:  # an ellipsis, or an abbreviation's dot and a full stop
        return spaced or ch.isupper() or script(ch) not in ("", "latin")
    if not spaced:
        if nxt.isdigit() or "@" in token or not token:
            return False
        around = text[end : end + 60].split(None, 1)[0]
        if "@" in around.split(".")[0] or not (ch.isupper() or _MIXED.match(text, at) or ch in '"“' or script(ch) not in ("", "latin")):
            return False
        if script(token[-1]) not in ("", "latin"):
            return len(token) > 2 and token not in ABBREVIATIONS and "." not in token
        word = re.split(r"[^A-Za-z]", token)[-1]
        return (len(word) > 1 and word.islower() or token[-1].isdigit() or len(word) > 3) and word.lower() not in PREFIXES
    if not token:
        return True
    if script(token[-1]) not in ("", "latin"):  # an Indic or other letter or vowel sign
        token = re.split("[।॥۔؟!?]", token)[-1]
        parts = [sum(c.isalpha() for c in x) for x in token.split(".")]
        return not (token in ABBREVIATIONS or token.rpartition(".")[2] in ABBREVIATIONS or parts == [1] or (len(parts) > 1 and max(parts) <= 2))
    if token[-1].isdigit():
        return True
    bare = token.lstrip("(\"'“[").lower()
    opener = _WORD.match(text, at + (ch in '"“'))
    opener = (opener[0].rstrip("'’") if opener else "") in OPENERS or ch in '"“' or script(ch) not in ("", "latin")
    if len(bare) == 1 and bare.isalpha():  # an initial
        return opener and bare != "s"
    if acronym := _ACRONYM.search(token):
        flat = acronym[0].lower().replace(".", "")
        if flat in PREFIXES:
            return False
        return opener or flat in ("am", "pm")
    last = re.split(r"[^a-z/]", bare)[-1]
    if bare in PREFIXES or last in PREFIXES:
        return False
    if last in CLOSERS and ch.isdigit():
        return False
    return True


def _quote_ends(text: str, opened: int, end: int, high: int) -> bool:
    """Whether a quotation that closed at ``end`` after an end mark also ends its sentence."""
    at = end
    while at < high and text[at] in BLANK:
        at += 1
    if at >= high:
        return True
    ch = text[at]
    kind = script(ch)
    if ch.isdigit():
        return True
    if kind == "latin":
        return ch.isupper() or bool(_MIXED.match(text, at))
    if not kind:
        return ch in '"“「'
    before = next((script(c) for c in text[opened + 1 : end] if script(c)), kind)
    return before != kind or text.startswith(SCRIPT_OPENERS, at)


def _block(text: str, low: int, high: int, forced: set[int]) -> Iterator[int]:
    """Ends of sentences inside the running block ``text[low:high]``; ``forced`` holds line breaks that end one."""
    quote = -1  # where the open quotation began
    ends: list[int] = []
    unclosed: set[str] = set()  # closing marks that do not come again
    line_ends = sorted(forced)
    for m in _MARKS.finditer(text, low, high):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "line":
            if start in forced:
                ends.append(start)
                quote = -1
        elif kind == "quote":
            ch = text[start]
            if quote >= 0 and ch in "\"”」』":
                if text[start - 1] in ".!?。！？।॥؟۔…" and _quote_ends(text, quote, end, high):
                    ends.append(end)
                quote = -1
            elif quote < 0 and ch in "\"“「『":
                mark = {"“": "”", "「": "」", "『": "』"}.get(ch, '"')
                stop = bisect_left(line_ends, start)
                # a line break that ends a sentence closes every quotation, so none is looked for beyond it
                close = -1 if mark in unclosed else text.find(mark, end, line_ends[stop] if stop < len(line_ends) else high)
                if close >= 0:
                    quote = start
                elif stop == len(line_ends):
                    unclosed.add(mark)
        elif quote >= 0 or end >= high:
            continue
        elif _STRONG.search(m[0]):
            ch = text[end]
            if ch in ",，、" or (m[0][-1] in "!?" and (ch.isalnum() and not ch.isupper() and script(ch) in ("", "latin") or ch in "=&/")):
                continue
            ends.append(end)
        elif _stop_ends(text, start, end, low, high):
            ends.append(end)
    if _THAI_RUN.search(text, low, high):
        quoted = [(m.start(), m.end()) for m in re.finditer(r"[\"“][^\"”\n]*[\"”]", text[low:high])]
        for m in _THAI_GAP.finditer(text, low, high):
            if any(low + a < m.start() < low + b for a, b in quoted) or m.start() == low or m.end() >= high:
                continue
            if _thai_gap(text, m.start(), m.end(), low, high):
                ends.append(m.start())
        ends.sort()
    yield from ends


def _joins(text: str, a: tuple[int, int], b: tuple[int, int], width: int) -> bool:
    """Whether the first word of line ``b`` would not have fitted on line ``a`` at this width."""
    if script(text[a[1] - 1]) == "cjk" and script(text[b[0]]) == "cjk":
        return a[1] - a[0] + 1 > width
    word = b[0]
    while word < b[1] and text[word] not in BLANK:
        word += 1
    return a[1] - a[0] + 1 + word - b[0] > width


def _reads_on(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether line ``b`` reads on from line ``a``, by their words alone."""
    last = text[a[0] : a[1]].split()[-1]
    first = text[b[0] : b[1]].split()[0]
    left, right = script(text[a[1] - 1]), script(text[b[0]])
    if text[b[0]].islower() or last[-1] in ",;，、:(" or last.lower() in OPEN_ENDS:
        return True
    codes = last.isupper() or first.isupper()
    if left and right and left != right and not codes:
        return False
    if right == "cjk":
        if text.startswith(SCRIPT_OPENERS, b[0]):
            return False
        word = cjk_last(last[-40:])  # whole words of at most four characters decide, so the end of the run is enough
        return word not in CJK_FINALS
    if left in ("indic", "arabic") or "ऀ" <= last[-1] <= "෿":
        if first.rstrip("।.۔!?") in HELPERS:
            return True
        return not (last in FINAL_WORDS or last.endswith(FINAL_ENDINGS))
    if right == "latin":
        return first.rstrip(",.'") not in OPENERS
    return True


def _starts_anew(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether line ``a`` ends in a final word and line ``b`` begins with an opener: a sentence without a mark between."""
    last = text[a[0] : a[1]].split()[-1]
    first = text[b[0] : b[1]].split()[0].rstrip(",")
    if last in COPULAS:
        return first[0].isupper() if first[0].isascii() and first[0].isalpha() else first not in CONJUNCTIONS and first.rstrip("।.۔!?") not in HELPERS
    if last in FINAL_WORDS:
        return text.startswith(SCRIPT_OPENERS, b[0])
    return last in ROMAN_FINALS and first in OPENERS


def structural(text: str, start: int, end: int) -> bool:
    """Whether a line that is one unit is a heading, a ``Label: value`` line or a list item."""
    label = _LABEL.match(text, start, end)
    if _ITEM.match(text, start, end) or (label and len(label[0].split()) <= 4):
        return True
    line = text[start:end]
    words = line.split()
    if _ENDED.search(line) or len(line) >= 60 or len(words) > 5 or _INK.search(text).start() < start:
        return line.isupper() and line.isascii() and len(words) <= 5
    if "a" <= line[-1].lower() <= "z":
        return all(w[0].isupper() for w in words)
    return any(c.isalpha() for c in line) and not (words[-1] in FINAL_WORDS or line.endswith(FINAL_ENDINGS) or len(line) > 30)


def split(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence unit of ``text``."""
    units: list[tuple[int, int]] = []
    lines: list[tuple[int, int, str]] = []  # start, end, kind
    at = 0
    before = "blank"
    for raw in text.split("\n"):
        start = at + len(raw) - len(raw.lstrip(BLANK))
        end = at + len(raw.rstrip(BLANK))
        at += len(raw) + 1
        if start >= end:
            kind = "blank"
        elif _ITEM.match(text, start, end) and (before != "text" or (_BULLET.match(text, start, end) and _ENDED.search(text, lines[-1][0], lines[-1][1]))):
            kind = "unit"
        elif before == "text" and text[end - 1] in ":：" and _LIST_HEAD.match(text, start):
            kind = "unit"
        elif before != "text" and (m := _LABEL.match(text, start, end)) and len(m[0].split()) <= 4:
            kind = "unit"
        else:
            kind = "text"
        lines.append((start, end, kind))
        before = kind
    # a line without an end mark right before labels is a heading
    for i in range(len(lines) - 1):
        if lines[i][2] == "text" and (i == 0 or lines[i - 1][2] != "text") and lines[i + 1][2] == "text":
            start, end, _ = lines[i]
            label = _LABEL.match(text, lines[i + 1][0], lines[i + 1][1])
            if label and len(label[0].split()) <= 4 and end - start < 60 and not _ENDED.search(text, start, end):
                j = i
                lines[j] = (start, end, "unit")
                while j + 1 < len(lines) and lines[j + 1][2] == "text" and (m := _LABEL.match(text, lines[j + 1][0], lines[j + 1][1])) and len(m[0].split()) <= 4:
                    j += 1
                    lines[j] = (*lines[j][:2], "unit")
    breaks = [(a, b) for a, b in zip(lines, lines[1:], strict=False) if a[2] == b[2] == "text"]
    open_breaks = [(a, b) for a, b in breaks if not _ENDED.search(text, a[0], a[1])]
    width = max((max(a[1] - a[0], b[1] - b[0]) for a, b in breaks), default=0)
    wraps = {a[1]: _joins(text, a, b, width) for a, b in open_breaks}
    passed = sum(wraps.values())
    sure = len(open_breaks) >= 3 or len(breaks) >= 6
    wrapped = 20 <= width <= 120 and passed >= 0.6 * len(open_breaks)

    i = 0
    while i < len(lines):
        start, end, kind = lines[i]
        if kind == "blank":
            i += 1
            continue
        if kind == "unit":
            units.append((start, end))
            i += 1
            continue
        forced: set[int] = set()
        while i + 1 < len(lines) and lines[i + 1][2] == "text":
            a, b = lines[i], lines[i + 1]
            if not _ENDED.search(text, a[0], a[1]):
                if script(text[a[1] - 1]) == "thai" or script(text[b[0]]) == "thai":
                    joins = False if script(text[a[1] - 1]) == "thai" and script(text[b[0]]) == "thai" and not wrapped else None
                elif not wraps[a[1]] or (sure and not wrapped):
                    joins = False
                elif sure:
                    joins = not _starts_anew(text, a, b)
                else:
                    joins = 20 <= width <= 120 and _reads_on(text, a, b)
                if joins is False:
                    forced.add(text.index("\n", a[1]))
            i += 1
        stop = lines[i][1]
        cursor = start
        for cut in _block(text, start, stop, forced):
            piece = cursor
            while piece < cut and text[piece] in BLANK:
                piece += 1
            last = cut
            while last > piece and text[last - 1] in BLANK:
                last -= 1
            if last > piece:
                units.append((piece, last))
            cursor = max(cursor, cut)
        while cursor < stop and text[cursor] in BLANK:
            cursor += 1
        if cursor < stop:
            units.append((cursor, stop))
        i += 1
    return units


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, start_off, end_off)`` of every sentence unit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for a, b in split(value) if value else ():
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=[key, "start_off", "end_off"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start_off long, end_off long")
