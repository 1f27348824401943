"""Problem 1: sentence boundaries across languages and scripts.

The standard character-property rules of sentence breaking: a terminator (``STerm`` of any script, or ``ATerm``, the full stop
that also abbreviates), closing marks, blanks; ``ATerm`` does not end a sentence before a lower-case letter or inside a
number. Added to them: abbreviations of the text's language do not end one (some only before a number), initials and ordinals
neither; the language is that of the script, for Latin letters that of most common words; where nothing decides, all hold; what stands inside a quotation or bracket belongs to the sentence around it; a sentence may begin without a
blank; Thai ends sentences with a blank between letters; a line break always ends a unit, and a list marker is no sentence.

Positions count code points of the text as stored. Signs that nobody sees (zero-width, soft hyphen) are left out before the
rules and counted in afterwards. White space around a sentence belongs to none.

Defined cases: null, empty and blank texts have no sentence; every character that is not white space (or unseen, at an edge)
lies in exactly one sentence; a text of any length takes time in proportion.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations by language that stand before what they belong to; a full stop behind one ends no sentence.
BEFORE = {
    "az": "akad prof dos dok dr müh av bax səh şək cəd ing rus alm fr ər ərəb türk lat yun v kv m.ö m.s b.e.ə e.ə",
    "tr": "prof doç dok dr yrd müh av bkz yy örn sf hz ing alm fr lat yun m.ö m.s",
    "de": "dr prof ca abb abs bd bzw evtl ggf hrsg hl inkl nr str tel st z zb u v p d.h u.a z.b i.d.r lat engl",
    "en": "dr prof mr mrs ms st sr jr fig figs vol no nr pp p ch sec eq approx ca vs cf gen col capt lt sgt rev hon gov sen rep pres e.g i.e a.k.a",
    "ru": "акад проф доц кв рис стр см им ул пр т.е т.н т напр ср гл изд ред св д-р инж ген кн тыс млн млрд руб",
    "ar": "د أ م ص ج ق.م ه",
    "hi": "डॉ प्रो श्री सं पृ",
}
#: Of them, those that are words of their own too; they introduce a number or are none.
NUMBERED = {"en": "no nr fig figs sec ch eq p pp vol", "de": "nr bd abs str p", "az": "v kv", "tr": "yy"}
#: Titles that are written alike in all languages of Latin letters.
TITLES = "dr prof mr mrs"
#: Words behind the full stop of an ordinal number.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jahrhundert jh ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık yüzyıl".split()
)
#: Letters that look like Latin ones, for reading abbreviations.
LOOK = str.maketrans("асеорхуіѕјһәǝοΑΒΕΖΗΙΚΜΝΟΡΤΥΧАСЕОРХВНКМТІЅЈ", "aceopxyisjhəəoABEZHIKMNOPTYXACEOPXBHKMTISJ")

UNSEEN = regex.compile(r"[­​-‏‪-‮⁠-⁤﻿]+")
LINES = regex.compile(r"[^\n\r\x0B\x0C\x85  ]+")
SPACES = r"\s   "
OPEN, CLOSE = "“„«‹‘‚([{（［「『《〈【〔", "”»›’)]}）］」』》〉】〕"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’", "(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "〔": "〕"}
MARKS = regex.compile(rf"[{regex.escape(OPEN + CLOSE)}\"]")
#: A run of terminators with the closing marks behind it.
STOP = regex.compile(rf"(?P<stops>[\p{{Sentence_Break=ATerm}}\p{{Sentence_Break=STerm}}…]+)(?P<closers>[{regex.escape(CLOSE)}\"”“»'\p{{Pf}}\p{{Pe}}]*)(?P<blank>[{SPACES}]*)")
WORD_BEFORE = regex.compile(r"(?r)[^\s\"“”„«»()\[\]{}<>/,;:!?…]*")  # read backwards from the stop
WORD = 64  # code points; a longer word is no abbreviation
NEXT = regex.compile(rf"[{SPACES}\p{{Pi}}\p{{Ps}}\p{{Pd}}\"'“„«¿¡\p{{So}}\p{{Sk}}️*#•]*")
MARKER = regex.compile(rf"[{SPACES}]*(?:[-–—•*·‣▪●○◦]|#+|\(?\d{{1,4}}[.)]|\(?\p{{L}}\))[{SPACES}]+")
THAI_BLANK = regex.compile(rf"(?<=[\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}ฯๆ])[{SPACES}]+(?=[\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}])")
THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
INITIAL = regex.compile(r"(?:\p{Lu}\p{M}*\.)*\p{Lu}\p{M}*")
ORDINAL = regex.compile(r"\d{1,2}")
FIRST_WORD = regex.compile(r"[\p{L}\p{M}]+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def inside(line: str) -> list[tuple[int, int]]:
    """The outermost matched quotations and brackets of a line, as (opening, closing) places; what has no partner is none."""
    found, stack = [], []
    waiting: Counter = Counter()  # of the stack, by the marks that would close them
    straight = -1
    for m in MARKS.finditer(line):
        c, i = m.group(), m.start()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                found.append((straight, i))
                straight = -1
            continue
        if waiting[c]:
            while True:  # what stands open inside has no partner
                opened, place = stack.pop()
                waiting.subtract(PAIRS[opened])
                if c in PAIRS[opened]:
                    break
            found.append((place, i))
        elif c in PAIRS:
            stack.append((c, i))
            waiting.update(PAIRS[c])
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], b)
    return outer


def abbreviation(word: str) -> str:
    """The word before a full stop in the form of the lists."""
    return unicodedata.normalize("NFKC", word).translate(LOOK).lower().replace("i̇", "i")


def folded(words: str) -> frozenset:
    return frozenset(abbreviation(w) for w in words.split())


LATIN = ("az", "tr", "de", "en")
ALWAYS = {k: folded(v + (f" {TITLES}" if k in LATIN else "")) - folded(NUMBERED.get(k, "")) for k, v in BEFORE.items()}
ALWAYS["und"] = frozenset().union(*ALWAYS.values())
INTRODUCE = {k: folded(v) for k, v in NUMBERED.items()}
INTRODUCE["und"] = frozenset().union(*INTRODUCE.values())
#: Blocks of 256 code points to scripts.
BLOCKS = np.zeros(0x1100, np.int64)
SCRIPTS = ("", "la", "ru", "ar", "hi", "th", "zh", "ja")
for first, last, script in ((0x00, 0x02, 1), (0x1E, 0x1E, 1), (0x04, 0x05, 2), (0x06, 0x06, 3), (0x09, 0x09, 4), (0x0E, 0x0E, 5), (0x4E, 0x9F, 6), (0x30, 0x30, 7)):
    BLOCKS[first : last + 1] = script


def language(text: str, common: dict[str, tuple[str, ...]]) -> str:
    """The language whose abbreviations hold: by the script of most letters, for Latin letters by common words; else ``und``."""
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = codes[(codes > 0x7F) | ((codes | 0x20) - 0x61 < 26)]
        counts = np.bincount(BLOCKS[np.minimum(letters >> 8, 0x10FF)], minlength=len(SCRIPTS))
        counts[0] = 0
        script = SCRIPTS[int(counts.argmax())] if counts.any() else ""
        if script != "la":
            return script or "und"
    hits: Counter = Counter()
    for word in text.lower().split():
        if word in common:
            hits.update(common[word])
    best = sorted((-n, k) for k, n in hits.items() if k in LATIN)
    if not best or len(best) > 1 and best[0][0] == best[1][0]:
        return "az" if "ə" in text else "und"
    return best[0][1]


def ends_here(line: str, start: int, m: regex.Match, lang: str) -> bool:
    """Whether the terminators of ``m`` end the sentence that began at ``start``, in a text of that language."""
    stops, closers, blank, after = m["stops"], m["closers"], m["blank"], m.end()
    if after >= len(line):
        return True
    skip = NEXT.match(line, after).end()
    first = line[skip] if skip < len(line) else ""
    if not first:
        return True
    if line[after] in ",;:，、；：)]}»”’%" or first in ",;:，、；：)]}":
        return False
    if first.islower():
        return False
    if closers and line.startswith(("と", "って", "という"), after):
        return False
    last = stops[-1]
    if last in "…․" or len(stops) > 1 and set(stops) <= {"."}:
        return bool(blank) if not CJK.match(first) else False
    if set(stops) - {".", "…", "․"}:
        return True
    # one full stop
    i = m.start()
    word = WORD_BEFORE.match(line, max(start, i - WORD - 1), i).group()
    if len(word) > WORD:
        word = "—" * WORD
    plain = abbreviation(word)
    if not blank and not closers:
        if first.isdigit() or line[after] != first or not word:
            return False
        if len(word) == 1 and word.isupper() or INITIAL.fullmatch(word):
            return False
    script = SCRIPTS[BLOCKS[min(ord(word[-1]) >> 8, 0x10FF)]] if word else ""
    tail = plain.rpartition(".")[2] if "." in plain else ""
    # a word of another script than the text's may also be one of that script's language
    for spoken in {lang, script if script != "la" else lang if lang in LATIN else "und"}:
        always = ALWAYS.get(spoken, ())
        if plain in always or len(tail) > 1 and tail in always or first.isdigit() and plain in INTRODUCE.get(spoken, ()):
            return False
    if INITIAL.fullmatch(word):
        return False
    if ORDINAL.fullmatch(word):
        following = FIRST_WORD.match(line, skip)
        if following and following.group().lower() in MONTHS:
            return False
    return True


def line_sentences(line: str, lang: str = "und") -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of one line without unseen signs; white space is still around them."""
    marker = MARKER.match(line)
    start = at = 0
    first = marker.end() if marker else 0
    out, spans, k = [], inside(line), 0
    cuts = []
    for m in STOP.finditer(line, first):
        if m.start() < at:
            continue
        i, close = m.start(), m.end() - len(m["blank"])
        while k < len(spans) and spans[k][1] < i:
            k += 1
        if k < len(spans) and spans[k][0] < i and spans[k][1] >= close:
            continue  # a quotation or bracket goes on behind it
        if ends_here(line, start, m, lang):
            cuts.append(close)
            start = at = close
    if not marker and THAI.search(line):
        for m in THAI_BLANK.finditer(line):
            at = bisect_left(spans, (m.start(),)) - 1
            if at < 0 or spans[at][1] < m.start():
                cuts.append(m.start())
        cuts.sort()
    start = 0
    for cut in [*cuts, len(line)]:
        if cut > start:
            out.append((start, cut))
        start = cut
    return out


def sentences(text: str | None, common: dict[str, tuple[str, ...]] | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence of a text; ``common`` gives the languages of common words."""
    out = []
    lang = language(text or "", common or {})
    for m in LINES.finditer(text or ""):
        line, base = m.group(), m.start()
        if line.isspace():
            continue
        unseen = [u.span() for u in UNSEEN.finditer(line)]
        if unseen:
            keep = np.ones(len(line), bool)
            for a, b in unseen:
                keep[a:b] = False
            place = np.flatnonzero(keep)
            line = UNSEEN.sub("", line)
        for a, b in line_sentences(line, lang):
            part = line[a:b]
            a += len(part) - len(part.lstrip())
            b -= len(part) - len(part.rstrip())
            if a < b:
                out.append((base + int(place[a]), base + int(place[b - 1]) + 1) if unseen else (base + a, base + b))
    return out


def split(df: DataFrame, key: list[str], text: str, common_words: dict[str, list[str]] | None = None) -> DataFrame:
    """``(*key, start_char, end_char)``, one row a sentence; narrow, in Arrow batches. ``common_words``: function words by language."""
    common: dict[str, tuple[str, ...]] = {}
    for lang, words in (common_words or {}).items():
        for word in words:
            common[word] = (*common.get(word, ()), lang)
    source = df.select(*key, F.col(text).alias("__text"))
    schema = T.StructType([*(source.schema[k] for k in key), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [sentences(t, common) for t in batch.column(len(key)).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            spans = np.array([s for x in found for s in x], np.int64).reshape(-1, 2)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(key))), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=schema.names)

    return source.mapInArrow(run, schema)
