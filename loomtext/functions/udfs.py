"""Arrow functions for what column expressions cannot say: scans with state, edit alignments, beam search."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types as objects: a type as text could be read only with a session at hand.
STRINGS = T.ArrayType(T.StringType())
EDITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "a", "b")]))
VARIANTS = T.ArrayType(T.StructType([T.StructField("variant", T.StringType()), T.StructField("edits", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
# Opening and closing marks.
QUOTES_OPEN = frozenset("\"'“«‹„‘‚「『（([{")
QUOTES_CLOSE = frozenset("\"'”»›‟’‛」』）)]}")
# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof etc e.g i.e a.m s.a b.c m.a ph.d u.s".split())
# What is typed for letters of the alphabet on a foreign keyboard.
TYPED = {"ch": "ç", "sh": "ş", "gh": "ğ", "c": "ç", "s": "ş", "e": "ə", "o": "ö", "u": "ü", "g": "ğ", "i": "ı", "w": "v"}


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def abbreviated(word: str) -> bool:
    return word.strip().strip("".join(QUOTES_OPEN | QUOTES_CLOSE)).rstrip(".,!?;:").lower() in ABBREVIATIONS


def initials(word: str) -> bool:
    """Two capitals parted by a point, the first beginning a word."""
    return any(word[i] == "." and "A" <= word[i - 1] <= "Z" and (i == 1 or not (word[i - 2].isalnum() or word[i - 2] == "_")) and word[i + 1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZƏÖÜİĞÇŞ" for i in range(1, len(word) - 1))


def closes(text: str, start: int, i: int) -> bool:
    """Whether the sign at ``i`` ends the sentence that began at ``start``."""
    c, n = text[i], len(text)
    before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < n else ""
    if c == ".":
        if before.isdigit() and after.isdigit() or before not in ("", " ") and after not in ("", " ") or before.isupper():
            return False
    word = text[start : i + 1].rsplit(None, 1)[-1]
    if abbreviated(word) or c == "." and initials(word):
        return False
    following = text[i + 1 :].lstrip()[:1]
    return not following.islower() and after not in QUOTES_CLOSE if after else True


def segmented(text: str) -> list[str]:
    out, start = [], 0
    for i, c in enumerate(text):
        quoted = c in QUOTES_CLOSE and text[i + 1 : i + 2] == " " and text[i + 2 : i + 3].isupper()
        if quoted or c in ".!?" and closes(text, start, i):
            out.append(text[start : i + 1].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if s]


@F.pandas_udf(STRINGS)
def segments(texts: pd.Series) -> pd.Series:
    """Sentences of a text that ``functions.text.sentence_text`` has prepared."""
    return texts.map(lambda t: None if t is None else segmented(t))


# Marks that belong to the sentence before them.
TRAILING = "\"'”»›)]}’"
SPLIT_AT = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("boundary", T.IntegerType())]))


def sentences_at(text: str, ends: set[int]) -> list[dict]:
    """Sentences that end at the given stops or at ``!`` and ``?``, closing marks included; the rest has no boundary."""
    out, start, i = [], 0, 0
    for m in re.finditer(r"[.!?]", text):
        i = m.start()
        if i < start or m.group() == "." and i not in ends:
            continue
        stop = i + 1
        while stop < len(text) and text[stop] in TRAILING:
            stop += 1
        if sentence := text[start:stop].strip():
            out.append({"sentence": sentence, "boundary": i})
        start = stop
    if tail := text[start:].strip():
        out.append({"sentence": tail, "boundary": None})
    return out


@F.pandas_udf(SPLIT_AT)
def split_at(texts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sentences_at(t, set(e)) for t, e in zip(texts, ends, strict=True)])


def weighted_distance(a: str, b: str, costs: dict, most: float) -> float:
    """Edit distance with costs by operation; borders cost 1 a sign, and the longer word goes first."""
    if len(b) > len(a):
        a, b = b, a
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        up, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            keep = up + (0.0 if x == y else costs.get(("sub", x, y), 1.0))
            up = row[j]
            row[j] = min(keep, row[j] + costs.get(("del", x, ""), 1.0), row[j - 1] + costs.get(("ins", "", y), 1.0))
        if min(row) > most:
            return most + 1.0
    return row[-1] if row[-1] <= most else most + 1.0


def weighted_levenshtein(costs: dict, most: float):
    """A function of two string columns; ``costs`` maps (op, a, b) to a cost and is small (one entry a pair of letters)."""

    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else weighted_distance(x, y, costs, most) for x, y in zip(a, b, strict=True)], dtype="float64")

    return distance


def aligned(source: str, target: str) -> list[dict]:
    """The edits from source to target; among equal paths, read from the end, a deletion goes before an insertion before the rest."""
    m, n = len(source), len(target)
    d = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (source[i - 1] != target[j - 1]))
    out, i, j = [], m, n
    while i or j:
        if i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append({"op": "del", "a": source[i], "b": ""})
        elif j and d[i][j] == d[i][j - 1] + 1:
            j -= 1
            out.append({"op": "ins", "a": "", "b": target[j]})
        else:
            i, j = i - 1, j - 1
            out.append({"op": "match" if source[i] == target[j] else "sub", "a": source[i], "b": target[j]})
    return out[::-1]


@F.pandas_udf(EDITS)
def alignment(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else aligned(a, b) for a, b in zip(source, target, strict=True)])


def typed_variants(word: str, most_edits: int, width: int) -> list[dict]:
    """What may have been meant: a beam over units (digraphs first), cut after each by edits and spelling."""
    beam, i = [(0, "")], 0
    while i < len(word):
        unit = word[i : i + 2] if word[i : i + 2] in TYPED and len(word) - i > 1 else word[i]
        i += len(unit)
        options = [(0, unit)] + ([(1, TYPED[unit])] if unit in TYPED else [])
        beam = sorted((e + x, p + u) for e, p in beam for x, u in options if e + x <= most_edits)[:width]
    best: dict[str, int] = {}
    for e, p in beam:
        best.setdefault(p, e)
    return [{"variant": p, "edits": e} for p, e in sorted(best.items(), key=lambda x: (x[1], x[0]))]


def variants(most_edits: int = 2, width: int = 40):
    @F.pandas_udf(VARIANTS)
    def of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else typed_variants(w, most_edits, width))

    return of


def word_spans(text: str) -> list[dict]:
    """Words and single signs with their places; replacement signs and tokens of control signs or marks alone are left out."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = i
        while j < n and (text[j].isalnum() or text[j] == "_"):
            j += 1
        j = max(j, i + 1)
        token = text[i:j]
        if not token.isspace() and token != "�" and not all(unicodedata.category(c)[0] in "CM" for c in token):
            out.append({"word": token, "start": i, "end": j})
        i = j
    return out


@F.pandas_udf(SPANS)
def words_with_places(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else word_spans(t))


def merge_encoder(merges: list[tuple[str, str]]):
    """Splits words into subwords by ordered merges; the list is as long as the merges that were asked for."""
    rank = {pair: i for i, pair in enumerate(merges)}

    @F.pandas_udf(STRINGS)
    def encode(words: pd.Series) -> pd.Series:
        def one(word):
            parts = [*word, "</w>"]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
                pair = (parts[best], parts[best + 1])
                if pair not in rank:
                    break
                k, out = 0, []
                while k < len(parts):
                    hit = k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair
                    out.append(parts[k] + parts[k + 1] if hit else parts[k])
                    k += 2 if hit else 1
                parts = out
            return parts

        return words.map(lambda w: None if w is None else one(w))

    return encode
