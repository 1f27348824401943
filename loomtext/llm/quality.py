"""Problem 7: how far a page is from the running prose of its language.

Statistics of words, signs, lines and common words are taken of every page. For each language the mean and covariance of its
prose are estimated robustly: medians and quartiles first, then steps in which only the pages near the current centre count,
until none comes or goes, so that tables and lists, while they are the minority, do not draw it. A page's squared Mahalanobis
distance to its language is the sum of its statistics' contributions, which are reported; a page counts as no prose if it is
farther than prose ever is. Statistics of prose have heavier tails than a normal distribution, so that limit is a quantile
(``BEYOND``) of the distances under a multivariate t distribution with ``TAIL`` degrees of freedom.

A language of few pages is drawn to the estimate over all languages (``DRAW`` pages' weight). Pages in no known language,
whose common words are unknown, are held against the nearest language by the other statistics. ``RIDGE`` only keeps the
covariance of a statistic that does not vary invertible.

Defined cases: null and blank texts have no statistics and give no row; a text without words, lines or letters has 0 for the
shares concerned; if no page is in a known language they are one language; if all pages of a language are alike whatever
differs is far; copies of a record are one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.lookalikes import forms
from loomtext.session import cut_lineage

#: The statistics that the distance is made of.
NAMES = (
    "closed",  # share of characters in lines that end in punctuation that closes a sentence
    "short",  # share of characters in lines of fewer than SHORT
    "line_length",  # logarithm of the length of the line that the average character stands in
    "letters",  # share of letters among visible characters
    "digits",  # share of digits among visible characters
    "symbols",  # share of signs that are neither letters, digits, marks nor sentence punctuation
    "word_length",  # mean length of words; of scripts without blanks, of the runs between signs, as a logarithm
    "common",  # share of words that are common words of the language
    "distinct",  # share of distinct words among a window's words, averaged
    "marked",  # share of characters in lines that begin with a list marker or hold cell separators
)
#: Further ones, reported beside them: words, lines, share of lines that end in closing punctuation.
REPORTED = ("words", "lines", "closed_lines")
SIZE = len(NAMES)
SHORT = 30
RIDGE = 1e-5
DRAW = 10.0
STEPS = 20
TAIL = 5.0
BEYOND = 3e-5

TERMINAL = regex.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}…]")
CLOSING = regex.compile(r"[\p{Pf}\p{Pe}\"'”’»“]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-.,][\p{L}\p{M}\p{N}]+)*")
UNSEEN = regex.compile(r"[­​-‏⁠﻿]+")
MARKED = regex.compile(r"\s*(?:[-–—•*·‣▪#|]|\{\||\(?\d{1,4}[.)]\s|\(?\p{L}\)\s)")
CELLS = re.compile(r"\S\s{3,}\S|;[^\s]*;")
PLAIN_SIGNS = frozenset(".,!?…:;()\"'“”„«»‘’-–—।。！？，、：；「」『』（）؟،؛")
SCRIPTS = {"ru": r"\p{Cyrillic}", "zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}]", "th": r"\p{Thai}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}", "la": r"\p{Latin}"}
UNSPACED = ("zh", "ja", "th")
WINDOW = 50


class Kinds(dict):
    """Of a character: 0 letter or mark, 1 digit, 2 symbol, 3 plain sign; and its script, remembered."""

    patterns = {k: regex.compile(v) for k, v in SCRIPTS.items()}

    def __missing__(self, c: str) -> tuple[int, str]:
        kind = 0 if c.isalpha() or regex.match(r"\p{M}", c) else 1 if c.isdigit() else 3 if c in PLAIN_SIGNS else 2
        found = self[c] = (kind, next((k for k, p in self.patterns.items() if p.match(c)), ""))
        return found


class Edges(dict):
    """Of a character: 2 closes a sentence, 1 may stand behind what does, 0 neither; remembered."""

    def __missing__(self, c: str) -> int:
        found = self[c] = 2 if TERMINAL.match(c) else 1 if CLOSING.match(c) or c.isspace() else 0
        return found


KINDS, EDGES = Kinds(), Edges()


def is_closed(line: str) -> bool:
    for c in reversed(line):
        if edge := EDGES[c]:
            if edge == 2:
                return True
        else:
            return False
    return False


def is_marked(line: str) -> bool:
    """Whether a line begins with a list marker or holds cell separators."""
    return "|" in line or "\t" in line or "¦" in line or MARKED.match(line) is not None or CELLS.search(line) is not None


def language(scripts: Counter, words: list[str], common: dict[str, frozenset]) -> str:
    """By script where that decides, else by common words; ``und`` where nothing speaks or two languages speak alike."""
    n = {k: scripts.get(k, 0) for k in SCRIPTS}
    n["ja"] = n["ja"] * 3 if n["ja"] * 5 > n["zh"] else 0  # kana among ideographs
    top = max(n, key=n.get)
    if not n[top]:
        return "und"
    if top != "la":
        return top
    counts = Counter(words)
    hits = {k: sum(counts[w] for w in v) for k, v in common.items() if k not in SCRIPTS}
    best = max(hits, key=hits.get) if hits else "und"
    if not hits or hits[best] * 50 < len(words) or sum(h == hits[best] for h in hits.values()) > 1:
        return "und"
    return best


def statistics(text: str, common: dict[str, frozenset]) -> tuple[str, list[float]]:
    """The language, the statistics of ``NAMES`` and those of ``REPORTED``."""
    text = UNSEEN.sub("", text)
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    sizes = [len(x) for x in lines]
    visible = sum(sizes) or 1
    found = WORD.findall(forms([text.replace("\n", " ")])[0].lower())
    total, kinds, scripts = 0, [0, 0, 0, 0], Counter()
    for c, k in Counter(text).items():
        if not c.isspace():
            kind, script = KINDS[c]
            total += k
            kinds[kind] += k
            scripts[script] += k
    total = total or 1
    lang = language(scripts, found, common)
    known = common.get(lang, frozenset())
    if lang in UNSPACED:
        share = sum(len(w) * text.count(w) for w in known) / total
        units = [text[i : i + 3] for i in range(0, len(text), 3)]
    else:
        share = sum(w in known for w in found) / (len(found) or 1)
        units = found
    windows = [units[i : i + WINDOW] for i in range(0, len(units), WINDOW)]
    closed = [is_closed(x) for x in lines]
    mean_word = sum(map(len, found)) / (len(found) or 1)
    return lang, [
        sum(n for n, c in zip(sizes, closed, strict=True) if c) / visible,
        sum(n for n in sizes if n < SHORT) / visible,
        math.log(sum(n * n for n in sizes) / visible) if lines else 0.0,
        kinds[0] / total,
        kinds[1] / total,
        kinds[2] / total,
        math.log1p(mean_word) if lang in UNSPACED else min(mean_word, 30.0),
        share,
        sum(len(set(w)) for w in windows) / len(units) if units else 0.0,
        sum(n for n, x in zip(sizes, lines, strict=True) if is_marked(x)) / visible,
        float(len(units)),
        float(len(lines)),
        sum(closed) / (len(lines) or 1),
    ]


def page_statistics(df: DataFrame, key: str, text: str, common_words: dict[str, list[str]]) -> DataFrame:
    """``(key, lang, stats, reported)`` of the pages with text; ``common_words`` is a fixed list of function words by language."""
    common = {k: frozenset(x for w in v for x in (w.lower(), forms([w])[0].lower())) for k, v in common_words.items()}

    def run(batches):
        for batch in batches:
            keys, langs, stats = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and not t.isspace():
                    lang, s = statistics(t, common)
                    keys.append(i)
                    langs.append(lang)
                    stats.append(s)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(langs, pa.string()), pa.array([x[:SIZE] for x in stats], kind), pa.array([x[SIZE:] for x in stats], kind)], names=["key", "lang", "stats", "reported"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, lang string, stats array<double>, reported array<double>")


# ---- estimation
def tail_quantile(size: int, beyond: float = BEYOND, tail: float = TAIL) -> float:
    """The squared distance that a share ``beyond`` of a multivariate t distribution lies over: a quantile of size * F(size, tail)."""
    x = np.exp(np.linspace(-12, 25, 400_001))
    density = np.exp(size / 2 * np.log(x) - (size + tail) / 2 * np.log1p(size * x / tail))  # of log x, up to a factor
    mass = np.cumsum(density)
    return float(size * x[np.searchsorted(mass, (1 - beyond) * mass[-1])] * (tail - 2) / tail)


Model = dict[str, tuple[np.ndarray, np.ndarray]]


def moments(df: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Number, mean and covariance by language; one row of sums a language comes to the driver."""
    x = [F.col("stats")[i] for i in range(SIZE)]
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    rows = df.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(SIZE)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    found = {}
    for r in rows:
        n, mean, second = float(r["n"]), np.array([r[f"s{i}"] for i in range(SIZE)]) / r["n"], np.zeros((SIZE, SIZE))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n
        found[r["lang"]] = (n, mean, second - np.outer(mean, mean))
    return found


def drawn(found: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """Centre and covariance by language, those of few pages drawn to all."""
    weights = np.array([n for n, *_ in found.values()])
    means, inner = np.array([m for _, m, _ in found.values()]), np.array([c for *_, c in found.values()])
    share = weights / weights.sum()
    centre = share @ means
    over_all = np.einsum("k,kij->ij", share, inner) + (means - centre).T @ ((means - centre) * share[:, None])
    model = {}
    for lang, (n, mean, cov) in found.items():
        w = n / (n + DRAW)
        model[lang] = (w * mean + (1 - w) * centre, w * cov + (1 - w) * over_all + RIDGE * np.eye(SIZE))
    return model


def models(df: DataFrame) -> Model:
    """Centre and covariance of each language's prose."""
    known = df.filter("lang <> 'und'") if df.filter("lang <> 'und'").limit(1).count() else df
    quartiles = [F.percentile_approx(F.col("stats")[i], [0.25, 0.5, 0.75], 1000).alias(f"m{i}") for i in range(SIZE)]
    start = {}
    for r in known.groupBy("lang").agg(F.count("*").alias("n"), *quartiles).collect():
        q = np.array([r[f"m{i}"] for i in range(SIZE)])
        start[r["lang"]] = (float(r["n"]), q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))
    if not start:
        return {}
    model, before = drawn(start), None
    for _ in range(STEPS):
        near = moments(distances(known, model).filter("not is_junk"))
        if not near:
            break
        model = drawn({k: near.get(k, (0.0, *start[k][1:])) for k in start})
        counts = {k: n for k, (n, *_) in near.items()}
        if counts == before:
            break
        before = counts
    return model


def distances(df: DataFrame, model: Model) -> DataFrame:
    """Adds ``distance`` (squared), ``contributions`` of each statistic to it, and ``is_junk``."""
    names = df.columns
    at_stats, at_lang = names.index("stats"), names.index("lang")
    spoken = NAMES.index("common")
    rest = np.array([i for i in range(SIZE) if i != spoken])
    inverse = {k: (centre, np.linalg.inv(cov)) for k, (centre, cov) in model.items()}
    partial = {k: (centre[rest], np.linalg.inv(cov[np.ix_(rest, rest)])) for k, (centre, cov) in model.items()}
    limit, partial_limit = tail_quantile(SIZE), tail_quantile(SIZE - 1)

    def run(batches):
        for batch in batches:
            stats = np.array(batch.column(at_stats).to_pylist(), float).reshape(-1, SIZE)
            langs = np.array(batch.column(at_lang).to_pylist(), object)
            each, most = np.zeros_like(stats), np.full(len(stats), limit)
            for lang in set(langs.tolist()):
                at = np.flatnonzero(langs == lang)
                if lang in inverse:
                    centre, inner = inverse[lang]
                    z = stats[at] - centre
                    each[at] = z * (z @ inner)
                else:
                    least = np.full(len(at), np.inf)
                    for centre, inner in partial.values():
                        z = stats[np.ix_(at, rest)] - centre
                        found = z * (z @ inner)
                        nearer = found.sum(1) < least
                        least[nearer] = found.sum(1)[nearer]
                        each[np.ix_(at[nearer], rest)] = found[nearer]
                    most[at] = partial_limit
            total = each.sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(each.tolist(), pa.list_(pa.float64())), pa.array(total > most)], names=[*names, "distance", "contributions", "is_junk"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType())), T.StructField("is_junk", T.BooleanType())]))


def rate(df: DataFrame, key: str, text: str, common_words: dict[str, list[str]]) -> DataFrame:
    """Every page with text: language, statistics, distance, contributions and ``is_junk``."""
    stats = cut_lineage(page_statistics(df, key, text, common_words))
    return distances(stats, models(stats))
