"""Array columns: n-grams, windows, chunks, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLUE = "\u0001"  # between the words of an n-gram key: cheaper to compare and to shuffle than an array


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda an expression would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def padded(words: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit("<s>"), n - 1), words, F.array(F.lit("</s>")))


def ngrams(words: Column, n: int) -> Column:
    """Structs ``(h, w)`` of the n-grams of a sentence with boundary signs: history (joined) and word."""
    return bound(padded(words, n), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.struct(F.array_join(F.slice(p, i, n - 1), GLUE).alias("h"), F.element_at(p, i + (n - 1)).alias("w"))))


def events(words: Column) -> Column:
    """Structs ``(h2, h1, w)``: every predicted word of a sentence with the two before it."""
    return bound(padded(words, 3), lambda p: F.transform(F.sequence(F.lit(3), F.size(p)), lambda i: F.struct(F.element_at(p, i - 2).alias("h2"), F.element_at(p, i - 1).alias("h1"), F.element_at(p, i).alias("w"))))


def symbols(word: Column) -> Column:
    return F.concat(F.split(word, ""), F.array(F.lit("</w>")))


def pairs_within(words: Column, window: int) -> Column:
    """Structs ``(a, b, d)`` of the words at most ``window`` apart, the earlier first; no self-join, nothing shuffled."""
    n = F.size(words)
    at = lambda i: F.transform(F.sequence(i + 1, F.least(i + window, n)), lambda j: F.struct(F.element_at(words, i).alias("a"), F.element_at(words, j).alias("b"), (j - i).alias("d")))
    every = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), at))
    return F.when(n > 1, every)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return bound(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def combined(a: Column, b: Column, c: Column) -> Column:
    """``b - a + c``, element by element."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda x: x["b"].cast("double") - x["a"].cast("double") + x["c"].cast("double"))


def window_starts(n: Column, width: int, stride: int) -> Column:
    """Starts of sliding windows; the last is the first one to reach the end."""
    last = F.ceil(F.greatest(n - width, F.lit(0)) / stride).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)


def chunk_sizes(n: Column, least: int, most: int, target: int) -> Column:
    """``(start, size)`` of balanced chunks with ``least`` to ``most`` tokens; null where there are none."""
    low, high = F.ceil(n / most).cast("int"), F.floor(n / least).cast("int")
    count = F.greatest(F.least(F.greatest(F.greatest(F.bround(n / target), F.lit(1)).cast("int"), low), high), F.lit(1))
    base, extra = F.floor(n / count).cast("int"), (n % count).cast("int")
    fits = (n >= least) & (low <= high) & (base >= least) & (base + F.when(extra > 0, 1).otherwise(0) <= most)
    rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_id"), (i * base + F.least(i, extra)).alias("start"), (base + F.when(i < extra, 1).otherwise(0)).alias("size")))
    return F.when(fits, rows)


def fitted(words: Column, length: int, fill) -> Column:
    """Cut or filled up to a length."""
    return F.concat(F.slice(words, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(words), F.lit(0))))


def softmax(x: Column) -> Column:
    raised = bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return bound(raised, lambda r: bound(F.aggregate(r, F.lit(0.0), lambda t, v: t + v), lambda total: F.transform(r, lambda v: v / total)))
