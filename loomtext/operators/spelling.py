"""Fuzzy lookup in a vocabulary, typing variants, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import udfs
from loomtext.functions.arrays import bound
from loomtext.session import parallelism, written


def with_parts(df: DataFrame, word: str, most: int) -> DataFrame:
    """Adds ``(part, place, length)`` keys: a word cut into ``most + 1`` parts keeps one of them whole under ``most`` edits."""
    n = F.length(word)
    cut = lambda i: F.floor(n * i / (most + 1)).cast("int")
    parts = [F.struct(F.lit(i).alias("place"), F.substring(F.col(word), cut(i) + 1, cut(i + 1) - cut(i)).alias("part"), n.alias("length")) for i in range(most + 1)]
    return df.withColumn("__k", F.explode(F.array(*parts))).select("*", "__k.*").drop("__k")


def close_words(words: DataFrame, vocab: DataFrame, most: int) -> DataFrame:
    """``(word, token, n, dist)`` within ``most`` edits: an equality join on parts, then the banded distance.

    The vocabulary's words are cut into parts; a query word offers, for every length a match may have, what stands where such a
    part may have shifted to. That replaces the nested loop over all pairs; every match shares at least one part, and one among
    them has at most as many edits before it as there are parts before, and after it as there are after: shifts beyond that are
    not offered. Small tables make many pairs, so both sides are dealt to a set number of tasks, and the distance is taken before
    equal pairs are moved.
    """
    tasks = parallelism(words.sparkSession)
    words = words.repartition(tasks, "word")
    v = with_parts(vocab.select("token", "n"), "token", most).select("token", "n", "part", "place", "length")
    w = F.length("word")
    lengths = F.sequence(F.greatest(w - most, F.lit(1)), w + most)

    def places(n: Column) -> Column:
        def at(i: Column) -> Column:
            a, b = F.floor(n * i / (most + 1)).cast("int"), F.floor(n * (i + 1) / (most + 1)).cast("int")
            first, last = F.greatest(a - i, a + w - n - (most - i), F.lit(0)), F.least(a + i, a + w - n + (most - i))
            shifts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(shifts, lambda s: F.struct(i.alias("place"), n.alias("length"), F.substring(F.col("word"), s + 1, b - a).alias("part"), (b - a).alias("size")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), at))

    keys = words.select("word", F.explode(F.flatten(F.transform(lengths, places))).alias("k")).select("word", "k.*").filter(F.length("part") == F.col("size")).drop("size")
    by = ["place", "length", "part"]
    pairs = keys.repartition(tasks, *by).join(v.repartition(tasks, *by), by).select("word", "token", "n")
    return pairs.withColumn("dist", F.levenshtein("word", "token", most)).filter("dist >= 0").distinct()


def suggestions(words: DataFrame, vocab: DataFrame, most: int = 2, top: int = 5) -> DataFrame:
    """``(word, rank, token, dist, n)`` by distance, frequency, spelling."""
    order = Window.partitionBy("word").orderBy("dist", F.desc("n"), "token")
    return close_words(words, vocab, most).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("word", "rank", "token", F.col("dist").cast("bigint").alias("dist"), "n")


def shortened(word: Column, most: int) -> Column:
    """The word and what is left of it after up to ``most`` signs are gone, each once."""

    def without_one(x: Column) -> Column:
        less = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.when(F.length(x) > 0, less).otherwise(F.array().cast("array<string>"))

    every = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        every = F.concat(every, last)
    return every


#: Letters that a typed word may stand for, and the plain ones.
MEANT, PLAIN = "".join(t for u, t in udfs.TYPED.items() if len(u) == 1), "".join(u for u in udfs.TYPED if len(u) == 1)


def expanded_suggestions(words: DataFrame, vocab: DataFrame, most: int = 2, top: int = 5, edits: int = 2, width: int = 40) -> DataFrame:
    """Suggestions for all typing variants of a word, merged by the best (distance, frequency, edits).

    Variants of a word differ in letters that have one plain form, but for digraphs; in plain letters no distance is longer. So
    plain forms are looked up, one or a few a word, and a word's variants are compared with what was found near them. Two forms
    within ``most`` edits are equal after as many signs or fewer have been left out of either: an equality join on hashes of what
    is left, with few pairs that turn out to be further apart.
    """
    tasks = parallelism(words.sparkSession)
    v = written(words.repartition(tasks, "word").select(F.col("word").alias("asked"), udfs.variants(edits, width)(F.col("word")).alias("variants")))
    plain = lambda x: F.translate(x, MEANT, PLAIN)
    keys = lambda x: F.inline(F.transform(bound(x, lambda y: shortened(y, most)), lambda y: F.struct(F.xxhash64(y).alias("key"), F.length(y).alias("left"))))
    forms = v.select("asked", F.explode(F.array_distinct(F.transform("variants", lambda x: plain(x["variant"])))).alias("form"))
    asked = forms.repartition(tasks, "asked").select("asked", "form", keys(F.col("form")))
    known = vocab.select("token", "n").repartition(tasks, "token").select("token", "n", keys(plain(F.col("token")))).drop("left")
    gone = F.greatest(F.length("form"), F.length("token")) - F.col("left")  # of the longer one; a pair needs no more than its distance
    pairs = asked.repartition(tasks, "key").join(known.repartition(tasks, "key"), "key").filter(F.levenshtein("form", plain(F.col("token")), most) >= gone)
    pairs = pairs.select("asked", "token", "n").repartition(tasks, "asked").distinct()
    least = F.array_min(F.filter(F.transform("variants", lambda x: F.struct(F.levenshtein(x["variant"], F.col("token"), most).alias("dist"), x["edits"].alias("edits"))), lambda x: x["dist"] >= 0))
    best = pairs.join(v.repartition(tasks, "asked"), "asked").select("asked", "token", "n", least.alias("b")).filter("b is not null")
    order = Window.partitionBy("asked").orderBy("b.dist", F.desc("n"), "b.edits", "token")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select(F.col("asked").alias("word"), "rank", "token", "b.dist", "n", F.col("b.edits").cast("bigint").alias("edits"))


def corrupted(word: Column, seed: int = 7, letters: str = "abcçdeəfgğhxıijkqlmnoöprsştuüvyz") -> Column:
    """A typo chosen by hash: one sign deleted, inserted, replaced or swapped with the next; single signs are never deleted."""
    h = F.md5(F.concat(word, F.lit(f"-{seed}")))
    digit = lambda at, base: F.pmod(F.conv(F.substring(h, at, 4), 16, 10).cast("int"), base)
    n = F.length(word)
    place, letter = digit(5, n), F.substring(F.lit(letters), digit(9, F.lit(len(letters))) + 1, F.lit(1))
    op = F.when(n < 2, digit(1, F.lit(2)) + 1).otherwise(digit(1, F.lit(4)))
    head, tail = F.left(word, place), F.substring(word, place + 2, n)
    swap = F.least(place, n - 2)
    swapped = F.concat(F.left(word, swap), F.substring(word, swap + 2, F.lit(1)), F.substring(word, swap + 1, F.lit(1)), F.substring(word, swap + 3, n))
    return F.when(op == 0, F.concat(head, tail)).when(op == 1, F.concat(head, letter, F.substring(word, place + 1, n))).when(op == 2, F.concat(head, letter, tail)).otherwise(swapped)


def accuracy(ranked: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """``(asked, at_1, at_k)``: how often the right word is first, or among the first ``top``."""
    hit = pairs.join(ranked.select("word", "token", "rank"), (F.col("wrong") == F.col("word")) & (F.col("right") == F.col("token")), "left")
    return hit.agg(F.count("*").alias("asked"), F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("at_1"), F.round(F.avg(F.when(F.col("rank") <= top, 1.0).otherwise(0.0)), 6).alias("at_k"))


def confusions(pairs: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``(op, a, b, n, cost)`` of the edits from the right to the wrong word; the cost falls with the count."""
    edits = pairs.select(F.inline(udfs.alignment(F.col("right"), F.col("wrong")))).filter("op <> 'match'")
    return edits.groupBy("op", "a", "b").agg(F.count("*").alias("n")).withColumn("cost", F.round(1 / (F.col("n") + smoothing), 6))
