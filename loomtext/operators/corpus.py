"""Corpus statistics: tokens, frequencies, Zipf, Heaps, vocabularies."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.session import cut_lineage, parallelism

# The letters of the alphabet.
ALPHABET = "abcçdeəfgğhxıijkqlmnoöpprsştuüvyzABCÇDEƏFGĞHXIİJKQLMNOÖPPRSŞTUÜVYZ"

PARTS = 4096  # parts in which steps are summed up


def load_texts(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Texts that are not blank, in key order; the limit counts after the blank ones are gone."""
    out = df.filter(F.coalesce(tx.collapsed(F.col(text)) != "", F.lit(False)))
    return out.orderBy(key).limit(most) if most else out


def token_rows(df: DataFrame, key: str, text: str, lowercase: bool = True) -> DataFrame:
    """``(key, pos, token)``: order never comes from partition order."""
    return df.select(F.col(key), F.posexplode(tx.tokens(F.coalesce(F.col(text), F.lit("")), lowercase)).alias("pos", "token"))


def frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def summary(df: DataFrame, key: str, text: str) -> DataFrame:
    counts = frequencies(token_rows(df, key, text))
    return counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).crossJoin(df.agg(F.count("*").alias("documents"))).select("documents", "tokens", "types")  # one row beside one row


def zipf(counts: DataFrame, top: int) -> DataFrame:
    """Ranks of the ``top`` commonest tokens; the top is taken first, so the ranking window sees no more than that."""
    head = counts.orderBy(F.desc("n"), "token").limit(top)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("bigint"))


def filtered(counts: DataFrame, least: int, most: int | None, length: int, alphabet: str | None = ALPHABET) -> DataFrame:
    keep = (F.col("n") >= least) & (F.length("token") >= length)
    keep = keep & (F.col("n") <= most) if most else keep
    return counts.filter(keep & F.col("token").rlike(f"^[{alphabet}]+$") if alphabet else keep)


def spelling_vocabulary(counts: DataFrame, least: int = 2, length: int = 3, upper: float = 0.6) -> DataFrame:
    """Words of letters alone, often enough, long enough and not mostly capitals."""
    share = F.length(F.regexp_replace("token", r"[^\p{Lu}]", "")) / F.length("token")
    return counts.filter((F.col("n") >= least) & (F.length("token") >= length) & F.col("token").rlike(r"^\p{L}+$") & (share <= upper))


def heaps(df: DataFrame, key: str, text: str, step: int) -> DataFrame:
    """``(n, v)``: distinct tokens among the first ``n``, every ``step`` tokens and at the end.

    Token places run over the documents in key order. Documents' offsets come from their token counts by ranges (their sums on the
    driver, a window within each range), first places by a min over tokens, and the new tokens per step are summed up within parts
    that begin at the parts' sums before them.
    """
    spark = df.sparkSession
    docs = cut_lineage(df.select(F.col(key).alias("k"), tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).repartitionByRange(parallelism(spark), "k"))
    ranges = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.sum(F.size("t")).alias("c")).collect()  # a row a partition
    total, bases = 0, []
    for r in sorted(ranges, key=lambda r: r["lo"]):
        bases.append((r["p"], total))
        total += r["c"]
    sized = docs.select("k", F.size("t").alias("c"), F.spark_partition_id().alias("p"))
    inner = F.sum("c").over(Window.partitionBy("p").orderBy("k")) - F.col("c")
    offsets = sized.withColumn("inner", inner).join(F.broadcast(spark.createDataFrame(bases, "p int, base bigint")), "p").select("k", (F.col("base") + F.col("inner")).alias("offset"))  # a row a partition
    first = docs.join(offsets, "k").select("offset", F.posexplode("t").alias("pos", "token")).groupBy("token").agg(F.min(F.col("offset") + F.col("pos") + 1).alias("place"))
    steps = (total + step - 1) // step
    wide = max(1, -(-steps // PARTS))  # steps of a part, within which they are summed up
    new = cut_lineage(first.groupBy(F.ceil(F.col("place") / step).cast("bigint").alias("s")).agg(F.count("*").alias("new")))
    sums = {r["part"]: r["n"] for r in new.groupBy(F.floor(F.col("s") / wide).alias("part")).agg(F.sum("new").alias("n")).collect()}  # `PARTS` rows
    at, before = 0, []
    for part in range(steps // wide + 1):
        before.append((part, at))
        at += sums.get(part, 0)
    rows = spark.range(1, steps + 1).withColumnRenamed("id", "s").withColumn("part", F.floor(F.col("s") / wide)).join(new, "s", "left")
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "part bigint, before bigint")), "part", "left")
    known = F.coalesce(F.sum("new").over(Window.partitionBy("part").orderBy("s")), F.lit(0)) + F.coalesce("before", F.lit(0))
    return rows.select(F.least(F.col("s") * step, F.lit(total)).cast("bigint").alias("n"), known.cast("bigint").alias("v"))


def heaps_fit(points: DataFrame) -> DataFrame:
    """``k`` and ``beta`` of v = k * n ** beta by least squares of logarithms."""
    p = points.filter("n > 0 and v > 0")
    return p.agg(F.round(F.exp(F.regr_intercept(F.ln("v"), F.ln("n"))), 4).alias("k"), F.round(F.regr_slope(F.ln("v"), F.ln("n")), 6).alias("beta"))


def suffixes(words: DataFrame, top: int = 15) -> DataFrame:
    """The commonest endings of two to four letters, of words at least two longer."""
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.when((F.length("token") >= n + 2), F.right("token", F.lit(n))).alias("suffix")) for n in (2, 3, 4)]))
    rows = words.filter(F.col("token").rlike(r"^\p{L}+$")).select("n", ends.alias("e")).select("n", "e.*").filter("suffix is not null")
    counts = rows.groupBy("length", "suffix").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("length").orderBy(F.desc("n"), "suffix")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(F.col("length").cast("bigint").alias("length"), "suffix", "n", F.col("rank").cast("bigint").alias("rank"))


def pair_counts(words: DataFrame) -> DataFrame:
    """``(a, b, n)``: adjacent symbols of word types, weighted by frequency."""
    from loomtext.functions.arrays import symbols

    s = symbols(F.col("token"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("a"), F.element_at(s, i + 1).alias("b")))
    return words.select("n", F.inline(pairs)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def learned_merges(words: list[str], counts: list[int], merges: int, least: int) -> list[tuple[str, str]]:
    """Merges in order, the commonest pair first (ties: smaller pair). Only words that hold the merged pair are counted anew."""
    parts = [[*w, "</w>"] for w in words]
    pairs, holders = defaultdict(int), defaultdict(set)
    for k, s in enumerate(parts):
        for p in zip(s, s[1:]):
            pairs[p] += counts[k]
            holders[p].add(k)
    heap = [(-n, *p) for p, n in pairs.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while heap and len(out) < merges:
        n, a, b = heapq.heappop(heap)
        if pairs.get((a, b), 0) != -n:  # stale: each change of a count has its own entry
            continue
        if -n < least:
            break
        out.append((a, b))
        moved = defaultdict(int)
        for k in holders.pop((a, b)):
            old, new, i = parts[k], [], 0
            while i < len(old):
                hit = i + 1 < len(old) and old[i] == a and old[i + 1] == b
                new.append(a + b if hit else old[i])
                i += 2 if hit else 1
            parts[k], before, after = new, list(zip(old, old[1:])), list(zip(new, new[1:]))
            for p in before:
                moved[p] -= counts[k]
            for p in after:
                moved[p] += counts[k]
                holders[p].add(k)
            for p in set(before).difference(after):
                if p in holders:
                    holders[p].discard(k)
        for p, change in moved.items():
            if change:
                pairs[p] += change
                if pairs[p] > 0:
                    heapq.heappush(heap, (-pairs[p], *p))
                else:
                    del pairs[p]
                    holders.pop(p, None)
    return out


def train_merges(words: DataFrame, merges: int, least: int = 2) -> list[tuple[str, str]]:
    """Ordered merges. Each hangs on the one before, so one task holds the word types (not the text) and learns them all.

    What comes to the driver is as long as the merges that were asked for.
    """

    def learn(groups):
        frames = list(groups)
        tokens, counts = ([x for f in frames for x in f[c].tolist()] for c in ("token", "n"))
        yield pd.DataFrame([(i, *p) for i, p in enumerate(learned_merges(tokens, counts, merges, least))], columns=["i", "a", "b"])

    rows = words.select("token", "n").repartition(1).mapInPandas(learn, "i long, a string, b string").collect()
    return [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["i"])]


def is_blank(text: Column) -> Column:
    return tx.collapsed(text) == ""
