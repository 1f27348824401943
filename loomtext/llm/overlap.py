"""Problem 2: records of the evaluation splits that stand again, equal or almost equal, in the training split.

Two records overlap if they share at least four fifths of the words of the longer one, whatever the order. A record is brought
to one sequence that does not depend on the order of its text: its words (case, marks, outer punctuation, emoji, drawn-out
letters, unseen signs and look-alikes ignored; a repeated word counts as often as it stands), the uncommon ones first, then
the common ones from rare to frequent. Equal sequences are one class, and classes are compared, so that copies cost nothing.

*Fingerprints.* Of ``n`` words at most ``d = n // 5`` are not shared. The first shared word stands among the first ``d + 1`` of
both sequences: the uncommon words there are fingerprints, with their place. A common word (in ``HOT`` classes or more) would
be a key of many rows, so it is none by itself. Records without a shared uncommon word share common words alone (and none of
them holds more than ``d`` uncommon words): their fingerprints are rolling hashes of three common words. Up to ``SHORT`` words
all threes of the first ``d - u + 3`` common ones are taken (``u`` uncommon words stand before them). Longer records take the
threes in every window of four words, among the first ``3 n // 5 - 2 u + 3``: of so many words ``m >= da + db + 3`` are
shared, where ``da`` and ``db`` others stand between them, so the spans of the threes of consecutive shared words add up to
less than six on both sides together, and one three lies within four words on both. So no pair is missed, and a long record's
fingerprints grow with its length only; of short ones the rarest words alone are taken. Records near ``SHORT`` have both kinds.

*Chains.* Fingerprints are joined across the splits. Those of a pair are collinear, as both sequences are in one order; what
lies before, between and behind the first and the last bounds the shared words from above, and pairs that cannot reach their
share end there.

*Alignment.* The chain is extended to both ends of the sequences: the longest common subsequence of two sequences in one
order are their equal words. Its share of each record is the record's coverage.

``HOT`` does not grow with the collection on purpose: it bounds the pairs that one key can make (``HOT ** 2 / 4``).

Defined cases: null, blank and short contents (fewer than ``LEAST`` words) take no part; exact copies of a row are one
record; a record in no named split takes no part; words are compared by 32-bit hashes (a chance of 1e-7 a pair to count a
word too many).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.lookalikes import forms
from loomtext.session import cut_lineage, written

LEAST = 8  # words
SHARE = 0.8
SHORT = 64  # words up to which all threes of the first common words are made
HOT = 20  # classes from which a word is common
HOT_WORDS = 200_000  # common words up to which their list is sent to the executors; beyond, records are joined with it
MEMO = 300_000
COUNTED = 2_000_000  # distinct words that a task counts before it sends them on
BASE = np.int64(0x1E3779B97F4A7C15)
MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
DRAWN = re.compile(r"([^\W\d_])\1+")


def plain(word: str) -> str:
    """The word as it is compared; ``word`` is already in the one form of look-alikes."""
    word = MARKS.sub("", unicodedata.normalize("NFD", word).lower().replace("ı", "i").replace("ə", "e"))
    return DRAWN.sub(r"\1", OUTER.sub("", word))


class Words(dict):
    """From a word as it stands to its 32-bit hash; 0 where nothing is left of it."""

    def learn(self, words: list[str]) -> None:
        if len(self) > MEMO:
            self.clear()
        for word, form in zip(words, forms(words), strict=True):
            kept = plain(form)
            self[word] = (xxhash.xxh32_intdigest(kept) or 1) if kept else 0


def numbered(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of many records, sorted within each; a repeated word becomes others by its count."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    at = np.arange(len(rows))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    repeat = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint32)
    if repeat.any():
        hashes = hashes + repeat * np.uint32(0x9E3779B1)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def sequences(df: DataFrame, key: str, text: str, side: str, extra: list[str] = ()) -> DataFrame:
    """``(key, side, *extra, class, words)`` of the records with enough words; narrow, in Arrow batches."""
    source = df.select(F.col(key).alias("key"), F.col(side).alias("side"), *extra, F.col(text).alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("class", T.LongType()), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batches):
        known = Words()
        for batch in batches:
            texts = [t.split() if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = [i for i, t in enumerate(texts) if len(t) >= LEAST]
            flat = [w for i in rows for w in texts[i]]
            new = {w for w in flat if w not in known}
            known.learn(list(new) if len(known) + len(new) <= MEMO else list(set(flat)))
            hashes = np.fromiter(map(known.__getitem__, flat), np.uint32, len(flat))
            owner = np.repeat(np.array(rows, np.int64), [len(texts[i]) for i in rows])
            count = np.bincount(owner[hashes > 0], minlength=len(texts))
            kept = (hashes > 0) & (count[owner] >= LEAST)
            owner, hashes = numbered(owner[kept], hashes[kept])
            rows = np.flatnonzero(count >= LEAST)
            ends = np.concatenate([[0], np.cumsum(count[rows])])
            data = hashes.tobytes()
            classes = [xxhash.xxh3_64_intdigest(data[4 * a : 4 * b]) - (1 << 63) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int32)))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(batch.num_columns - 1)), pa.array(classes, pa.int64()), words], names=schema.names)

    return source.mapInArrow(run, schema)


def common_words(classes: DataFrame) -> DataFrame:
    """``(word, n)`` of the words in ``HOT`` classes or more; tasks combine before anything is shuffled."""

    def run(batches):
        words, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            new, n = np.unique(batch.column("words").flatten().to_numpy(), return_counts=True)
            both, at = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            words = both
            if len(words) > COUNTED:
                yield out()
                words, counts = words[:0], counts[:0]
        yield out()

    parts = classes.select("words").mapInArrow(run, "word int, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)


def ordered(classes: DataFrame) -> DataFrame:
    """``(class, n, u, words, in_train, in_test)``: the sequences in their order, ``u`` uncommon words first."""
    spark = classes.sparkSession
    hot = cut_lineage(common_words(classes))
    sent = None
    if hot.limit(HOT_WORDS + 1).count() <= HOT_WORDS:
        listed = hot.orderBy("word").toPandas()
        sent = spark.sparkContext.broadcast((listed["word"].to_numpy(np.int32), listed["n"].to_numpy(np.int64)))
    else:  # the list has no small bound: each record's counts come by a join on the word, and back by class
        each = classes.select("class", F.posexplode("words").alias("pos", "word")).join(hot, "word", "left")
        lists = each.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
        classes = classes.join(lists.select("class", F.col("x.n").alias("counts")), "class")

    def run(batches):
        common, n_common = sent.value if sent is not None else (None, None)
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            if sent is None:
                counts = batch.column("counts").flatten().to_numpy()
            elif len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                counts = np.where(common[at] == flat, n_common[at], 0)
            else:
                counts = np.zeros(len(flat), np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, counts, rows))
            uncommon = np.bincount(rows[counts == 0], minlength=len(sizes))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[order]))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sizes.astype(np.int32)), pa.array(uncommon.astype(np.int32)), words, batch.column("in_train"), batch.column("in_test")], names=["class", "n", "u", "words", "in_train", "in_test"])

    return classes.mapInArrow(run, "class bigint, n int, u int, words array<int>, in_train boolean, in_test boolean")


def seeds_of(words: np.ndarray, sizes: np.ndarray, uncommon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, seed)`` of many ordered sequences, given by their sizes and numbers of uncommon words."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(rows)) - start[rows]
    spare = sizes // 5
    alone = (place < uncommon[rows]) & (place <= spare[rows])
    out = [(rows[alone], place[alone], words[alone].astype(np.int64))]
    left = spare - uncommon  # words that may differ among the common ones
    words = words.astype(np.int64) & 0xFFFFFFFF

    def grams(first: np.ndarray, last: np.ndarray, steps: list[tuple[int, int]], kind: int) -> None:
        """Rolling hashes of the words at a place and at two steps behind it, up to the last place."""
        for one, two in steps:
            i = first[place[first] + two < last[rows[first]]]
            if len(i):
                out.append((rows[i], place[i], (((words[i] * BASE + words[i + one]) * BASE + words[i + two]) << np.int64(2)) | np.int64(kind) | np.int64(-1 << 63)))

    common = (place >= uncommon[rows]) & (left[rows] >= 0)
    short = np.flatnonzero(common & (sizes[rows] <= SHORT))
    most = int(left[rows[short]].max(initial=-1)) + 3
    grams(short, np.minimum(uncommon + left + 3, sizes), [(a, b) for a in range(1, most) for b in range(a + 1, most)], 1)
    long = np.flatnonzero(common & (sizes[rows] > SHARE * SHORT))
    grams(long, np.minimum(sizes * 3 // 5 - uncommon + 3, sizes), [(1, 2), (1, 3), (2, 3)], 2)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprint_rows(sequences: DataFrame) -> DataFrame:
    """``(seed, class, n, place, in_train, in_test)``, one row for each seed of a class, partitioned by seed."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            at, place, seeds = seeds_of(lists.flatten().to_numpy(), batch.column("n").to_numpy().astype(np.int64), batch.column("u").to_numpy().astype(np.int64))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(place.astype(np.int32)), *(batch.column(c).take(take) for c in ("class", "n", "in_train", "in_test"))], names=["seed", "place", "class", "n", "in_train", "in_test"])

    return sequences.mapInArrow(run, "seed bigint, place int, class bigint, n int, in_train boolean, in_test boolean").repartition("seed")


def reaches(shared: Column) -> Column:
    return shared >= SHARE * F.greatest("n_a", "n_b")


def chained(sequences: DataFrame) -> DataFrame:
    """``(class_a, class_b, n_a, n_b, seeds, first, last)`` of the pairs whose chain of seeds leaves room for their share.

    ``first`` and ``last`` hold the places of a seed in both sequences, that of the first in the upper 32 bits.
    """
    seeds = fingerprint_rows(sequences)
    a = seeds.filter("in_train").select("seed", F.col("class").alias("class_a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"))
    b = seeds.filter("in_test").select("seed", F.col("class").alias("class_b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"))
    room = F.least("p_a", "p_b") + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    met = a.join(b, "seed").filter((F.col("class_a") != F.col("class_b")) & reaches(F.least("n_a", "n_b")) & reaches(room))
    place = F.shiftleft(F.col("p_a").cast("bigint"), 32) + F.col("p_b")
    chains = met.groupBy("class_a", "class_b", "n_a", "n_b").agg(F.count("*").alias("seeds"), F.min(place).alias("first"), F.max(place).alias("last"))
    high, low = (lambda x: F.shiftright(x, 32)), (lambda x: F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)))
    between = F.least(high("last") - high("first"), low("last") - low("first"))
    room = F.least(high("first"), low("first")) + between + F.least(F.col("n_a") - high("last"), F.col("n_b") - low("last"))
    return chains.filter(reaches(room))


def aligned(chains: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds ``shared``: the words of the alignment that extends the chain to both ends of the two sequences."""
    schema = T.StructType([*chains.schema.fields, T.StructField("shared", T.IntegerType())])

    def run(batches):
        for batch in batches:
            keys = []
            for name in ("words_a", "words_b"):
                lists = batch.column(name)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
                keys.append((owner << 32) | (lists.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF))
            # no word stands twice in a sequence, and both are in one order: the alignment is what they have in common
            shared = np.bincount(np.intersect1d(*keys, assume_unique=True) >> 32, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(shared.astype(np.int32))], names=schema.names)

    wanted = chains.select(F.col("class_a").alias("class")).union(chains.select("class_b")).distinct()
    words = sequences.select("class", "words").join(wanted, "class", "left_semi")
    both = chains.join(words.select(F.col("class").alias("class_a"), F.col("words").alias("words_a")), "class_a").join(words.select(F.col("class").alias("class_b"), F.col("words").alias("words_b")), "class_b")
    return both.select(*chains.columns, "words_a", "words_b").mapInArrow(run, schema)


def overlapping_classes(rows: DataFrame) -> DataFrame:
    """``(class_a, class_b, n_a, n_b, seeds, shared)``: of training and of other records; a class with both is one with itself."""
    train = F.col("side") == "train"
    classes = rows.groupBy("class").agg(F.first("words").alias("words"), F.max(train).alias("in_train"), F.max(~train).alias("in_test"))
    sequences = written(ordered(classes))
    almost = aligned(written(chained(sequences)), sequences).filter(reaches(F.col("shared")))
    same = F.col("n")
    equal = sequences.filter("in_train and in_test").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), same.alias("n_a"), same.alias("n_b"), F.lit(None).cast("bigint").alias("seeds"), same.alias("shared"))
    return almost.select("class_a", "class_b", "n_a", "n_b", "seeds", "shared").unionByName(equal)


def members_of(df: DataFrame, key: str, text: str, split: str, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(key, side, *extra, class)`` of the records that take part, and the overlapping classes."""
    named = df.filter(F.col(split).isin("train", "validation", "test"))
    rows = written(sequences(named, key, text, split, extra))
    return rows.drop("words").distinct(), overlapping_classes(rows)


def overlaps(df: DataFrame, key: str, text: str, split: str, extra: list[str] = ()) -> DataFrame:
    """All pairs of a training record and another: ``(key_a, key_b, shared, n_a, n_b, side_b, *extra of b)``."""
    members, classes = members_of(df, key, text, split, extra)
    a = members.filter("side = 'train'").select(F.col("class").alias("class_a"), F.col("key").alias("key_a"))
    b = members.filter("side <> 'train'").select(F.col("class").alias("class_b"), F.col("key").alias("key_b"), F.col("side").alias("side_b"), *extra)
    return classes.join(a, "class_a").join(b, "class_b").select("key_a", "key_b", "shared", "n_a", "n_b", "side_b", *extra)


def record_coverage(df: DataFrame, key: str, text: str, split: str, extra: list[str] = ()) -> DataFrame:
    """``(key, side, *extra, class, links, coverage)``: each evaluation record that overlaps training records, whole in one row.

    ``links`` counts the training records; they come from the classes' sizes, and no pair of members is made.
    """
    members, classes = members_of(df, key, text, split, extra)
    sizes = members.filter("side = 'train'").groupBy(F.col("class").alias("class_a")).agg(F.count("*").alias("size"))
    best = classes.join(sizes, "class_a").groupBy(F.col("class_b").alias("class")).agg(F.sum("size").alias("links"), F.max(F.col("shared") / F.col("n_b")).alias("coverage"))
    return members.filter("side <> 'train'").join(best, "class").select("key", "side", *extra, "class", "links", "coverage")
