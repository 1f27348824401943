"""Chunks, retrieval records and their metrics, question answering data and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import arrays as ar
from loomtext.functions import text as tx


def chunks(df: DataFrame, key: str, text: str, least: int, most: int, target: int) -> DataFrame:
    """``(key, chunk_id, token_count, text)`` of balanced chunks; documents that allow none give none."""
    words = df.select(key, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1)).alias("w"))
    rows = words.select(key, "w", F.inline(ar.chunk_sizes(F.size("w"), least, most, target)))
    return rows.select(key, F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("size").cast("bigint").alias("token_count"), F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ").alias("text"))


def file_names(df: DataFrame, order: str, ticker: str, year: str, text: str) -> DataFrame:
    """``(order, name)``: ``TICKER_YEAR.txt``, repeats numbered from 2 in order; rows without text, ticker or year are left out."""
    base = F.concat_ws("_", tx.filename_part(F.col(ticker)), tx.year_part(F.col(year)))
    kept = df.filter(F.coalesce(tx.collapsed(F.col(text)) != "", F.lit(False)) & F.col(ticker).isNotNull() & F.col(year).isNotNull()).withColumn("base", base)
    k = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return kept.withColumn("k", k).select(order, F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("_"), "k")).otherwise(""), F.lit(".txt")).alias("name"))


def answer_metrics(records: DataFrame) -> DataFrame:
    """Of ``(baseline, answer, sources)``: rates, mean words, their ratio (null where nothing to divide by), sources."""
    a, b = tx.word_count(F.col("baseline")), tx.word_count(F.col("answer"))
    n = F.coalesce(F.size("sources"), F.lit(0))
    one = records.agg(
        F.count("*").alias("questions"), F.round(F.avg((a > 0).cast("double")), 6).alias("baseline_rate"), F.round(F.avg((b > 0).cast("double")), 6).alias("answer_rate"),
        F.round(F.avg(a), 6).alias("baseline_words"), F.round(F.avg(b), 6).alias("answer_words"), F.round(F.try_divide(F.avg(b), F.avg(a)), 6).alias("ratio"),
        F.round(F.avg(F.greatest(n, F.lit(0))), 6).alias("sources_each"), F.round(F.avg((n > 0).cast("double")), 6).alias("sources_rate"),
    )
    unique = records.select(F.explode("sources").alias("s")).filter("s <> ''").agg(F.count_distinct("s").alias("unique_sources"))
    return one.join(unique, how="cross")  # one row beside one row


def nested(hits: DataFrame, question: str, source: str) -> DataFrame:
    """``(question, hits, sources, sources_text)``: retrieved rows of a question in rank order, their sources once each."""
    rows = hits.groupBy(question).agg(F.sort_array(F.collect_list(F.struct("rank", source, "similarity"))).alias("hits"))
    sources = F.array_distinct(F.transform("hits", lambda x: x[source]))
    return rows.select(question, F.size("hits").cast("bigint").alias("hits"), F.size(sources).cast("bigint").alias("sources"), F.array_join(sources, " | ").alias("sources_text"))


def word_windows(df: DataFrame, key: str, words: str, width: int, stride: int) -> DataFrame:
    """``(key, start, size, words)`` of sliding windows over a word array."""
    rows = df.filter(F.size(words) > 0).select(key, words, F.explode(ar.window_starts(F.size(words), width, stride)).alias("start"))
    part = F.slice(words, F.col("start") + 1, width)
    return rows.select(key, F.col("start").cast("bigint").alias("start"), F.size(part).cast("bigint").alias("size"), part.alias("window_words"))


def answer_words(spans: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``(key, answer_no, first, last)``: words that overlap an answer's characters; answers that meet none drop out.

    ``spans``: (key, words with start and end); ``answers``: (key, answer_no, start_char, end_char).
    """
    rows = answers.join(spans, key)
    hit = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), ((w["start"] < F.col("end_char")) & (w["end"] > F.col("start_char"))).alias("in"))), lambda x: x["in"])
    return rows.select(key, "answer_no", hit.alias("h")).filter(F.size("h") > 0).select(key, "answer_no", F.element_at("h", 1)["i"].cast("bigint").alias("first"), F.element_at("h", -1)["i"].cast("bigint").alias("last"))


def best_spans(logits: DataFrame, key: str, longest: int) -> DataFrame:
    """``(key, start, end, score)``: the best start and end at most ``longest`` words apart; the first of equals.

    ``logits``: (key, pos, start_logit, end_logit). The band join goes within a question's array.
    """
    lists = logits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start_logit", "end_logit"))).alias("p"))
    n = F.size("p")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.slice("p", i, longest), lambda e: F.struct((F.element_at("p", i)["start_logit"] + e["end_logit"]).alias("score"), (-F.element_at("p", i)["pos"]).alias("s"), (-e["pos"]).alias("e")))))
    best = F.array_max(spans)
    return lists.select(key, best.alias("b")).select(key, (-F.col("b.s")).cast("bigint").alias("start"), (-F.col("b.e")).cast("bigint").alias("end"), F.round("b.score", 6).alias("score"))


def exact_and_f1(df: DataFrame, key: str, prediction: str, golds: str) -> DataFrame:
    """``(key, em, f1)``: the best over the golds (none: the empty answer), words compared as multisets; two empty answers agree."""
    gold = F.explode(F.when(F.size(golds) > 0, F.col(golds)).otherwise(F.array(F.lit("")))).alias("gold")
    rows = df.select(key, tx.answer_form(F.coalesce(F.col(prediction), F.lit(""))).alias("p"), gold).withColumn("g", tx.answer_form(F.coalesce("gold", F.lit(""))))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    p, g = words(F.col("p")), words(F.col("g"))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))))
    f1 = F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * common, F.size(p) + F.size(g)), F.lit(0.0)))
    return rows.groupBy(key).agg(F.max((F.col("p") == F.col("g")).cast("bigint")).alias("em"), F.round(F.max(f1), 6).alias("f1"))


def best_windows(scores: DataFrame, question: str) -> DataFrame:
    """The best window of each question, the first of equals."""
    w = Window.partitionBy(question).orderBy(F.desc("score"), "start")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def trimmed(words: Column, pieces: Column, most: int) -> Column:
    """The leading words whose pieces together stay within a limit (sums run along the array)."""
    sums = F.aggregate(pieces, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + p)))
    return F.slice(words, F.lit(1), F.size(F.filter(sums, lambda s: s <= most)))
