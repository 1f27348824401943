"""Tables as the queries need them, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import corpus, sampling
from loomtext.session import cut_lineage, one_record, spread, table

WHITE = r"[\p{Z}\t\n\v\f\r\x{85}]"
TOKEN = r"(\p{L}+(?:[''\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*)"
NORMAL = r"trim(regexp_replace(translate({x}, chr(160) || '’‘–—', ' ''''--'), '" + WHITE + r"+', ' ', 'g'))"


def normal_sql(x: str) -> str:
    return NORMAL.replace("{x}", x)


def tokens_sql(x: str) -> str:
    t = normal_sql(f"coalesce({x}, '')")
    t = rf"regexp_replace({t}, '(?im)^\s*(kateqoriya|istinadlar|qeydlər|əlavəədəbiyyat)\b.*$', ' ', 'g')"
    for label in ("kateqoriya", "istinadlar", "qeydlər", "əlavə ədəbiyyat"):
        t = rf"regexp_replace({t}, '(?i)\b{label}\b\s*:\s*', ' ', 'g')"
    return f"regexp_extract_all(lower(replace({t}, 'İ', 'i̇')), '{TOKEN}')"


TOKENS = f"t as (select doc_id, unnest({tokens_sql('text')}) as token from documents), c as (select token, count(*) as n from t group by token)"
#: Sentences of the language models: lines of documents.
LINES = f"s0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as k from documents), s as (select doc_id, doc_id || '-' || k as sid, {tokens_sql('line')} as words from s0 where len({tokens_sql('line')}) > 0)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang", "doc_kind"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.frequencies(corpus.token_rows(docs(spark, d), "doc_id", "text"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, sid, words)``: the lines of documents that hold words."""
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line")).filter(F.col("line").rlike(r"[\p{L}\p{N}]"))
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("sid"), tx.tokens(F.col("line")).alias("words")).filter(F.size("words") > 0)


def lm_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with ``split``: a fifth of the documents is for testing."""
    parts = sampling.split(docs(spark, d).select("doc_id"), "doc_id", 0.2, 42)
    return sentences(spark, d).join(parts, "doc_id")


SPLIT = "sp as (select doc_id, case when row_number() over (order by md5(doc_id || '-42'), doc_id) <= greatest(1, round_even(count(*) over () * 0.2, 0)) then 'test' else 'train' end as split from documents)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    from loomtext.operators import sentiment

    rows = one_record(table(spark, d, "reviews").select("review_id", "content", "score", "split_name", "source", "upvotes"), "review_id")
    kept = sentiment.labelled(rows, "content", "score").filter("split_name is not null")
    return kept.withColumn("split", F.when(F.col("split_name") == "train", "train").otherwise("test"))


REVIEWS = (
    "r0 as (select distinct review_id, content, score, split_name, source from reviews), "
    f"r as (select review_id, content, source, case when score <= 2 then 'negative' when score >= 4 then 'positive' else 'neutral' end as label, case when split_name = 'train' then 'train' else 'test' end as split from r0 where score between 1 and 5 and split_name is not null and content is not null and trim(regexp_replace(content, '{WHITE}+', ' ', 'g')) <> '')"
)


def legacy_sql(x: str) -> str:
    """Stemmed words of a text, tested against the stop words before and after."""
    stop = ", ".join(repr(s) for s in tx.STOP_WORDS)
    low = f"lower(replace({x}, 'İ', 'i̇'))"
    plain = f"translate(replace(replace(replace({low}, 'ch', 'c'), 'sh', 's'), 'gh', 'g'), 'çəığöşü', 'ceigosu')"
    punct = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
    clean = f"trim(regexp_replace(translate(replace({plain}, '-', ' '), '{punct}', ''), '{WHITE}+', ' ', 'g'))"
    words = f"list_filter(string_split({clean}, ' '), lambda w: w <> '' and w not in ({stop}))"
    suffixes = "[" + ", ".join(repr(s) for s in tx.SUFFIXES) + "]"
    stems = f"list_transform({words}, lambda w: list_reduce(list_prepend(w, {suffixes}), lambda acc, s: case when ends_with(acc, s) and length(acc) > length(s) then left(acc, length(acc) - length(s)) else acc end))"
    bare = f"regexp_replace(v, '{tx.EMOJI_WORD}', '', 'g')"
    return f"list_filter(flatten(list_transform({stems}, lambda v: list_concat([case when {bare} in ({stop}) then '' else {bare} end], list_distinct(regexp_extract_all(v, '{tx.EMOJI_WORD}'))))), lambda y: y <> '')"


def review_tokens(spark: SparkSession, d: str) -> DataFrame:
    from loomtext.operators import sentiment

    return cut_lineage(sentiment.token_table(reviews(spark, d), "review_id", "content"))


REVIEW_TOKENS = REVIEWS + f", w as (select review_id, label, split, unnest({legacy_sql('content')}) as token from r), tt as (select review_id, label, split, token, count(*) as tf from w group by all)"
