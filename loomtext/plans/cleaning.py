"""Queries on markup, lines of another language, labels and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import udfs
from loomtext.operators import boundaries
from loomtext.plans.common import WHITE
from loomtext.plans.texts import CORPUS_D, DOTS, PAGES, RULE, pages, ruled, short_docs
from loomtext.session import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LEAST_CHARS = 400
MARKUP = "w0 as (select doc_id, text as t from pg)"
STEPS = [r"\{\{[^{}]*\}\}"] * 4 + [r"<[A-Za-z][^<>]*/>"] + [r"<[A-Za-z][^<>]*>[^<]*</[A-Za-z]+>"] * 4 + [r"<[^<>]*>", r"''{2,5}[^''\n]+''{2,5}"]
for number, step in enumerate(STEPS, 1):
    MARKUP += f", w{number} as (select doc_id, regexp_replace(t, '{step}', '', 'g') as t from w{number - 1})"
MARKUP += rf""", wz as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\[\[(?:Kateqoriya|Fayl|File):[^\]]+\]\]', ' ', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g'), '\[https?://[^ \]]+ ([^\]]*)\]', '\1', 'g'), '{WHITE}+', ' ', 'g')) as t from w{len(STEPS)}),
wp as (select doc_id, case when regexp_matches(t, '(?i)^\s*(kateqoriya:|category:)') then '' else t end as t from wz),
wc as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\{{\{{[^}}]+\}}\}}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '_+', ' ', 'g'), '{WHITE}+', ' ', 'g')) as text from wp)"""


@query("wikitext_texts", f"with {PAGES}, {MARKUP} select doc_id, text from wc where length(text) >= {LEAST_CHARS}")
def wikitext_texts(spark, d):
    """Pages as plain text, those of ``LEAST_CHARS`` characters or more."""
    return pages(spark, d).select("doc_id", tx.wikitext_page(F.col("text")).alias("text")).filter(F.length("text") >= LEAST_CHARS)


@query(
    "english_lines_removed",
    r"""with pg as (select distinct doc_id, text from corpus_pages where text is not null), l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from pg),
w as (select doc_id, k, unnest(regexp_extract_all(lower(replace(line, 'İ', 'i̇')), '[\p{L}\p{M}]+')) as word from l), e as (select distinct word from common_words), en as (select distinct word from common_words where lang = 'en'),
h as (select doc_id, k, count_if(word in (from e)) as every, count_if(word in (from en)) as own from w group by doc_id, k)
select doc_id, array_to_string(coalesce(list(line order by l.k) filter (where coalesce(own, 0) < 2 or own <= 0.7 * every), []), chr(10)) as text from l left join h using (doc_id, k) group by doc_id""",
)
def english_lines_removed(spark, d):
    words: dict[str, list[str]] = {}
    for r in table(spark, d, "common_words").select("lang", "word").distinct().collect():  # a fixed list
        if r["lang"] and r["word"]:
            words.setdefault(r["lang"], []).append(r["word"])
    return pages(spark, d).filter("text is not null").select("doc_id", tx.without_lines_in(F.col("text"), words).alias("text"))


query("segmenter_texts", rf"select doc_id, regexp_replace(regexp_replace(text, '(?im)^[ \t]*(kateqoriya|istinadlar|qeydlər|əlavəədəbiyyat)\b.*$', ' ', 'g'), '(?i)\bkateqoriya\b\s*:\s*', ' ', 'g') as text from ({PAGES.removeprefix('pg as (').removesuffix(')')})")(
    lambda spark, d: pages(spark, d).select("doc_id", tx.segmenter_text(F.col("text")).alias("text"))
)


# ---- labels of stops
LABELS = f"{CORPUS_D}, {DOTS}, {RULE}, lb as (select doc_id, pos + case when pos % 7 = 0 then 1 else 0 end as place, eos from ru)"


def labels(spark, d):
    """Labels as a labeller might give them: those of the rule, every seventh place one too far."""
    at = F.col("char_index") + F.when(F.col("char_index") % 7 == 0, 1).otherwise(0)
    return ruled(spark, d).select("doc_id", at.alias("char_index"), "eos")


query("invalid_labels", f"with {LABELS} select doc_id, place::bigint as char_index, case when place >= length(text) then 'outside' else 'no stop' end as fault from lb join corpus_d using (doc_id) where place >= length(text) or text[place + 1] <> '.'")(
    lambda spark, d: boundaries.invalid_labels(labels(spark, d), short_docs(spark, d), "doc_id", "text")
)
query("labels_by_document", f"with {CORPUS_D}, {DOTS}, {RULE} select doc_id, array_to_string(list(pos order by pos), ' ') as places, sum(eos)::bigint as ends from ru group by doc_id")(
    lambda spark, d: boundaries.by_document(ruled(spark, d), "doc_id").select("doc_id", F.array_join(F.transform("labels", lambda x: x["char_index"].cast("string")), " ").alias("places"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda t, x: t + x["eos"]).alias("ends"))
)


@query("sentences_at_boundaries")
def sentences_at_boundaries(spark, d):
    """The documents split at the stops that the rule takes for ends, and at ! and ?."""
    ends = ruled(spark, d).filter("eos = 1").groupBy("doc_id").agg(F.collect_list("char_index").alias("ends"))
    rows = short_docs(spark, d).filter("text is not null").join(ends, "doc_id", "left")
    found = rows.select("doc_id", udfs.split_at(F.col("text"), F.coalesce("ends", F.array().cast("array<bigint>"))).alias("s"))
    return found.select("doc_id", F.posexplode("s").alias("k", "x")).select("doc_id", F.col("k").cast("bigint").alias("k"), "x.sentence", F.col("x.boundary").cast("bigint").alias("boundary"))


query("report_filter", "select doc_id, ticker, report_year::bigint as report_year from documents where contains(lower(coalesce(title, '')), 'a') and doc_kind in ('report', 'article') and lang = 'az'")(
    lambda spark, d: table(spark, d, "documents").filter(F.lower(F.coalesce("title", F.lit(""))).contains("a") & F.col("doc_kind").isin("report", "article") & (F.col("lang") == "az")).select("doc_id", "ticker", F.col("report_year").cast("bigint").alias("report_year"))
)
