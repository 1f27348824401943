"""Queries on corpus statistics, cleaning, boundaries, sampling and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import udfs
from loomtext.operators import boundaries, corpus, sampling
from loomtext.plans.common import TOKENS, WHITE, counts, docs, normal_sql, tokens_sql
from loomtext.session import cut_lineage, one_record, parallelism, spread, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("token_freq", f"with {TOKENS} select token, n, row_number() over (order by n desc, token) as rank from c qualify rank <= 1000")
def token_freq(spark, d):
    return corpus.zipf(counts(spark, d), 1000)


query("token_counts", f"with {TOKENS} select token, n from c")(lambda spark, d: counts(spark, d))
query("zipf_rank", f"with {TOKENS} select row_number() over (order by n desc, token) as rank, n from c qualify rank <= 200")(lambda spark, d: corpus.zipf(counts(spark, d), 200).select("rank", "n"))
query("corpus_summary", f"with {TOKENS} select (select count(*) from documents) as documents, sum(n)::bigint as tokens, count(*) as types from c")(lambda spark, d: corpus.summary(docs(spark, d), "doc_id", "text"))
query("vocab_filtered", f"with {TOKENS} select token, n from c where n >= 3 and length(token) >= 3 and regexp_full_match(token, '[{corpus.ALPHABET}]+')")(lambda spark, d: corpus.filtered(counts(spark, d), 3, None, 3))
query("vocab_spell", f"with {TOKENS} select token, n from c where n >= 2 and length(token) >= 3 and regexp_full_match(token, '\\p{{L}}+') and length(regexp_replace(token, '[^\\p{{Lu}}]', '', 'g')) / length(token) <= 0.6")(lambda spark, d: corpus.spelling_vocabulary(counts(spark, d)))
query("frequent_rare", f"with {TOKENS} select count_if(n >= 100) ::bigint as frequent, count_if(n <= 2)::bigint as rare from c")(lambda spark, d: counts(spark, d).agg(F.count_if(F.col("n") >= 100).alias("frequent"), F.count_if(F.col("n") <= 2).alias("rare")))

STEP = 1000
HEAPS = f"""p as (select doc_id, unnest({tokens_sql('text')}) as token, generate_subscripts({tokens_sql('text')}, 1) as k from documents), q as (select *, row_number() over (order by doc_id, k) as g from p),
f as (select token, min(g) as g from q group by token), tot as (select count(*) as n from q), st as (select unnest(generate_series(1, ((select n from tot) + {STEP - 1}) // {STEP})) as s),
h as (select least(s * {STEP}, (select n from tot)) as n, (select count(*) from f where g <= s * {STEP}) as v from st)"""
query("heaps_points", f"with {TOKENS}, {HEAPS} select n::bigint as n, v::bigint as v from h")(lambda spark, d: corpus.heaps(docs(spark, d), "doc_id", "text", STEP))
query("heaps_fit", f"with {TOKENS}, {HEAPS} select round(exp(regr_intercept(ln(v), ln(n))), 4) as k, round(regr_slope(ln(v), ln(n)), 6) as beta from h")(lambda spark, d: corpus.heaps_fit(corpus.heaps(docs(spark, d), "doc_id", "text", STEP)))

query("normalized_texts", f"select doc_id, {normal_sql('text')} as text from documents")(lambda spark, d: docs(spark, d).select("doc_id", tx.normalized(F.col("text")).alias("text")))
query("sentence_texts", f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{WHITE}*[;:]+{WHITE}*', ' ', 'g'), '\\({WHITE}*;{WHITE}*\\)', ' ', 'g'), '{WHITE}+', ' ', 'g')) as text from documents")(lambda spark, d: docs(spark, d).select("doc_id", tx.sentence_text(F.col("text")).alias("text")))
PAGES = "pg as (select distinct doc_id, title, text from corpus_pages)"
query("category_lines", f"with {PAGES} select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^\\s*(kateqoriya:|category:)')), chr(10)) as text from pg")(lambda spark, d: pages(spark, d).select("doc_id", tx.without_category_lines(F.col("text")).alias("text")))
query("templates_removed", f"with {PAGES} select doc_id, regexp_replace(regexp_replace(text, '\\{{\\{{[^}}]+\\}}\\}}', ' ', 'g'), '<[^>]+>', ' ', 'g') as text from pg")(lambda spark, d: pages(spark, d).select("doc_id", tx.without_templates(F.col("text")).alias("text")))
query("page_urls", f"with {PAGES} select doc_id, 'https://az.wikipedia.org/wiki/' || replace(title, ' ', '_') as url from pg")(lambda spark, d: pages(spark, d).select("doc_id", tx.page_url(F.col("title")).alias("url")))


def pages(spark, d):
    return one_record(table(spark, d, "corpus_pages").select("doc_id", "title", "text"), "doc_id")


@query(
    "cleaned_pages",
    rf"""with {PAGES}, l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^\s*(kateqoriya:|category:)')) as x from pg),
e as (select doc_id, x, list_position(list_transform(x, lambda y: regexp_extract(y, '^==\s*(.+?)\s*==\s*$', 1) in ('İstinadlar', 'References', 'Xarici keçidlər', 'External links', 'Qeydlər', 'Notes', 'See also')), true) as k from l),
b as (select doc_id, array_to_string(case when k > 0 then x[1:k - 1] else x end, chr(10)) as t from e)
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\{{\{{[^}}]+\}}\}}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '_+', ' ', 'g'), '{WHITE}+', ' ', 'g')) as text from b""",
)
def cleaned_pages(spark, d):
    return pages(spark, d).select("doc_id", tx.cleaned_page(F.col("text")).alias("text"))


query(
    "suffix_profile",
    f"""with {TOKENS}, w as (select token, n from c where regexp_full_match(token, '\\p{{L}}+')), e as (select k as length, right(token, k) as suffix, sum(n)::bigint as n from w, (select unnest([2, 3, 4]) as k) where length(token) >= k + 2 group by all)
select length::bigint as length, suffix, n, row_number() over (partition by length order by n desc, suffix) as rank from e qualify rank <= 15""",
)(lambda spark, d: corpus.suffixes(counts(spark, d)))
query("load_texts", f"select doc_id, length(text)::bigint as chars from documents where trim(regexp_replace(coalesce(text, ''), '{WHITE}+', ' ', 'g')) <> ''")(lambda spark, d: corpus.load_texts(docs(spark, d), "doc_id", "text").select("doc_id", F.length("text").cast("bigint").alias("chars")))
query("load_first_texts", f"select doc_id, length(text)::bigint as chars from documents where trim(regexp_replace(coalesce(text, ''), '{WHITE}+', ' ', 'g')) <> '' order by doc_id limit 50")(lambda spark, d: corpus.load_texts(docs(spark, d), "doc_id", "text", 50).select("doc_id", F.length("text").cast("bigint").alias("chars")))
query("partial_words", r"select doc_id, regexp_extract(text, '[\p{L}\p{N}_''’\-]+$') as word from documents where text is not null")(lambda spark, d: docs(spark, d).filter("text is not null").select("doc_id", tx.partial_word(F.col("text")).alias("word")))
query("filename_parts", r"select source, regexp_replace(regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as name from (select distinct source from documents where source is not null)")(lambda spark, d: docs(spark, d).filter("source is not null").select("source").distinct().select("source", tx.filename_part(F.col("source")).alias("name")))


@query("review_forms")
def review_forms(spark, d):
    return one_record(table(spark, d, "reviews").select("review_id", "content"), "review_id").select("review_id", tx.review_form(F.col("content")).alias("content"))


# ---- boundaries
DOTS = "dd as (select doc_id, text, p - 1 as pos, row_number() over (partition by doc_id order by p) - 1 as k from (select doc_id, text, unnest(list_filter(generate_series(1, length(text)), lambda p: text[p] = '.')) as p from corpus_d where contains(text, '.')))"
CORPUS_D = "corpus_d as (select distinct doc_idx as doc_id, text from corpus_docs)"


def short_docs(spark, d):
    return one_record(spread(table(spark, d, "corpus_docs")).select(F.col("doc_idx").alias("doc_id"), "text"), "doc_id")


@query(
    "dot_candidates",
    f"with {CORPUS_D}, {DOTS} select 'd' || doc_id || '_p' || pos as row_id, doc_id, k::bigint as dot_index, pos::bigint as char_index, case when pos > 0 then text[pos] else '' end as prev_char, coalesce(text[pos + 2], '') as next_char, text[greatest(pos - 40, 0) + 1:pos] as left_context, text[pos + 2:pos + 41] as right_context from dd",
)
def dot_candidates(spark, d):
    return boundaries.candidates(short_docs(spark, d), "doc_id", "text")


ABBR = ", ".join(repr(a) for a in sorted(udfs.ABBREVIATIONS))
CLOSERS_SQL = boundaries.CLOSERS.replace("'", "''")
OPENERS_SQL = boundaries.OPENERS.replace("'", "''")
SET_SQL = boundaries.regex_set(boundaries.OPENERS + boundaries.CLOSERS).replace("'", "''")
RULE = rf"""
x as (select doc_id, pos, text[1:pos] as l, text[pos + 2:] as r, case when pos > 0 then text[pos] else '' end as b, coalesce(text[pos + 2], '') as a from dd),
y as (select *, regexp_extract(l, '([^\s]*)$', 1) || '.' as w, regexp_extract(r, '^\s*([^\s])', 1) as f from x),
ru as (select doc_id, pos, case when (regexp_full_match(b, '\p{{Nd}}') and regexp_full_match(a, '\p{{Nd}}')) or (b not in ('', ' ') and a not in ('', ' ')) or regexp_full_match(b, '\p{{Lu}}')
 or lower(regexp_replace(regexp_replace(w, '^[{SET_SQL}]+|[{SET_SQL}]+$', '', 'g'), '[.,!?;:]+$', '')) in ({ABBR})
 or regexp_matches(w, '(?:^|[^\p{{L}}\p{{N}}_])[A-Z]\.[A-ZƏÖÜİĞÇŞ]') or regexp_full_match(f, '\p{{Ll}}') or (a <> '' and contains('{CLOSERS_SQL}', a)) then 0 else 1 end as eos from y)"""


def ruled(spark, d):
    rows = boundaries.words_around(boundaries.dots(short_docs(spark, d), "doc_id", "text"))
    return rows.select("doc_id", F.col("at").cast("bigint").alias("char_index"), boundaries.rule(rows).alias("eos"))


query("rule_eos", f"with {CORPUS_D}, {DOTS}, {RULE} select doc_id, pos::bigint as char_index, eos::bigint as eos from ru")(lambda spark, d: ruled(spark, d))
query("dot_features")(lambda spark, d: boundaries.features(short_docs(spark, d), "doc_id", "text"))
query(
    "dot_contexts",
    rf"""with {CORPUS_D}, {DOTS}, z as (select doc_id, pos, text[1:pos] as l, text[pos + 2:] as r from dd)
select doc_id, pos::bigint as char_index, regexp_extract(l, '([\p{{L}}\p{{N}}_''’\-]+)\s*$', 1)[1:40] as prev_token, regexp_extract(r, '^\s*([\p{{L}}\p{{N}}_''’\-]+)', 1)[1:40] as next_token, regexp_full_match(r, '\s*') as end_of_text_after_dot, contains(r[1:3], chr(10)) as line_break_after_dot from z""",
)(lambda spark, d: boundaries.features(short_docs(spark, d), "doc_id", "text").select("doc_id", "char_index", "prev_token", "next_token", "end_of_text_after_dot", "line_break_after_dot"))


def segment_rows(spark, d):
    rows = short_docs(spark, d).filter("text is not null").select("doc_id", udfs.segments(tx.sentence_text(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("sent_id", "sentence"))


query("sentence_segments")(lambda spark, d: segment_rows(spark, d).withColumn("sent_id", F.col("sent_id").cast("bigint")))


@query("boundary_metrics", f"""with {CORPUS_D}, {DOTS}, {RULE}, g as (select doc_id, pos from dd where regexp_matches(text[pos + 2:], '^\\s+\\p{{Lu}}') or regexp_full_match(text[pos + 2:], '\\s*')), j as (select f.pos as f, g.pos as g from (select * from ru where eos = 1) f full join g on f.doc_id = g.doc_id and f.pos = g.pos),
m as (select count_if(f is not null and g is not null) as tp, count_if(g is null) as fp, count_if(f is null) as fn from j)
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((fp + fn) / (tp + fn), 6) as error_rate from m""")
def boundary_metrics(spark, d):
    """The rule's stops against those before a capital or the end of the text."""
    rows = boundaries.words_around(boundaries.dots(short_docs(spark, d), "doc_id", "text"))
    gold = rows.filter(F.col("right").rlike(r"^\s+\p{Lu}") | (F.col("at") + 1 >= F.col("end"))).select("doc_id", F.col("at").cast("bigint").alias("char_index"))
    return boundaries.boundary_metrics(ruled(spark, d).filter("eos = 1"), gold, "doc_id", "char_index")


@query("labelled_pseudo_documents")
def labelled_pseudo_documents(spark, d):
    made = boundaries.labelled_documents(segment_rows(spark, d), "doc_id", "sent_id", 5)
    return made.select("doc", "text", F.array_join(F.transform("gold", lambda x: x.cast("string")), " ").alias("gold"))


# ---- sets and samples
query("lines_in_both_kinds", f"select count(*) as n from (select unnest(string_split(text, chr(10))) as l from documents where doc_kind = 'article' intersect select unnest(string_split(text, chr(10))) from documents where doc_kind = 'report')")(lambda spark, d: kind_lines(spark, d, "article").intersect(kind_lines(spark, d, "report")).agg(F.count("*").alias("n")))
query("lines_in_articles_alone", f"select count(*) as n from (select unnest(string_split(text, chr(10))) as l from documents where doc_kind = 'article' except select unnest(string_split(text, chr(10))) from documents where doc_kind = 'report')")(lambda spark, d: kind_lines(spark, d, "article").subtract(kind_lines(spark, d, "report")).agg(F.count("*").alias("n")))
query("texts_of_both_tables", "select origin, count(*) as n, count(distinct text) as texts from (select 'documents' as origin, text from documents union all select 'pages', text from corpus_pages) group by origin")(
    lambda spark, d: docs(spark, d).select(F.lit("documents").alias("origin"), "text").unionByName(table(spark, d, "corpus_pages").select(F.lit("pages").alias("origin"), "text")).groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
)


def kind_lines(spark, d, kind):
    return docs(spark, d).filter(F.col("doc_kind") == kind).select(F.explode(F.split("text", "\n")).alias("l"))


H = "md5(doc_id || '-{}')"
query("split_docs", f"select doc_id, case when row_number() over (order by {H.format(42)}, doc_id) <= greatest(1, round_even(count(*) over () * 0.2, 0)) then 'test' else 'train' end as split from documents")(lambda spark, d: sampling.split(docs(spark, d).select("doc_id"), "doc_id", 0.2, 42))
query("split_grouped", f"""with g as (select distinct source as doc_id from documents where source is not null), m as (select doc_id, row_number() over (order by {H.format(7)}, doc_id) as r, count(*) over () as n from g)
select d.doc_id, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'test' when r <= greatest(1, round_even(n * 0.1, 0)) + greatest(1, round_even(n * 0.2, 0)) then 'dev' else 'train' end as split from documents d join m on d.source = m.doc_id""")(lambda spark, d: sampling.three_way(docs(spark, d).select("doc_id", "source"), "source", (0.2, 0.1), 7).select("doc_id", "split"))
query("stratified_split", f"select doc_id, doc_kind, case when row_number() over (partition by doc_kind order by {H.format(3)}, doc_id) <= round_even(count(*) over (partition by doc_kind) * 0.25, 0) then 'validation' else 'train' end as split from documents where doc_kind is not null")(lambda spark, d: sampling.stratified(docs(spark, d).filter("doc_kind is not null").select("doc_id", "doc_kind"), "doc_id", "doc_kind", 0.25, 3).select("doc_id", "doc_kind", "split"))
query("sample_dots", f"""with s as (select doc_id, len(string_split(coalesce(text, ''), '.')) - 1 as k from documents), c as (select *, sum(k) over (order by {H.format(5)}, doc_id rows between unbounded preceding and 1 preceding) as b from s)
select doc_id, k::bigint as dots from c where coalesce(b, 0) < 2000""")(lambda spark, d: sampling.until(docs(spark, d).select("doc_id", (F.size(F.split(F.coalesce("text", F.lit("")), r"\.")) - 1).cast("bigint").alias("dots")), "doc_id", F.col("dots"), 2000, 5))
query("weighted_sample")(lambda spark, d: sampling.weighted(counts(spark, d), "token", "n", 500, 11))
query("simple_sample", f"select doc_id from documents qualify row_number() over (order by {H.format(9)}, doc_id) <= 100")(lambda spark, d: sampling.first_by_hash(docs(spark, d).select("doc_id"), "doc_id", 100, 9).filter("taken").select("doc_id"))

# ---- merges
MERGES = 5000
query("bpe_pairs", f"with {TOKENS}, v as (select token, n from c where n >= 2), y as (select list_concat(string_split(token, ''), ['</w>']) as s, n from v), z as (select unnest(list_zip(s[:-2], s[2:])) as p, n from y) select p[1] as a, p[2] as b, sum(n)::bigint as n from z group by all")(lambda spark, d: corpus.pair_counts(counts(spark, d).filter("n >= 2")))


@query("bpe_merges")
def bpe_merges(spark, d):
    merges = corpus.train_merges(counts(spark, d).filter("n >= 2"), MERGES)
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(merges)], "rank bigint, a string, b string")


@query("bpe_subwords")
def bpe_subwords(spark, d):
    words = cut_lineage(counts(spark, d))
    encode = udfs.merge_encoder(corpus.train_merges(words.filter("n >= 2"), MERGES))
    return words.repartition(parallelism(spark)).select("n", F.explode(encode(F.col("token"))).alias("subword")).groupBy("subword").agg(F.sum("n").alias("n"))
