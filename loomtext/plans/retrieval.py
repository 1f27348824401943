"""Queries on chunks, retrieval, answers, joins and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import udfs
from loomtext.operators import retrieval, vectors
from loomtext.plans.common import WHITE, docs
from loomtext.session import one_record, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NONSPACE = r"([^\p{Z}\t\n\v\f\r\x{85}]+)"
CHUNKS = f"""w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{NONSPACE}') as w from documents), n as (select doc_id, w, len(w) as n from w where len(w) >= 50),
k as (select *, ceil(n / 120)::int as lo, (n // 50)::int as hi, greatest(round_even(n / 100, 0), 1)::int as tg from n), c as (select *, least(greatest(tg, lo), hi) as c from k where lo <= hi),
b as (select *, n // c as base, n % c as extra from c), f as (select * from b where base >= 50 and base + case when extra > 0 then 1 else 0 end <= 120),
ch as (select doc_id, w, i as chunk_id, i * base + least(i, extra) as start, base + case when i < extra then 1 else 0 end as size from f, lateral (select unnest(generate_series(0, c - 1)) as i))"""
query("chunks", f"with {CHUNKS} select doc_id, chunk_id::bigint as chunk_id, size::bigint as token_count, array_to_string(w[start + 1:start + size], ' ') as text from ch")(lambda spark, d: retrieval.chunks(docs(spark, d), "doc_id", "text", 50, 120, 100))
query("chunk_profile", f"with {CHUNKS} select count(*) as chunks, count(distinct doc_id) as documents, min(size)::bigint as least, max(size)::bigint as most, round(avg(size), 6) as mean from ch")(
    lambda spark, d: retrieval.chunks(docs(spark, d), "doc_id", "text", 50, 120, 100).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 6).alias("mean"))
)

HITS = "hs as (select a.vec_id as q, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 qualify rank <= 3)"


def hits(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return vectors.asked(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e, "vec_id", "embedding", 3)


query("retrieve_topk", f"with {HITS} select q, rank, vec_id, similarity from hs")(hits)
query("eval_records", f"with {HITS}, s as (select q, rank, 'class_' || label as source from hs join embeddings using (vec_id)), u as (select q, source, min(rank) as r from s group by q, source) select q, (select count(*) from hs where hs.q = u.q) as hits, count(*) as sources, string_agg(source, ' | ' order by r) as sources_text from u group by q")(
    lambda spark, d: retrieval.nested(hits(spark, d).join(table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("class_"), F.col("label")).alias("source")), "vec_id"), "q", "source")
)
PAIRED = "select text as baseline, case when doc_kind = 'qa' then title else text end as answer, case when source is null then null when doc_kind = 'review' then [] else [source, lang] end as sources from documents"


def paired(spark, d):
    rows = table(spark, d, "documents")
    answer = F.when(F.col("doc_kind") == "qa", F.col("title")).otherwise(F.col("text"))
    sources = F.when(F.col("source").isNotNull(), F.when(F.col("doc_kind") == "review", F.array().cast("array<string>")).otherwise(F.array("source", "lang")))
    return rows.select(F.col("text").alias("baseline"), answer.alias("answer"), sources.alias("sources"))


query("rag_metrics", f"""with p as ({PAIRED}), x as (select len(regexp_extract_all(coalesce(baseline, ''), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) as a, len(regexp_extract_all(coalesce(answer, ''), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) as b, coalesce(len(sources), 0) as n from p)
select count(*) as questions, round(avg(case when a > 0 then 1.0 else 0.0 end), 6) as baseline_rate, round(avg(case when b > 0 then 1.0 else 0.0 end), 6) as answer_rate, round(avg(a), 6) as baseline_words, round(avg(b), 6) as answer_words, round(avg(b) / avg(a), 6) as ratio, round(avg(n), 6) as sources_each, round(avg(case when n > 0 then 1.0 else 0.0 end), 6) as sources_rate, (select count(distinct s) from (select unnest(sources) as s from p) where s <> '') as unique_sources from x""")(lambda spark, d: retrieval.answer_metrics(paired(spark, d)))
REPORTS = r"rp as (select doc_id, regexp_replace(regexp_replace(trim(ticker), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') || '_' || report_year as base from documents where ticker is not null and report_year is not null and trim(regexp_replace(coalesce(text, ''), 'WHITE+', ' ', 'g')) <> ''), nm as (select doc_id, base || case when row_number() over (partition by base order by doc_id) > 1 then '_' || row_number() over (partition by base order by doc_id) else '' end || '.txt' as name from rp)".replace("WHITE", WHITE)
query("duplicate_suffix", f"with {REPORTS} select doc_id, name from nm")(lambda spark, d: retrieval.file_names(table(spark, d, "documents"), "doc_id", "ticker", "report_year", "text"))
query("file_name_parts", rf"with {REPORTS} select name, regexp_extract(name, '^(.+?)_(\d{{4}})(?:_\d+)?\.txt$', 1) as ticker, regexp_extract(name, '^(.+?)_(\d{{4}})(?:_\d+)?\.txt$', 2)::bigint as year from nm")(
    lambda spark, d: retrieval.file_names(table(spark, d, "documents"), "doc_id", "ticker", "report_year", "text").select("name", tx.ticker_of(F.col("name")).alias("ticker"), tx.year_of(F.col("name")).cast("bigint").alias("year"))
)

# ---- question answering
SQUAD = "sq as (select distinct on (question_id) * from squad_examples)"


def squad(spark, d):
    return one_record(table(spark, d, "squad_examples"), "question_id")


WORDS_SQL = f"regexp_extract_all(context, '{NONSPACE}')"
query("qa_windows", f"with {SQUAD}, w as (select question_id, {WORDS_SQL} as w from sq where context is not null and len({WORDS_SQL}) > 0) select question_id, s * 32 as start, len(w[s * 32 + 1:s * 32 + 64])::bigint as size, array_to_string(w[s * 32 + 1:s * 32 + 64], ' ') as words from w, lateral (select unnest(generate_series(0, ceil(greatest(len(w) - 64, 0) / 32)::int)) as s)")(
    lambda spark, d: retrieval.word_windows(squad(spark, d).select("question_id", F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1)).alias("w")), "question_id", "w", 64, 32).withColumn("window_words", F.array_join("window_words", " ")).withColumnRenamed("window_words", "words")
)


def answer_rows(spark, d):
    a = squad(spark, d).select("question_id", F.posexplode(F.arrays_zip("answers", "answer_starts")).alias("answer_no", "x"))
    return a.select("question_id", F.col("answer_no").cast("bigint").alias("answer_no"), F.col("x.answer_starts").alias("start_char"), (F.col("x.answer_starts") + F.length("x.answers")).alias("end_char")).filter("start_char is not null and end_char > start_char")


@query("answer_word_span")
def answer_word_span(spark, d):
    """First and last word of each answer, by overlap of places."""
    spans = squad(spark, d).filter("context is not null").select("question_id", udfs.words_with_places(F.col("context")).alias("words"))
    return retrieval.answer_words(spans, answer_rows(spark, d), "question_id")


query("answer_texts", f"with {SQUAD}, a as (select question_id, unnest(answers) as a, unnest(answer_starts) as s, context from sq) select question_id, count(*) as answers, count_if(substr(context, s + 1, length(a)) = a)::bigint as placed from a group by question_id")(
    lambda spark, d: squad(spark, d).select("question_id", "context", F.explode(F.arrays_zip("answers", "answer_starts")).alias("x")).groupBy("question_id").agg(F.count("*").alias("answers"), F.count_if(F.substring(F.col("context"), F.col("x.answer_starts") + 1, F.length("x.answers")) == F.col("x.answers")).alias("placed"))
)
PUNCT = tx.PUNCTUATION.replace("'", "''")


def form_sql(x):
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(replace({x}, 'İ', 'i̇')), '{PUNCT}', ''), '{WHITE}+', ' ', 'g')), ' '), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"


query("qa_em_f1", f"""with {SQUAD}, e as (select question_id, {form_sql("coalesce(question, '')")} as p, {form_sql("coalesce(g, '')")} as g from (select question_id, question, unnest(case when len(answers) > 0 then answers else [''] end) as g from sq)),
t as (select *, list_filter(string_split(p, ' '), lambda w: w <> '') as pw, list_filter(string_split(g, ' '), lambda w: w <> '') as gw from e),
f as (select *, coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0) as c from t)
select question_id, max(case when p = g then 1 else 0 end)::bigint as em, round(max(case when len(pw) = 0 and len(gw) = 0 then 1.0::double when len(pw) + len(gw) = 0 then 0 else 2.0::double * c / (len(pw) + len(gw)) end), 6) as f1 from f group by question_id""")(lambda spark, d: retrieval.exact_and_f1(squad(spark, d), "question_id", "question", "answers"))
LOGITS = "lg as (select vec_id, unnest(embedding)::double as s, generate_subscripts(embedding, 1) - 1 as pos, unnest(list_reverse(embedding))::double as e from embeddings)"


def logits(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("s"), F.reverse("embedding").alias("e"))).alias("pos", "x"))
    return e.select("vec_id", "pos", F.col("x.s").cast("double").alias("start_logit"), F.col("x.e").cast("double").alias("end_logit"))


query("qa_span", f"with {LOGITS} select a.vec_id, a.pos::bigint as start, b.pos::bigint as end, round(a.s + b.e, 6) as score from lg a join lg b on a.vec_id = b.vec_id and b.pos >= a.pos and b.pos - a.pos < 8 qualify row_number() over (partition by a.vec_id order by a.s + b.e desc, a.pos, b.pos) = 1")(lambda spark, d: retrieval.best_spans(logits(spark, d), "vec_id", 8))
query("qa_best_window", "with s as (select vec_id % 50 as question, vec_id as start, embedding[1]::double as score from embeddings) select question, start, score from s qualify row_number() over (partition by question order by score desc, start) = 1")(
    lambda spark, d: retrieval.best_windows(table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("question"), F.col("vec_id").alias("start"), F.col("embedding")[0].cast("double").alias("score")), "question")
)

# ---- joins and time
query("vector_store_join", "select r_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name is not null group by r_name")(
    lambda spark, d: table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
)
query("session_markdown", "with q as (select distinct question_id, title, question, answers from squad_examples) select title, string_agg('## ' || coalesce(question, '') || chr(10) || chr(10) || coalesce(answers[1], ''), chr(10) || chr(10) order by question_id) as markdown from q group by title")(lambda spark, d: sessions(spark, d))
REPORT = "select 'corpus' as section, 'documents' as name, count(*)::varchar as value from documents union all select 'corpus', 'sources', count(distinct source)::varchar from documents union all select 'kinds', coalesce(doc_kind, 'none'), count(*)::varchar from documents group by doc_kind union all select 'reviews', coalesce(split_name, 'none'), count(distinct review_id)::varchar from reviews group by split_name"
query("report_markdown", f"with x as ({REPORT}), y as (select section, string_agg('- ' || name || ': ' || value, chr(10) order by name) as body from x group by section) select string_agg('## ' || section || chr(10) || chr(10) || body, chr(10) || chr(10) order by section) as markdown from y")(lambda spark, d: report(spark, d))


def report(spark, d):
    """Counts of the tables as one report."""
    from loomtext.sources import sinks

    documents, reviews = table(spark, d, "documents"), table(spark, d, "reviews")
    row = lambda section, name, value: [F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value")]
    counts = documents.agg(F.count("*").alias("a"), F.count_distinct("source").alias("b"))
    parts = [counts.select(*row("corpus", F.lit("documents"), F.col("a"))), counts.select(*row("corpus", F.lit("sources"), F.col("b")))]
    parts.append(documents.groupBy("doc_kind").count().select(*row("kinds", F.coalesce("doc_kind", F.lit("none")), F.col("count"))))
    parts.append(reviews.groupBy("split_name").agg(F.count_distinct("review_id").alias("n")).select(*row("reviews", F.coalesce("split_name", F.lit("none")), F.col("n"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return sinks.report_markdown(rows)


def sessions(spark, d):
    """Each title's questions and first answers as one text, in order of the question ids; at most some questions a title."""
    part = F.concat(F.lit("## "), F.coalesce("question", F.lit("")), F.lit("\n\n"), F.coalesce(F.try_element_at("answers", F.lit(1)), F.lit("")))
    rows = squad(spark, d).groupBy("title").agg(F.sort_array(F.collect_list(F.struct("question_id", part.alias("t")))).alias("x"))
    return rows.select("title", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("markdown"))


@query("daily_documents", "select strftime(date_trunc('day', fetched_at at time zone 'UTC'), '%Y-%m-%d') as day, count(*) as documents from documents where fetched_at is not null group by 1")
def daily_documents(spark, d):
    """Documents by day; the batch twin of the stream's windows."""
    days = table(spark, d, "documents").filter("fetched_at is not null").groupBy(F.window("fetched_at", "1 day").alias("w")).agg(F.count("*").alias("documents"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "documents")


@query("prompts", "select question_id, 'Context: ' || coalesce(context, '') || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:' as prompt from (select distinct question_id, context, question from squad_examples)")
def prompts(spark, d):
    made = tx.prompt("Context: {context}\nQuestion: {question}\nAnswer:", context=F.col("context"), question=F.col("question"))
    return squad(spark, d).select("question_id", made.alias("prompt"))
