"""Queries on rare words, ids, sampling tables, pieces of words, and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import sequences
from loomtext.plans.common import LINES, REVIEWS, TOKENS, counts, legacy_sql, reviews, sentences
from loomtext.session import cut_lineage

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("rarest_words", f"with {TOKENS} select token, n from c order by n, token limit 200")(lambda spark, d: counts(spark, d).orderBy("n", "token").limit(200))
query("single_words", f"with {TOKENS} select token from c where n = 1 order by token limit 200")(lambda spark, d: counts(spark, d).filter("n = 1").select("token").orderBy("token").limit(200))
query("sampling_table", f"with {TOKENS}, v as (select token, n from c where n >= 5), sm as (select sum(n) as s, sum(pow(n, 0.75)) as p from v) select token, n, round(least((sqrt(n / (0.001::double * s)) + 1) * (0.001::double * s) / n, 1), 8) as keep, round(pow(n, 0.75) / p, 10) as negative from v, sm")(
    lambda spark, d: sequences.sampling_table(cut_lineage(counts(spark, d).filter("n >= 5")))
)
query("sigmoid_table", "select i::bigint as bin, round(1 / (1 + exp(-(i / 1000 * 2 - 1) * 6)), 8) as value from (select unnest(generate_series(0, 999)) as i)")(lambda spark, d: sequences.sigmoid_table(spark))

LENGTH, MOST = 64, 20_000
ENCODED = f"""{REVIEWS}, rw as (select review_id, split, {legacy_sql('content')} as words from r), wc as (select token, count(*) as n from (select unnest(words) as token from rw where split = 'train') group by token having count(*) >= 2),
vo as (select token, n, row_number() over (order by n desc, token) + 1 as id from wc qualify id <= {MOST} + 1)"""


def review_vocabulary(spark, d):
    rows = cut_lineage(reviews(spark, d).select("review_id", "split", tx.legacy_tokens(F.col("content")).alias("words")))
    words = rows.filter("split = 'train'").select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return rows, cut_lineage(sequences.vocabulary(words, 2, MOST))


query("word_ids", f"with {ENCODED} select token, n, id::bigint as id from vo")(lambda spark, d: review_vocabulary(spark, d)[1])
query(
    "encoded_reviews",
    f"""with {ENCODED}, x as (select review_id, unnest(words) as token, generate_subscripts(words, 1) as k from rw), y as (select review_id, list(coalesce(id, 1) order by k) as ids from x left join vo using (token) group by review_id),
z as (select review_id, coalesce(ids, [1]) as ids from rw left join y using (review_id)), f as (select review_id, ids[1:{LENGTH}] as ids from z)
select review_id, array_to_string(list_concat(ids, list_transform(generate_series(1, {LENGTH} - len(ids)), lambda i: 0)), ' ') as ids, len(ids)::bigint as n from f""",
)(lambda spark, d: [sequences.encoded(rows, "words", vocab, LENGTH).select("review_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "n") for rows, vocab in [review_vocabulary(spark, d)]][0])


@query("morphology_summary")
def morphology_summary(spark, d):
    """Words, letters and pieces of words of the reviews, by label; pieces by merges learned on their words."""
    from loomtext.functions import udfs
    from loomtext.operators import corpus

    words = cut_lineage(reviews(spark, d).select("review_id", "label", F.explode(tx.tokens(F.col("content"))).alias("token")).groupBy("review_id", "label", "token").agg(F.count("*").alias("tf")))
    types = cut_lineage(words.groupBy("token").agg(F.sum("tf").alias("n")))
    encode = udfs.merge_encoder(corpus.train_merges(types.filter("n >= 2"), 5000))
    pieces = types.select("token", F.size(encode(F.col("token"))).alias("pieces"))
    by = words.join(pieces, "token").groupBy("review_id", "label").agg(F.sum("tf").alias("words"), F.sum(F.length("token") * F.col("tf")).alias("chars"), F.sum(F.col("pieces") * F.col("tf")).alias("pieces"))
    mean = lambda c: F.round(F.avg(c), 6)
    return by.groupBy("label").agg(F.count("*").alias("reviews"), mean("words").alias("words"), mean(F.col("chars") / F.col("words")).alias("chars_per_word"), mean("pieces").alias("pieces"), F.round(F.sum("pieces") / F.sum("words"), 6).alias("pieces_per_word"))


query("shuffled_lines", f"with {LINES} select sid, left(md5(sid || '-17'), 4) as place from s")(lambda spark, d: sentences(spark, d).select("sid", F.left(F.md5(F.concat("sid", F.lit("-17"))), F.lit(4)).alias("place")).orderBy("place", "sid"))

# ---- running best
MONTHS = f"{REVIEWS}, mo as (select source, strftime(posted_at, '%Y-%m') as month, avg(score) as mean from (select distinct review_id, source, score, posted_at from reviews) where score between 1 and 5 and posted_at is not null and source is not null group by all)"


@query(
    "running_best",
    f"""with {MONTHS}, b as (select *, max(mean) over (partition by source order by month rows between unbounded preceding and 1 preceding) as before from mo), c as (select *, before is null or mean > before as is_best from b),
g as (select *, sum(is_best::int) over (partition by source order by month) as grp from c), w as (select *, row_number() over (partition by source, grp order by month) - 1 as waited from g)
select source, month, round(mean, 6) as mean, is_best, waited::bigint as waited, max((waited >= 3)::int) over (partition by source order by month) = 1 as stopped from w""",
)
def running_best(spark, d):
    """Mean score of each source by month: whether it is the best so far, and whether three months without a better one have passed."""
    from loomtext.session import one_record, table

    rows = one_record(table(spark, d, "reviews").select("review_id", "source", "score", "posted_at"), "review_id").filter("score between 1 and 5 and posted_at is not null and source is not null")
    months = rows.groupBy("source", F.date_format("posted_at", "yyyy-MM").alias("month")).agg(F.avg("score").alias("mean"))
    return early_stops(months, "source", "month", "mean", 3).withColumn("mean", F.round("mean", 6))


def early_stops(df, group, order, value, patience):
    """Adds ``is_best`` (over all before), ``waited`` (rows since the last best) and ``stopped`` (from the first row that waited ``patience``)."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("is_best", before.isNull() | (F.col(value) > before)).withColumn("__g", F.sum(F.col("is_best").cast("int")).over(w))
    rows = rows.withColumn("waited", F.row_number().over(Window.partitionBy(group, "__g").orderBy(order)).cast("bigint") - 1)
    return rows.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(w) == 1).drop("__g")
