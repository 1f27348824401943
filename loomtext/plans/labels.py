"""Queries on labelled reviews: words, lexicon, naive Bayes, metrics, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import sentiment
from loomtext.plans.common import REVIEW_TOKENS, REVIEWS, review_tokens, reviews
from loomtext.session import cut_lineage

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("labelled_reviews", f"with {REVIEWS} select review_id, label, split from r")(lambda spark, d: reviews(spark, d).select("review_id", "label", "split"))
query("label_counts", f"with {REVIEWS} select split, label, count(*) as n from r group by split, label")(lambda spark, d: reviews(spark, d).groupBy("split", "label").agg(F.count("*").alias("n")))
query("review_words", f"with {REVIEW_TOKENS} select review_id, token, tf from tt")(lambda spark, d: review_tokens(spark, d).select("review_id", "token", "tf"))
BAG = f"{REVIEW_TOKENS}, bv as (select token, sum(tf)::bigint as tf, count(*) as df from tt where split = 'train' group by token having count(*) >= 2 order by tf desc, token limit 3000)"
query("bag_vocabulary", f"with {BAG} select * from bv")(lambda spark, d: sentiment.bag_vocabulary(review_tokens(spark, d).filter("split = 'train'"), 2, 3000))
LEX = f"""{REVIEW_TOKENS}, lc as (select token, coalesce(sum(case when label = 'positive' then tf end), 0) as p, coalesce(sum(case when label = 'negative' then tf end), 0) as n from tt where split = 'train' and label in ('positive', 'negative') group by token having sum(tf) >= 5),
lt as (select sum(p) as sp, sum(n) as sn, count(*) as v from lc), lw as (select token, round(ln((p + 1) / (sp + v)) - ln((n + 1) / (sn + v)), 6) as weight from lc, lt),
lx as ((select * from lw order by weight desc, token limit 200) union (select * from lw order by weight, token limit 200))"""
query("lexicon", f"with {LEX} select token, weight from lx")(lambda spark, d: sentiment.lexicon(review_tokens(spark, d).filter("split = 'train'")))


@query(
    "lexicon_features",
    f"""with {LEX}, j as (select review_id, tf, weight as w from tt left join lx using (token))
select review_id, sum(tf)::bigint as n_tokens, count(*) as n_types, coalesce(sum(case when w > 0 then tf end), 0)::bigint as n_positive, coalesce(sum(case when w < 0 then tf end), 0)::bigint as n_negative, coalesce(count_if(w > 0), 0)::bigint as types_positive, coalesce(count_if(w < 0), 0)::bigint as types_negative,
round(coalesce(sum(w::decimal(18,6) * tf), 0), 4)::double as sum_weight, round(coalesce(max(w), 0), 6) as max_weight, round(coalesce(min(w), 0), 6) as min_weight, round(coalesce(sum(case when w > 0 then tf end), 0) / sum(tf), 6) as share_positive, round(coalesce(sum(case when w < 0 then tf end), 0) / sum(tf), 6) as share_negative from j group by review_id""",
)
def lexicon_features(spark, d):
    t = review_tokens(spark, d)
    return sentiment.lexicon_features(t, sentiment.lexicon(t.filter("split = 'train'")), "review_id")


def nb_sql(bernoulli):
    c = "count(*)" if bernoulli else "sum(tf)"
    theta = "(coalesce(c, 0) + 1) / (docs + 2)" if bernoulli else "(coalesce(c, 0) + 1) / (t + (select count(*) from bv))"
    w = "ln(th) - ln(1 - th)" if bernoulli else "ln(th)"
    base = "+ (select sum(ln(1 - th)) from ta where ta.label = dc.label)" if bernoulli else ""
    value = "1" if bernoulli else "tf"
    return f"""{BAG}, dc as (select label, count(distinct review_id) as docs from tt where split = 'train' group by label), kc as (select label, token, {c} as c from tt join bv using (token) where split = 'train' group by label, token) """.replace("join bv using (token)", "semi join bv using (token)") + f""", kt as (select label, sum(c) as t from kc group by label),
ta as (select dc.label, bv.token, {theta} as th from dc cross join bv left join kt on kt.label = dc.label left join kc on kc.label = dc.label and kc.token = bv.token),
pb as (select label, ln(docs / (select sum(docs) from dc)) {base} as base from dc), td as (select distinct review_id, label as truth from tt where split = 'test'),
hs as (select x.review_id, ta.label, sum(({w}) * {value}) as s from tt x join ta on ta.token = x.token where x.split = 'test' group by x.review_id, ta.label),
sc as (select td.review_id, truth, pb.label, round(base + coalesce(s, 0), 6) as score from td cross join pb left join hs on hs.review_id = td.review_id and hs.label = pb.label),
nb as (select review_id, truth as label, label as prediction, round(score, 4) as score from sc qualify row_number() over (partition by review_id order by score desc, label desc) = 1)"""


MULTI, BERN = nb_sql(False), nb_sql(True)


def bayes(spark, d, bernoulli=False):
    t = review_tokens(spark, d)
    train, test = t.filter("split = 'train'"), t.filter("split = 'test'")
    return cut_lineage(sentiment.naive_bayes(train, test, cut_lineage(sentiment.bag_vocabulary(train, 2, 3000)), "review_id", bernoulli=bernoulli))


query("nb_multinomial", f"with {MULTI} select * from nb")(lambda spark, d: bayes(spark, d))
query("nb_bernoulli", f"with {BERN} select * from nb")(lambda spark, d: bayes(spark, d, True))
query("confusion_matrix", f"with {MULTI} select label, prediction, count(*) as n from nb group by label, prediction")(lambda spark, d: sentiment.confusion(bayes(spark, d)))
query("confusion_pivot", f"with {MULTI} select label, count_if(prediction = 'negative')::bigint as negative, count_if(prediction = 'neutral')::bigint as neutral, count_if(prediction = 'positive')::bigint as positive from nb group by label")(
    lambda spark, d: sentiment.confusion(bayes(spark, d)).groupBy("label").pivot("prediction", ["negative", "neutral", "positive"]).agg(F.sum("n")).na.fill(0)
)
CLASSES = "nm as (select label from nb union select prediction from nb), cm as (select label, (select count(*) from nb where nb.label = nm.label) as support, (select count(*) from nb where prediction = nm.label) as predicted, (select count(*) from nb where prediction = nm.label and nb.label = nm.label) as tp from nm), ce as (select label, support, round(case when predicted > 0 then tp / predicted else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(case when predicted + support > 0 then 2 * tp / (predicted + support) else 0 end, 6) as f1 from cm)"
query("class_metrics", f"with {MULTI}, {CLASSES} select * from ce")(lambda spark, d: sentiment.class_metrics(bayes(spark, d)))
query("overall_metrics", f"with {MULTI}, {CLASSES} select (select count(*) from nb) as n, (select round(count_if(label = prediction) / count(*), 6) from nb) as accuracy, round(avg(f1), 4) as macro_f1, round(sum(f1 * support) / sum(support), 4) as weighted_f1 from ce")(lambda spark, d: sentiment.overall_metrics(bayes(spark, d)))
query("metrics_long", f"with {MULTI}, {CLASSES} select label, 'precision' as metric, precision as value from ce union all select label, 'recall', recall from ce union all select label, 'f1', f1 from ce")(lambda spark, d: sentiment.class_metrics(bayes(spark, d)).unpivot("label", ["precision", "recall", "f1"], "metric", "value"))


query("binary_metrics", f"with {MULTI}, m as (select coalesce(count_if(label = 'positive' and prediction = 'positive'), 0) as tp, coalesce(count_if(label <> 'positive' and prediction = 'positive'), 0) as fp, coalesce(count_if(label = 'positive' and prediction <> 'positive'), 0) as fn, coalesce(count_if(label <> 'positive' and prediction <> 'positive'), 0) as tn from nb) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from m")(
    lambda spark, d: sentiment.binary_metrics(bayes(spark, d), "positive")
)
MODES = "with r0 as (select distinct review_id, content, score, split_name from reviews), "
query("label_modes", MODES + "l as (select 'score5' as mode, score::varchar as label from r0 where score between 1 and 5 union all select 'binary', case when score <= 2 then 'negative' else 'positive' end from r0 where score in (1, 2, 4, 5)) select mode, label, count(*) as n from l group by mode, label")(lambda spark, d: label_modes(spark, d))


def label_modes(spark, d):
    """Labels by the two further ways to read a score."""
    from loomtext.session import one_record, table

    rows = one_record(table(spark, d, "reviews").select("review_id", "content", "score", "split_name"), "review_id")
    kinds = [rows.select(F.lit(mode).alias("mode"), sentiment.label(F.col("score"), mode).alias("label")) for mode in ("score5", "binary")]
    return kinds[0].unionByName(kinds[1]).filter("label is not null").groupBy("mode", "label").agg(F.count("*").alias("n"))


@query("mcnemar", f"select count_if(a and not b)::bigint as only_a, count_if(b and not a)::bigint as only_b, count_if(a <> b)::bigint as n from (select review_id, label = prediction as a from (with {MULTI} select * from nb)) x join (select review_id, label = prediction as b from (with {BERN} select * from nb)) y using (review_id)")
def mcnemar(spark, d):
    return sentiment.mcnemar(bayes(spark, d), bayes(spark, d, True), "review_id").drop("p")


WIDE = f"""pa as (with {MULTI} select review_id, label, prediction from nb), pb as (with {BERN} select review_id, prediction from nb), ma as (with {REVIEWS}, q as (select label, count(*) as n from r where split = 'train' group by label) select label from q order by n desc, label limit 1),
wide as (select review_id, pa.label, pa.prediction as nb_multinomial, pb.prediction as nb_bernoulli, (from ma) as majority from pa join pb using (review_id))"""
MODELS = ("majority", "nb_bernoulli", "nb_multinomial")


def predictions(spark, d):
    """One row a test review with the prediction of each model."""
    train = reviews(spark, d).filter("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    most = train.orderBy(F.desc("n"), "label").first()
    both = bayes(spark, d).select("review_id", "label", F.col("prediction").alias("nb_multinomial")).join(bayes(spark, d, True).select("review_id", F.col("prediction").alias("nb_bernoulli")), "review_id")
    return cut_lineage(both.withColumn("majority", F.lit(most["label"] if most else None).cast("string")))


query("model_predictions", f"with {WIDE} select * from wide")(predictions)
query(
    "model_pairs",
    f"with {WIDE} " + " union all ".join(f"select '{a}' as model_a, '{b}' as model_b, count_if({a} = label and {b} <> label)::bigint as only_a, count_if({a} <> label and {b} = label)::bigint as only_b from wide" for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]),
)(lambda spark, d: sentiment.model_pairs(predictions(spark, d), MODELS))
SCORE_ROWS = " union all ".join(f"select '{m}' as model, label, {m} as prediction from wide" for m in MODELS)
query(
    "model_winners",
    f"""with {WIDE}, lo as ({SCORE_ROWS}), nm as (select model, label from lo union select model, prediction from lo), ce as (select model, label, count_if(l.label = nm.label and prediction = nm.label) as tp, count_if(l.label = nm.label) as support, count_if(prediction = nm.label) as predicted from nm join lo l using (model) group by model, nm.label),
f as (select model, round(avg(2 * tp / (predicted + support)), 4) as macro_f1, round(sum(tp) / sum(support), 6) as accuracy from ce group by model), m as (select model, 'accuracy' as metric, accuracy as value from f union all select model, 'macro_f1', macro_f1 from f)
select metric, model, value, 'best ' || metric || ': ' || model as note from m qualify row_number() over (partition by metric order by value desc, model) = 1""".replace("select model, label, count_if(l.label", "select model, nm.label, count_if(l.label"),
)(lambda spark, d: sentiment.winners(predictions(spark, d), MODELS))
P_VALUE = "least(1, 2 * list_sum(list_transform(generate_series(0, least(only_a, only_b)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))))"


@query("mcnemar_p", f"with x as ({SQL['mcnemar']}) select only_a, only_b, n, round(case when n = 0 then 1 else {P_VALUE} end + 1e-12, 6) as p from x")
def mcnemar_p(spark, d):
    return sentiment.mcnemar(bayes(spark, d), bayes(spark, d, True), "review_id")


TESTS = "select doc_kind as name, round(count_if(length(text) % 7 = 0) / count(*) / 10, 6) as p from documents where doc_kind is not null group by doc_kind"


@query("holm", f"with x as ({TESTS}), y as (select *, row_number() over (order by p, name) as rank, count(*) over () as m from x), z as (select *, 0.05 / (m - rank + 1) as th from y) select name, p, rank, round(th, 6) as threshold, bool_and(p <= th) over (order by p, name rows unbounded preceding) as rejected from z")
def holm(spark, d):
    """Step-down over a p for each kind of document."""
    from loomtext.session import table

    p = F.round(F.count_if(F.length("text") % 7 == 0) / F.count("*") / 10, 6)
    tests = table(spark, d, "documents").filter("doc_kind is not null").groupBy(F.col("doc_kind").alias("name")).agg(p.alias("p"))
    return sentiment.holm(tests, "name", "p")


query("class_weights", f"with {REVIEWS}, c as (select label, count(*) as n from r where split = 'train' group by label) select label, n, round((1 / n) / avg(1 / n) over (), 6) as by_mean, round(sum(n) over () / (count(*) over () * n), 6) as by_total from c")(lambda spark, d: sentiment.class_weights(reviews(spark, d).filter("split = 'train'")))


@query("best_per_source", f"with {REVIEWS}, c as (select source, label, count(*) as n from r group by source, label) select source, label, n from c qualify row_number() over (partition by source order by n desc, label) = 1")
def best_per_source(spark, d):
    """The commonest label of each source, the first of equals."""
    c = reviews(spark, d).groupBy("source", "label").agg(F.count("*").alias("n"))
    best = c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("source", "b.label", (-F.col("b.m")).alias("n"))


def regression(spark, d, l1):
    rows = reviews(spark, d).select("review_id", "content", "label", "split")
    return sentiment.logistic(cut_lineage(rows.filter("split = 'train'")), rows.filter("split = 'test'"), "review_id", "content", l1, features=1 << 14)


query("logreg_l1")(lambda spark, d: regression(spark, d, True))
query("logreg_l2")(lambda spark, d: regression(spark, d, False))
