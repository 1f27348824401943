"""Queries on n-grams, language models and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import udfs
from loomtext.functions.arrays import GLUE
from loomtext.operators import lm, spelling
from loomtext.plans.common import LINES, SPLIT, TOKENS, counts, docs, lm_split, sentences
from loomtext.session import cut_lineage, parallelism

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


G = "chr(1)"
TRAIN = f"{LINES}, {SPLIT}, st as (select s.*, split from s join sp using (doc_id)), trw as (select unnest(words) as token from st where split = 'train'), vo as (select token from trw group by token having count(*) >= 2)"
MAPPED = f"{TRAIN}, mw as (select sid, split, unnest(words) as token, generate_subscripts(words, 1) as k from st), ms as (select sid, split, list(coalesce(v.token, '<unk>') order by k) as words from mw left join vo v using (token) group by sid, split)"
GRAMS = "".join(
    f""", p{n} as (select sid, split, list_concat({[*['<s>'] * (n - 1)]}::varchar[], words, ['</s>']) as x from ms), g{n} as (select h, w, count(*) as c from (select split, unnest(list_transform(generate_series(1, len(x) - {n - 1}), lambda i: {{'h': array_to_string(x[i:i + {n - 2}], {G}), 'w': x[i + {n - 1}]}}), recursive := true) from p{n}) where split = 'train' group by h, w)"""
    for n in (1, 2, 3)
)
ALL = MAPPED + GRAMS


def mapped(spark, d):
    """Train and test sentences with rare words as ``<unk>``; neither is computed before it is used."""
    rows = cut_lineage(lm_split(spark, d))
    vocab = lm.vocabulary(rows.filter("split = 'train'"))
    return tuple(lm.in_vocabulary(rows.filter(F.col("split") == s), vocab) for s in ("train", "test"))


def train_counts(spark, d, n):
    return lm.counts(mapped(spark, d)[0], n)


query("ngram_counts", f"with {ALL} select 1::bigint as order_n, h, w, c from g1 union all select 2, h, w, c from g2 union all select 3, h, w, c from g3")(
    lambda spark, d: [lm.counts(t, 1).select(F.lit(1).cast("bigint").alias("order_n"), "h", "w", "c").unionByName(lm.counts(t, 2).select(F.lit(2).cast("bigint").alias("order_n"), "h", "w", "c")).unionByName(lm.counts(t, 3).select(F.lit(3).cast("bigint").alias("order_n"), "h", "w", "c")) for t in [mapped(spark, d)[0]]][0]
)
query("ngram_contexts", f"with {ALL} select h, sum(c)::bigint as total, count(*) as followers from g2 group by h")(lambda spark, d: lm.contexts(train_counts(spark, d, 2)))
query("ngram_continuations", f"with {ALL} select w, count(*) as cont from g2 group by w")(lambda spark, d: lm.continuations(train_counts(spark, d, 2)))
query("top_ngrams", f"with {ALL} select replace(h, {G}, ' ') || ' ' || w as ngram, c from g3 order by c desc, ngram limit 100")(lambda spark, d: train_counts(spark, d, 3).select(F.concat(F.replace("h", F.lit(GLUE), F.lit(" ")), F.lit(" "), "w").alias("ngram"), "c").orderBy(F.desc("c"), "ngram").limit(100))
query("lm_split_statistics", f"with {TRAIN} select split, count(*) as sentences, sum(len(words))::bigint as tokens, sum(len(words) + 1)::bigint as events from st group by split")(lambda spark, d: lm_split(spark, d).groupBy("split").agg(F.count("*").alias("sentences"), F.sum(F.size("words")).alias("tokens"), F.sum(F.size("words") + 1).alias("events")))


@query("oov_rate", f"with {TRAIN}, tw as (select unnest(words) as token from st where split = 'test') select count(*) as tokens, count_if(token not in (select token from trw))::bigint as oov, round(count_if(token not in (select token from trw)) / count(*), 6) as rate from tw")
def oov_rate(spark, d):
    """Test words that the train part does not have at all."""
    rows = cut_lineage(lm_split(spark, d))
    types = rows.filter("split = 'train'").select(F.explode("words").alias("token")).distinct().withColumn("known", F.lit(1))
    words = rows.filter("split = 'test'").select(F.explode("words").alias("token")).join(types, "token", "left")
    return words.agg(F.count("*").alias("tokens"), F.count_if(F.col("known").isNull()).alias("oov")).withColumn("rate", F.round(F.col("oov") / F.col("tokens"), 6))


EVENTS = f"""{ALL}, ct2 as (select h, sum(c) as n2, count(*) as t2 from g2 group by h), ct3 as (select h, sum(c) as n3, count(*) as t3 from g3 group by h), co as (select w, count(*) as cont from g2 group by w),
e0 as (select unnest(list_transform(generate_series(1, len(x) - 2), lambda i: {{'h2': x[i], 'h1': x[i + 1], 'w': x[i + 2]}}), recursive := true) from p3 where split = 'test'),
ev as (select coalesce(g3.c, 0) as c3, coalesce(n3, 0) as n3, coalesce(t3, 0) as t3, coalesce(g2.c, 0) as c2, coalesce(n2, 0) as n2, coalesce(t2, 0) as t2, coalesce(g1.c, 0) as c1, coalesce(cont, 0) as cont, (select sum(c) from g1) as n1, (select count(*) from g2) as b2, (select count(*) from g1) as v
 from e0 left join g3 on g3.h = h2 || {G} || h1 and g3.w = e0.w left join ct3 on ct3.h = h2 || {G} || h1 left join g2 on g2.h = h1 and g2.w = e0.w left join ct2 on ct2.h = h1 left join g1 on g1.w = e0.w left join co on co.w = e0.w)"""


def sql_probability(method, order, params):
    mle = lambda o: f"(case when n{o} > 0 then c{o} / n{o} else 0 end)"
    if method == "mle":
        return mle(order)
    if method == "laplace":
        k = params[2:]
        return f"((c{order} + {k}) / (n{order} + {k} * v))"
    if method == "interpolation":
        weights = [float(x) for x in params[2:].split("/")]
        return "(" + " + ".join(f"{w} / {sum(weights)} * {mle(o)}" for o, w in enumerate(weights, 1)) + ")"
    d = params[2:]
    p = mle(1) if method == "backoff" else "(cont / b2)"
    for o in range(2, order + 1):
        p = f"(case when n{o} > 0 then greatest(c{o} - {d}, 0) / n{o} + least(greatest({d} * t{o} / n{o}, 0), 1) * {p} else {p} end)"
    return p


GRID = " union all ".join(f"select '{m}' as method, {o}::bigint as order_n, '{s}' as params, {sql_probability(m, o, s)} as p from ev" for m, o, s, _ in ([] if F is None else [("mle", o, "", 0) for o in (1, 2, 3)] + [(m, o, f"{n}={v}", 0) for o in (2, 3) for m, n, vs in (("laplace", "k", (0.01, 0.1, 1.0)), ("backoff", "d", (0.5, 0.75)), ("kneser_ney", "d", (0.5, 0.75))) for v in vs] + [("interpolation", 2, "l=0.3/0.7", 0), ("interpolation", 2, "l=0.5/0.5", 0), ("interpolation", 3, "l=0.3/0.4/0.3", 0), ("interpolation", 3, "l=0.1/0.3/0.6", 0)]))
SCORES = f"{EVENTS}, gr as ({GRID}), sc as (select method, order_n, params, count(*) as events, count_if(p <= 0)::bigint as zero_events, count_if(p <= 0) > 0 as is_inf, case when count_if(p <= 0) = 0 then round(exp(-sum(case when p > 0 then ln(p) end) / count(*)), 4) end as perplexity from gr group by method, order_n, params)"
def scores(spark, d):
    return cut_lineage(lm.evaluated(lm.event_table(*mapped(spark, d))))


query("lm_grid", f"with {SCORES} select * from sc")(scores)
# ---- parameters are chosen on a dev part of the train sentences, methods are compared on the test part
DEV = MAPPED.replace("ms as (", "m0 as (") + """, dz as (select sid, words, row_number() over (order by md5(sid || '-43'), sid) as r, count(*) over () as n from m0 where split = 'train'),
dc as (select sid, words, case when r <= least(greatest(1, round_even(n * 0.1, 0)), n - 1) then 'test' else 'train' end as split from dz), cv as (select distinct unnest(words) as token from dc where split = 'train'),
dx as (select sid, split, unnest(words) as token, generate_subscripts(words, 1) as k from dc), ms as (select sid, split, list(coalesce(cv.token, '<unk>') order by k) as words from dx left join cv using (token) group by sid, split)"""
TRIED = " union all ".join(f"select '{m}' as method, {o}::bigint as order_n, '{s}' as params, {sql_probability(m, o, s)} as p from ev" for m, o, s in lm.tuning_names())
SCORED = "sc as (select method, order_n, params, count(*) as events, count_if(p <= 0)::bigint as zero_events, count_if(p <= 0) > 0 as is_inf, case when count_if(p <= 0) = 0 then round(exp(-sum(case when p > 0 then ln(p) end) / count(*)), 4) end as perplexity from gr group by method, order_n, params)"
TUNED = f"with {EVENTS.replace(MAPPED, DEV)}, gr as ({TRIED}), {SCORED} select * from sc"
TESTED = f"with {EVENTS}, gr as ({TRIED}), {SCORED} select * from sc"
CHOSEN = f"ch as (select order_n, method, params, perplexity as dev_perplexity from ({TUNED}) qualify row_number() over (partition by order_n, method order by is_inf, perplexity nulls last, zero_events, params) = 1), ts as ({TESTED}), se as (select ch.*, ts.perplexity as test_perplexity from ch join ts using (order_n, method, params))"
SIMPLE = "case {0} when 'laplace' then 1 when 'interpolation' then 2 when 'backoff' then 3 else 4 end"
RANKED = f"{CHOSEN}, rk as (select order_n, row_number() over (partition by order_n order by test_perplexity nulls last, dev_perplexity nulls last, {SIMPLE.format('method')}) as rank, method, params, dev_perplexity, test_perplexity from se)"


def tuned(spark, d):
    """Scores of all parameters on the dev part; its words that the rest of the train part has not are ``<unk>``."""
    train = cut_lineage(mapped(spark, d)[0])
    parts = cut_lineage(lm.dev_split(train, "sid"))
    core, dev = (parts.filter(F.col("split") == s).select("sid", "words") for s in ("train", "test"))
    dev = lm.in_vocabulary(dev, lm.vocabulary(core, 1))
    return cut_lineage(lm.evaluated_names(lm.event_table(core, dev), lm.tuning_names()))


def chosen(spark, d):
    """The best parameters of each method and order with their perplexity on the test part."""
    best = cut_lineage(lm.selected(tuned(spark, d)))
    names = {(r["method"], r["order_n"], r["params"]) for r in best.collect()}  # a row a method and order
    tested = lm.evaluated_names(lm.event_table(*mapped(spark, d)), [n for n in lm.tuning_names() if n in names])
    return cut_lineage(best.join(tested.select("order_n", "method", "params", F.col("perplexity").alias("test_perplexity")), ["order_n", "method", "params"]))


query("lm_tuning", TUNED)(tuned)
query("lm_ranking", f"with {RANKED} select * from rk")(lambda spark, d: lm.ranking(chosen(spark, d)))
query(
    "lm_winner",
    f"""with {RANKED}, tw as (select a.order_n, a.method as m1, b.method as m2, coalesce(abs(b.test_perplexity - a.test_perplexity) / greatest(a.test_perplexity, 1e-12) < 0.005, false) as near, a.dev_perplexity as d1, b.dev_perplexity as d2 from rk a left join rk b on a.order_n = b.order_n and b.rank = 2 where a.rank = 1),
ot as (select *, near and coalesce(d2 < d1 or (d2 = d1 and {SIMPLE.format('m2')} < {SIMPLE.format('m1')}), false) as other from tw) select order_n, case when other then m2 else m1 end as winner, case when other then m1 else m2 end as second, near as is_tie from ot""",
)(lambda spark, d: lm.winner(lm.ranking(chosen(spark, d))))


def last_lines(spark, d):
    """The last sentence of each document."""
    lines = sentences(spark, d).select("doc_id", F.substring_index("sid", "-", -1).cast("int").alias("k"), "words")
    return lines.groupBy("doc_id").agg(F.max_by("words", "k").alias("words"))


FOLLOW = ", ".join(f"f{w} as (select h, w, c, row_number() over (partition by h order by c desc, w) as rank from (select h, w, count(*) as c from (select unnest(list_transform(generate_series(1, len(words) - {w}), lambda i: {{'h': array_to_string(words[i:i + {w - 1}], {G}), 'w': words[i + {w}]}}), recursive := true) from tn where len(words) > {w}) group by h, w) qualify rank <= 3)" for w in (0, 1, 2))
query(
    "next_words_fallback",
    f"""with {LINES}, {SPLIT}, tn as (select words from s join sp using (doc_id) where split = 'train'), {FOLLOW}, la as (select doc_id, max_by(words, regexp_extract(sid, '-([0-9]+)$', 1)::int) as words from s group by doc_id),
x as (select doc_id, words[-1] as h1, case when len(words) >= 2 then array_to_string(words[-2:], {G}) end as h2 from la), y as (select *, exists (select 1 from f1 where f1.h = h1) as has1, h2 is not null and exists (select 1 from f2 where f2.h = h2) as has2 from x)
select doc_id, 1::bigint as order_n, false as is_fallback, rank, w, c from y, f0 union all select doc_id, 2, false, rank, w, c from y join f1 on f1.h = h1 union all select doc_id, 2, true, rank, w, c from y, f0 where not has1
union all select doc_id, 3, false, rank, w, c from y join f2 on f2.h = h2 union all select doc_id, 3, h2 is not null, rank, w, c from y join f1 on f1.h = h1 where not has2 union all select doc_id, 3, h2 is not null, rank, w, c from y, f0 where not has2 and not has1""",
)(lambda spark, d: lm.suggestions(last_lines(spark, d), lm_split(spark, d).filter("split = 'train'"), "doc_id"))
query("typing_help", r"select doc_id, case when regexp_matches(text, '\s$') then 'next_word' when length(w) < 3 then 'nothing' when length(w) <= 4 then 'spell_1' else 'spell_2' end as help from (select doc_id, text, regexp_extract(text, '[\p{L}\p{N}_''’\-]+$') as w from documents where text is not null)")(
    lambda spark, d: docs(spark, d).filter("text is not null").select("doc_id", lm.typing_help(F.col("text")).alias("help"))
)
query("next_words", f"with {LINES}, n as (select unnest(list_transform(generate_series(1, len(words) - 1), lambda i: {{'h': words[i], 'w': words[i + 1]}}), recursive := true) from s), c as (select h, w, count(*) as c from n group by h, w) select h, w, c, row_number() over (partition by h order by c desc, w) as rank from c qualify rank <= 3")(lambda spark, d: lm.next_words(lm_split(spark, d), 3))
KN = f"""with {ALL}, b as (select * from g2 where w <> '</s>'), t2 as (select h, sum(c) as n, count(*) as t from b group by h), co as (select w, count(*) as cont from b group by w), po as (select w from co order by cont desc, w limit 256),
ca as (select h, w from b union select h, w from t2, po), pr as (select ca.h, ca.w, greatest(coalesce(b.c, 0) - 0.75, 0) / n + 0.75 * t / n * coalesce(cont, 0) / (select count(*) from b) as p from ca join t2 on t2.h = ca.h left join b on b.h = ca.h and b.w = ca.w left join co on co.w = ca.w)
select h, row_number() over (partition by h order by round(p, 12) desc, w) as rank, w, round(p, 8) as p from pr qualify rank <= 3"""
query("next_words_kn", KN)(lambda spark, d: lm.next_words_kn(mapped(spark, d)[0], 3))
query("next_words_kn_head", f"select h, p from ({KN}) where rank = 1")(lambda spark, d: lm.next_words_kn(mapped(spark, d)[0], 3).filter("rank = 1").select("h", "p"))

# ---- spelling
ASKED = f"{TOKENS}, v as (select token, n from c where n >= 2 and length(token) >= 3 and regexp_full_match(token, '[a-zçəığöşüâ]+')), a as (select token as word from v where n between 10 and 20 and md5(token || '-1') < '4')"


def spell_tables(spark, d):
    """Every word of the vocabulary is asked. ``ASKED`` above, in SQL, asks a part of them only."""
    vocab = cut_lineage(counts(spark, d).filter((F.col("n") >= 2) & (F.length("token") >= 3) & F.col("token").rlike("^[a-zçəığöşüâ]+$")))
    return vocab.select(F.col("token").alias("word")), vocab


query("spell_suggest", f"with {ASKED}, k as (select word, token, n, levenshtein(translate(word, 'çəığöşüâ', '12345678'), translate(token, 'çəığöşüâ', '12345678')) as dist from a, v where abs(length(word) - length(token)) <= 2 and dist <= 2) select word, row_number() over (partition by word order by dist, n desc, token) as rank, token, dist, n from k qualify rank <= 5")(lambda spark, d: spelling.suggestions(*spell_tables(spark, d)))


@query("spell_accuracy")
def spell_accuracy(spark, d):
    """Words corrupted by hash, looked up again."""
    words, vocab = spell_tables(spark, d)
    pairs = cut_lineage(words.select(F.col("word").alias("right"), spelling.corrupted(F.col("word")).alias("wrong")))
    return spelling.accuracy(spelling.suggestions(pairs.select(F.col("wrong").alias("word")).distinct(), vocab), pairs)


@query("spell_expanded")
def spell_expanded(spark, d):
    words, vocab = spell_tables(spark, d)
    plain = words.select(F.translate("word", "çşğəöüı", "csgeoui").alias("word")).distinct()
    return spelling.expanded_suggestions(plain, vocab)


query("spell_variants")(lambda spark, d: spell_tables(spark, d)[0].repartition(parallelism(spark), "word").select("word", F.inline(udfs.variants()(F.col("word")))).select("word", "variant", F.col("edits").cast("bigint").alias("edits")))


@query("confusion_costs")
def confusion_costs(spark, d):
    words, _ = spell_tables(spark, d)
    return spelling.confusions(words.select(F.col("word").alias("right"), spelling.corrupted(F.col("word")).alias("wrong")))


@query("spell_weighted")
def spell_weighted(spark, d):
    """Suggestions ordered by a distance that costs less for common confusions."""
    words, vocab = spell_tables(spark, d)
    pairs = cut_lineage(words.select(F.col("word").alias("right"), spelling.corrupted(F.col("word")).alias("wrong")))
    costs = {(r["op"], r["a"], r["b"]): r["cost"] for r in spelling.confusions(pairs).collect()}  # at most a row a pair of letters
    close = spelling.close_words(pairs.select(F.col("wrong").alias("word")).distinct(), vocab, 2)
    weighted = close.withColumn("dist", F.round(udfs.weighted_levenshtein(costs, 2.0)(F.col("word"), F.col("token")), 6))
    return weighted.groupBy("word").agg(F.min(F.struct("dist", (-F.col("n")).alias("m"), "token")).alias("b")).select("word", "b.token", "b.dist")
