"""N-gram language models: one table of counts, one wide table of events, any number of smoothers in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import arrays as ar
from loomtext.session import cut_lineage


def vocabulary(sentences: DataFrame, least: int = 2) -> DataFrame:
    """``(token, n)`` of the words seen often enough."""
    return sentences.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


LISTED = 1_000_000  # words of a vocabulary up to which it is sent to the executors; beyond, words are joined with it


def in_vocabulary(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(sid, words)`` with words outside the vocabulary as ``<unk>``.

    A vocabulary of at most ``LISTED`` words is looked up in Arrow batches, and nothing is shuffled; a larger one is joined on
    the word, and the sentences are put back together by place.
    """
    known = cut_lineage(vocab.select("token"))
    if known.limit(LISTED + 1).count() <= LISTED:
        sent = sentences.sparkSession.sparkContext.broadcast([r["token"] for r in known.toLocalIterator()])

        def run(batches):
            listed = pa.array(sent.value, pa.string())
            for batch in batches:
                words = batch.column("words")
                flat = words.flatten()
                mapped = pc.if_else(pc.is_in(flat, value_set=listed), flat, pa.scalar("<unk>"))
                ends = pa.array(np.asarray(words.offsets) - np.asarray(words.offsets)[0])
                yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.ListArray.from_arrays(ends, mapped)], names=["sid", "words"])

        kept = sentences.select("sid", "words")
        return kept.mapInArrow(run, kept.schema)
    rows = sentences.select("sid", F.posexplode("words").alias("pos", "token"))
    known = rows.join(known.withColumn("v", F.col("token")), "token", "left")
    back = known.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("v", F.lit("<unk>")).alias("w")))).alias("x"))
    return back.select("sid", F.col("x.w").alias("words"))


def counts(sentences: DataFrame, n: int) -> DataFrame:
    """``(h, w, c)``: n-grams by history."""
    return sentences.select(F.inline(ar.ngrams(F.col("words"), n))).groupBy("h", "w").agg(F.count("*").alias("c"))


def contexts(ngrams: DataFrame) -> DataFrame:
    """``(h, total, followers)``."""
    return ngrams.groupBy("h").agg(F.sum("c").alias("total"), F.count("*").alias("followers"))


def continuations(bigrams: DataFrame) -> DataFrame:
    """``(w, cont)``: after how many different words a word stands."""
    return bigrams.groupBy("w").agg(F.count("*").alias("cont"))


def event_table(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every predicted word of the test sentences (equal events once, with ``times``) beside all counts that a smoother needs."""
    c1, c2, c3 = (cut_lineage(counts(train, n)) for n in (1, 2, 3))
    t2, t3, cont = contexts(c2), contexts(c3), continuations(c2)
    n = c1.agg(F.sum("c")).first()[0] or 0
    b2 = c2.count()
    v = c1.count()
    e = test.select(F.inline(ar.events(F.col("words")))).groupBy("h2", "h1", "w").agg(F.count("*").alias("times"))
    e = e.withColumn("h", F.concat("h2", F.lit(ar.GLUE), "h1"))
    e = e.join(c3.withColumnRenamed("c", "c3"), ["h", "w"], "left").join(t3.select("h", F.col("total").alias("n3"), F.col("followers").alias("t3")), "h", "left")
    e = e.join(c2.select(F.col("h").alias("h1"), "w", F.col("c").alias("c2")), ["h1", "w"], "left").join(t2.select(F.col("h").alias("h1"), F.col("total").alias("n2"), F.col("followers").alias("t2")), "h1", "left")
    e = e.join(c1.select("w", F.col("c").alias("c1")), "w", "left").join(cont, "w", "left")
    zero = [c for c in ("c3", "n3", "t3", "c2", "n2", "t2", "c1", "cont")]
    return e.na.fill(0, zero).select("times", *zero, F.lit(n).alias("n1"), F.lit(b2).alias("b2"), F.lit(v).alias("v"))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def mle(order: int) -> Column:
    return share(F.col(f"c{order}"), F.col(f"n{order}"))


def laplace(order: int, k: float) -> Column:
    return (F.col(f"c{order}") + F.lit(k)) / (F.col(f"n{order}") + F.lit(k) * F.col("v"))


def interpolation(order: int, weights: tuple[float, ...]) -> Column:
    """Weighted mean of the orders, weights of the lowest order first and made to sum to one."""
    total = sum(weights)
    p = sum((F.lit(w / total) * mle(o) for o, w in enumerate(weights[:order], 1)), F.lit(0.0))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def discounted(order: int, d: float, base: Column) -> Column:
    """Absolute discounting down to ``base``; a history never seen leaves all to the lower order."""
    p = base
    for o in range(2, order + 1):
        c, n, t = F.col(f"c{o}"), F.col(f"n{o}"), F.col(f"t{o}")
        rest = F.least(F.greatest(F.lit(d) * t / n, F.lit(0.0)), F.lit(1.0))
        p = F.when(n > 0, F.greatest(c - F.lit(d), F.lit(0.0)) / n + rest * p).otherwise(p)
    return p


def backoff(order: int, d: float) -> Column:
    return discounted(order, d, mle(1))


def kneser_ney(order: int, d: float) -> Column:
    """As backoff, but the lowest order counts the words before; higher orders use raw counts."""
    return discounted(order, d, F.when(F.col("b2") > 0, F.col("cont") / F.col("b2")).otherwise(mle(1)))


def models() -> list[tuple[str, int, str, Column]]:
    """The grid: (method, order, parameters, probability)."""
    out = [("mle", o, "", mle(o)) for o in (1, 2, 3)]
    for o in (2, 3):
        out += [("laplace", o, f"k={k}", laplace(o, k)) for k in (0.01, 0.1, 1.0)]
        out += [("backoff", o, f"d={d}", backoff(o, d)) for d in (0.5, 0.75)]
        out += [("kneser_ney", o, f"d={d}", kneser_ney(o, d)) for d in (0.5, 0.75)]
    out += [("interpolation", 2, f"l={a}/{b}", interpolation(2, (a, b))) for a, b in ((0.3, 0.7), (0.5, 0.5))]
    out += [("interpolation", 3, f"l={a}/{b}/{c}", interpolation(3, (a, b, c))) for a, b, c in ((0.3, 0.4, 0.3), (0.1, 0.3, 0.6))]
    return out


def tuning_names() -> list[tuple[str, int, str]]:
    """All parameters that are tried on the dev part; interpolation weights are the points of the simplex in steps of a tenth."""
    tried = {"laplace": ("k", (0.01, 0.05, 0.1, 0.5, 1.0)), "backoff": ("d", (0.1, 0.3, 0.5, 0.75)), "kneser_ney": ("d", (0.5, 0.75, 1.0))}
    out = [(method, o, f"{name}={v}") for o in (2, 3) for method, (name, values) in tried.items() for v in values]
    two = [(10 - i, i) for i in range(11)]
    three = [(10 - i - j, j, i) for i in range(11) for j in range(11 - i)]
    return out + [("interpolation", len(point), "l=" + "/".join(str(t / 10) for t in point)) for point in two + three]


def evaluated_names(events: DataFrame, names: list[tuple[str, int, str]]) -> DataFrame:
    """As ``evaluated``, for many parameters of few methods: they are columns beside each event, so that the plan does not grow with them."""

    def row(method: str, order: int, params: str):
        values = [float(x) for x in params.partition("=")[2].split("/")]
        weights = [v / sum(values) for v in values] + [0.0] * (3 - len(values))
        return F.struct(F.lit(method).alias("method"), F.lit(order).cast("bigint").alias("order_n"), F.lit(params).alias("params"), F.lit(values[0]).alias("x"), *[F.lit(w).alias(f"l{o}") for o, w in enumerate(weights, 1)])

    rows = events.select("*", F.inline(F.array(*[row(*name) for name in names])))
    x, method = F.col("x"), F.col("method")
    either = lambda f: F.when(F.col("order_n") == 2, f(2, x)).otherwise(f(3, x))
    mixed = F.least(F.greatest(sum((F.col(f"l{o}") * mle(o) for o in (1, 2, 3)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = rows.select("times", "method", "order_n", "params", F.when(method == "laplace", either(laplace)).when(method == "backoff", either(backoff)).when(method == "kneser_ney", either(kneser_ney)).otherwise(mixed).alias("p"))
    sums = rows.groupBy("method", "order_n", "params").agg(F.sum("times").alias("events"), F.sum(F.when(F.col("p") > 0, 0).otherwise(F.col("times"))).alias("zero_events"), F.sum(F.when(F.col("p") > 0, F.ln("p") * F.col("times")).otherwise(0.0)).alias("l"))
    return sums.select("method", "order_n", "params", "events", "zero_events", (F.col("zero_events") > 0).alias("is_inf"), F.when(F.col("zero_events") == 0, F.round(F.exp(-F.col("l") / F.col("events")), 4)).alias("perplexity"))


def evaluated(events: DataFrame, grid=None) -> DataFrame:
    """``(method, order_n, params, events, zero_events, is_inf, perplexity)``: the whole grid in one aggregation, then unfolded."""
    grid = grid or models()
    sums = []
    for i, (_, _, _, p) in enumerate(grid):
        sums += [F.sum(F.when(p > 0, F.ln(p) * F.col("times")).otherwise(0.0)).alias(f"l{i}"), F.sum(F.when(p > 0, 0).otherwise(F.col("times"))).alias(f"z{i}")]
    one = events.agg(F.sum("times").alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(o).cast("bigint").alias("order_n"), F.lit(s).alias("params"), F.col(f"l{i}").alias("l"), F.col(f"z{i}").alias("zero_events")) for i, (m, o, s, _) in enumerate(grid)]))
    out = one.select("n", rows.alias("x")).select("x.*", F.col("n").alias("events"))
    return out.select("method", "order_n", "params", "events", "zero_events", (F.col("zero_events") > 0).alias("is_inf"), F.when(F.col("zero_events") == 0, F.round(F.exp(-F.col("l") / F.col("events")), 4)).alias("perplexity"))


def dev_split(sentences: DataFrame, key: str, share: float = 0.1, seed: int = 43) -> DataFrame:
    """``split``: test for the dev part (``max(1, round(n * share))`` sentences by hash order, never all of them), else train."""
    from loomtext.operators.sampling import first_by_hash

    n = sentences.count()
    return first_by_hash(sentences, key, min(max(1, round(n * share)), n - 1), seed).withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


COMPLEXITY = {"laplace": 1, "interpolation": 2, "backoff": 3, "kneser_ney": 4}


def selected(dev: DataFrame) -> DataFrame:
    """The best parameters of each method and order on the dev part."""
    best = Window.partitionBy("order_n", "method").orderBy(F.col("is_inf"), F.col("perplexity").asc_nulls_last(), "zero_events", "params")
    return dev.withColumn("r", F.row_number().over(best)).filter("r = 1").select("order_n", "method", "params", F.col("perplexity").alias("dev_perplexity"))


def ranking(chosen: DataFrame) -> DataFrame:
    """``chosen`` (with ``test_perplexity``; null is infinite) ranked within the order; ties by dev perplexity, then by the simpler method."""
    simple = F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv])[F.col("method")]
    order = Window.partitionBy("order_n").orderBy(F.col("test_perplexity").asc_nulls_last(), F.col("dev_perplexity").asc_nulls_last(), simple)
    return chosen.withColumn("rank", F.row_number().over(order).cast("bigint")).select("order_n", "rank", "method", "params", "dev_perplexity", "test_perplexity")


def winner(ranked: DataFrame, tie: float = 0.005) -> DataFrame:
    """The best method of each order; within ``tie`` of the second, dev perplexity decides, then the simpler method."""
    simple = F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv])
    two = ranked.filter("rank <= 2").groupBy("order_n").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("method", "dev_perplexity", "test_perplexity")])
    near = F.coalesce(F.abs(F.col("test_perplexity2") - F.col("test_perplexity1")) / F.greatest("test_perplexity1", F.lit(1e-12)) < tie, F.lit(False))
    other = near & F.coalesce((F.col("dev_perplexity2") < F.col("dev_perplexity1")) | ((F.col("dev_perplexity2") == F.col("dev_perplexity1")) & (simple[F.col("method2")] < simple[F.col("method1")])), F.lit(False))
    return two.select("order_n", F.when(other, F.col("method2")).otherwise(F.col("method1")).alias("winner"), F.when(other, F.col("method1")).otherwise(F.col("method2")).alias("second"), near.alias("is_tie"))


def followers(train: DataFrame, width: int, top: int) -> DataFrame:
    """``(h, items)``: the ``top`` commonest followers ``(c, w)`` of every ``width`` words; no boundary signs. Width 0: of nothing."""
    n = F.size("words") - width
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice("words", i, width), ar.GLUE).alias("h"), F.element_at("words", i + width).alias("w")))
    c = train.filter(n > 0).select(F.inline(at)).groupBy("h", "w").agg(F.count("*").alias("c"))
    order = Window.partitionBy("h").orderBy(F.desc("c"), "w")
    if not width:  # one history: the top comes before the window
        c = c.orderBy(F.desc("c"), "w").limit(top)
    ranked = c.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "c"))).alias("items"))


def suggestions(contexts: DataFrame, train: DataFrame, key: str, top: int = 3) -> DataFrame:
    """``(key, order_n, is_fallback, rank, w, c)``: followers of the last words of ``contexts.words``, longer histories falling back to shorter ones."""
    one, two, three = (followers(train, width, top).withColumnRenamed("items", f"i{width}") for width in (0, 1, 2))
    last = lambda n: F.when(F.size("words") >= n, F.array_join(F.slice("words", -n, n), ar.GLUE))
    rows = contexts.filter(F.size("words") > 0).select(key, last(1).alias("h1"), last(2).alias("h2"))
    rows = rows.join(two.withColumnRenamed("h", "h1"), "h1", "left").join(three.withColumnRenamed("h", "h2"), "h2", "left").join(F.broadcast(one.select("i0")))  # one row
    second = F.coalesce("i1", "i0")
    kinds = F.array(
        F.struct(F.lit(1).cast("bigint").alias("order_n"), F.lit(False).alias("is_fallback"), F.col("i0").alias("items")),
        F.struct(F.lit(2).cast("bigint").alias("order_n"), F.col("i1").isNull().alias("is_fallback"), second.alias("items")),
        F.struct(F.lit(3).cast("bigint").alias("order_n"), (F.col("h2").isNotNull() & F.col("i2").isNull()).alias("is_fallback"), F.coalesce(F.col("i2"), second).alias("items")),
    )
    return rows.select(key, F.inline(kinds)).select(key, "order_n", "is_fallback", F.inline("items"))


def next_words(train: DataFrame, top: int) -> DataFrame:
    """``(h, rank, w, c)``: the commonest followers of every word."""
    pairs = train.select(F.explode(F.arrays_zip(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))).alias("h"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("w"))).alias("x"))
    c = pairs.groupBy(F.col("x.h").alias("h"), F.col("x.w").alias("w")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("h").orderBy(F.desc("c"), "w")
    return c.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)


def next_words_kn(train: DataFrame, top: int, d: float = 0.75, pool: int = 256) -> DataFrame:
    """``(h, rank, w, p)``: followers of every word by Kneser-Ney probability.

    Candidates of a history are its followers and the ``pool`` words with most continuations; of the second, only as many can
    matter as are asked for, and for one history they are in the same order, so each history meets ``top`` plus its
    followers' overlap instead of the whole pool.
    """
    c2 = cut_lineage(counts(train, 2).filter("w <> '</s>'"))
    t2 = contexts(c2)
    b2 = c2.count()
    cont = continuations(c2)
    wide = cont.orderBy(F.desc("cont"), "w").limit(pool)
    direct = c2.join(t2, "h").join(cont, "w").select("h", "w", (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total") + F.lit(d) * F.col("followers") / F.col("total") * F.col("cont") / b2).alias("p"))
    order = Window.partitionBy("h").orderBy(F.desc("p"), "w")
    head = direct.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")
    words = [(r["w"], r["cont"]) for r in wide.orderBy(F.desc("cont"), "w").collect()]  # at most `pool` rows
    pooled = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("cont")) for w, c in words]) if words else None
    if pooled is None:
        return head.select("h", F.lit(1).cast("bigint").alias("rank"), "w", "p")
    followers = c2.groupBy("h").agg(F.collect_set(F.when(F.col("w").isin([w for w, _ in words]), F.col("w"))).alias("seen"))  # at most `pool` words
    others = t2.join(followers, "h").select("h", "followers", "total", F.explode(F.slice(F.filter(pooled, lambda x: ~F.array_contains("seen", x["w"])), 1, top)).alias("x"))
    others = others.select("h", F.col("x.w").alias("w"), (F.lit(d) * F.col("followers") / F.col("total") * F.col("x.cont") / b2).alias("p"))
    ranked = head.unionByName(others).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("h", "rank", "w", F.round("p", 8).alias("p"))


def typing_help(text: Column) -> Column:
    """What a typing assistant should do with what is typed so far."""
    from loomtext.functions.text import partial_word

    word = partial_word(text)
    return F.when(text.rlike(r"\s$"), "next_word").when(F.length(word) < 3, "nothing").when(F.length(word) <= 4, "spell_1").otherwise("spell_2")
