"""Labels, bags of words, lexicon, naive Bayes in closed form, metrics and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.session import cut_lineage


def label(score: Column, mode: str) -> Column:
    """``sentiment3``: negative to 2, neutral 3, positive from 4; ``binary`` without 3; ``score5``: the number; else null."""
    s = score.cast("double")
    known = s.isin(1.0, 2.0, 3.0, 4.0, 5.0)
    if mode == "score5":
        return F.when(known, s.cast("bigint").cast("string"))
    middle = F.lit("neutral") if mode == "sentiment3" else F.lit(None).cast("string")
    return F.when(known, F.when(s <= 2, "negative").when(s >= 4, "positive").otherwise(middle))


def labelled(df: DataFrame, text: str, score: str, mode: str = "sentiment3") -> DataFrame:
    """Rows with a label and a text that is not blank."""
    return df.withColumn("label", label(F.col(score), mode)).filter(F.col("label").isNotNull() & F.coalesce(tx.collapsed(F.col(text)) != "", F.lit(False)))


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, label, split, token, tf)`` of stemmed words."""
    words = df.select(key, "label", "split", F.explode(tx.legacy_tokens(F.col(text))).alias("token"))
    return words.groupBy(key, "label", "split", "token").agg(F.count("*").alias("tf"))


def bag_vocabulary(train: DataFrame, least_df: int = 2, most: int | None = None) -> DataFrame:
    """``(token, tf, df)``: words in enough documents; the ``most`` frequent of them."""
    v = train.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).filter(F.col("df") >= least_df)
    return v.orderBy(F.desc("tf"), "token").limit(most) if most else v


def lexicon(train: DataFrame, least: int = 5, top: int = 200, alpha: float = 1.0) -> DataFrame:
    """``(token, weight)``: log ratio of a word's share in positive and in negative texts, the strongest of each side.

    Totals and vocabulary size are those of the words that are frequent enough.
    """
    side = F.when(F.col("label") == "positive", 1).when(F.col("label") == "negative", -1)
    c = train.filter(side.isNotNull()).groupBy("token").agg(F.sum(F.when(side == 1, F.col("tf")).otherwise(0)).alias("pos"), F.sum(F.when(side == -1, F.col("tf")).otherwise(0)).alias("neg")).filter(F.col("pos") + F.col("neg") >= least)
    total = c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    weight = F.ln((F.col("pos") + alpha) / (total["p"] + alpha * total["v"])) - F.ln((F.col("neg") + alpha) / (total["n"] + alpha * total["v"]))
    w = c.select("token", F.round(weight, 6).alias("weight"))
    return w.orderBy(F.desc("weight"), "token").limit(top).union(w.orderBy("weight", "token").limit(top)).distinct()


def lexicon_features(tokens: DataFrame, lex: DataFrame, key: str) -> DataFrame:
    """Eleven numbers a document; words outside the lexicon count for lengths alone."""
    j = tokens.join(lex, "token", "left")
    w = F.col("weight")
    pos, neg = F.when(w > 0, F.col("tf")).otherwise(0), F.when(w < 0, F.col("tf")).otherwise(0)
    rows = j.groupBy(key).agg(
        F.sum("tf").alias("n_tokens"), F.count("*").alias("n_types"), F.sum(pos).alias("n_positive"), F.sum(neg).alias("n_negative"),
        F.sum(F.when(w > 0, 1).otherwise(0)).alias("types_positive"), F.sum(F.when(w < 0, 1).otherwise(0)).alias("types_negative"),
        F.round(F.sum(F.coalesce(w.cast("decimal(18,6)") * F.col("tf"), F.lit(0).cast("decimal(18,6)"))), 4).cast("double").alias("sum_weight"), F.round(F.coalesce(F.max(w), F.lit(0.0)), 6).alias("max_weight"), F.round(F.coalesce(F.min(w), F.lit(0.0)), 6).alias("min_weight"),
    )
    return rows.withColumn("share_positive", F.round(F.col("n_positive") / F.col("n_tokens"), 6)).withColumn("share_negative", F.round(F.col("n_negative") / F.col("n_tokens"), 6))


def naive_bayes(train: DataFrame, test: DataFrame, vocab: DataFrame, key: str, alpha: float = 1.0, bernoulli: bool = False) -> DataFrame:
    """``(key, label, prediction, score)`` of the test documents, in closed form.

    Multinomial: log prior plus the sum of tf times log theta. Bernoulli: every word of the vocabulary counts, present or absent;
    the absent ones are a sum by class, from which the present ones are taken back, so no document meets the vocabulary.
    """
    docs = train.select(key, "label").distinct().groupBy("label").agg(F.count("*").alias("docs"))
    n = docs.agg(F.sum("docs")).first()[0] or 1
    v = vocab.count()
    value = F.lit(1) if bernoulli else F.col("tf")
    known = train.join(vocab.select("token"), "token")
    c = known.groupBy("label", "token").agg(F.sum(value).alias("c"))
    totals = c.groupBy("label").agg(F.sum("c").alias("t"))
    classes = docs.join(totals, "label", "left").na.fill(0, ["t"])
    grid = vocab.select("token").join(F.broadcast(classes), how="cross")  # classes: one row a label
    theta = grid.join(c, ["label", "token"], "left").na.fill(0, ["c"])
    if bernoulli:
        p = (F.col("c") + alpha) / (F.col("docs") + 2 * alpha)
        theta = theta.select("label", "token", (F.ln(p) - F.ln(1 - p)).alias("w"), F.ln(1 - p).alias("absent"))
        base = theta.groupBy("label").agg(F.sum("absent").alias("base"))
    else:
        theta = theta.select("label", "token", F.ln((F.col("c") + alpha) / (F.col("t") + alpha * v)).alias("w"))
        base = classes.select("label", F.lit(0.0).alias("base"))
    prior = classes.join(base, "label").select("label", (F.ln(F.col("docs") / F.lit(n)) + F.col("base")).alias("base"))
    docs_in = test.select(key, F.col("label").alias("truth")).distinct().join(F.broadcast(prior), how="cross")  # one row a label
    hits = test.select(key, "token", "tf").join(theta, "token").groupBy(key, "label").agg(F.sum(F.col("w") * (F.lit(1) if bernoulli else F.col("tf"))).alias("s"))
    scores = docs_in.join(hits, [key, "label"], "left").select(key, "truth", "label", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("score"))
    best = scores.groupBy(key, "truth").agg(F.max(F.struct(F.round("score", 6).alias("score"), F.col("label"))).alias("b"))
    return best.select(key, F.col("truth").alias("label"), F.col("b.label").alias("prediction"), F.round("b.score", 4).alias("score"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """``(label, support, precision, recall, f1)`` for every label or prediction that occurs; nothing to divide by gives 0."""
    c = confusion(predictions)
    names = c.select("label").union(c.select("prediction")).distinct()
    tp = c.filter("label = prediction").select("label", F.col("n").alias("tp"))
    rows = names.join(tp, "label", "left").join(c.groupBy("label").agg(F.sum("n").alias("support")), "label", "left").join(c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted")), "label", "left").na.fill(0)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select("label", "support", F.round(div(F.col("tp"), F.col("predicted")), 6).alias("precision"), F.round(div(F.col("tp"), F.col("support")), 6).alias("recall"), F.round(div(2 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"))


def overall_metrics(predictions: DataFrame) -> DataFrame:
    m = class_metrics(predictions)
    hits = predictions.agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("bigint")).alias("hits")).first()
    n = hits["n"] or 1
    return m.agg(F.lit(hits["n"]).alias("n"), F.lit(round((hits["hits"] or 0) / n, 6)).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))


def binary_metrics(predictions: DataFrame, positive: str) -> DataFrame:
    """``(tp, fp, fn, tn, precision, recall, f1)`` of one label against the others; nothing to divide by gives 0."""
    truth, found = F.col("label") == positive, F.col("prediction") == positive
    c = predictions.agg(F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"), F.count_if(~truth & ~found).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def mcnemar(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(only_a, only_b, n, p)``: documents that one model alone gets right; exact two-sided p of the binomial test.

    Terms are summed as logarithms over a range of at most min + 1 rows.
    """
    both = a.select(key, (F.col("label") == F.col("prediction")).alias("x")).join(b.select(key, (F.col("label") == F.col("prediction")).alias("y")), key)
    c = both.agg(F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))
    one = c.first()
    n, k = one["only_a"] + one["only_b"], min(one["only_a"], one["only_b"])
    if n == 0:
        p = 1.0
    else:
        from math import exp, lgamma, log

        p = min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(k + 1)))
    return c.select("only_a", "only_b", (F.col("only_a") + F.col("only_b")).alias("n"), F.round(F.lit(p + 1e-12), 6).alias("p"))


def model_pairs(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """``(model_a, model_b, only_a, only_b)`` of every two models, from one row a document with a prediction of each; one aggregation."""
    right = {m: F.coalesce(F.col(m) == F.col("label"), F.lit(False)) for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = wide.agg(*[c.alias(f"{side}{k}") for k, (a, b) in enumerate(pairs) for side, c in (("a", F.count_if(right[a] & ~right[b])), ("b", F.count_if(~right[a] & right[b])))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"a{k}").alias("only_a"), F.col(f"b{k}").alias("only_b")) for k, (a, b) in enumerate(pairs)])))


def winners(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """``(metric, model, value, note)``: the best model of each metric, the first name of equals."""
    long = wide.unpivot(["label"], list(models), "model", "prediction")
    c = cut_lineage(long.groupBy("model", "label", "prediction").agg(F.count("*").alias("n")))  # a row a model and two labels
    names = c.select("model", "label").union(c.select("model", "prediction")).distinct()
    each = names.alias("m").join(c.alias("c"), "model").groupBy("model", F.col("m.label").alias("name")).agg(
        F.sum(F.when((F.col("c.label") == F.col("m.label")) & (F.col("prediction") == F.col("m.label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("c.label") == F.col("m.label"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("prediction") == F.col("m.label"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    scores = each.groupBy("model").agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("tp") / (F.col("predicted") + F.col("support"))), 4).alias("macro_f1"))
    rows = scores.unpivot("model", ["accuracy", "macro_f1"], "metric", "value")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "model"))).filter("r = 1")
    return best.select("metric", "model", "value", F.concat(F.lit("best "), "metric", F.lit(": "), "model").alias("note"))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """``(name, p, rank, threshold, rejected)``: step-down; a test is rejected while all before it are."""
    m = tests.count()
    order = Window.orderBy(p, name)  # one row a comparison
    ranked = tests.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("threshold", F.lit(alpha) / (m - F.col("rank") + 1))
    ok = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("rejected", ok == 1).select(name, p, "rank", F.round("threshold", 6).alias("threshold"), "rejected")


def class_weights(df: DataFrame) -> DataFrame:
    """``(label, n, by_mean, by_total)``: inverse frequencies divided by their mean, and total / (labels * n)."""
    c = df.groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row a label
    inv = 1 / F.col("n")
    return c.select("label", "n", F.round(inv / F.avg(inv).over(w), 6).alias("by_mean"), F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("by_total"))


def logistic(train: DataFrame, test: DataFrame, key: str, text: str, l1: bool, c: float = 1.0, features: int = 1 << 16):
    """Balanced logistic regression over hashed stemmed words: ``(key, label, prediction)``; ``c`` is the inverse penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    weights = class_weights(train).select("label", "by_total")
    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    labels = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    prepared = lambda df: tf.transform(labels.setHandleInvalid("skip").transform(df.withColumn("words", tx.legacy_tokens(F.col(text)))))
    n = train.count()
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="by_total", elasticNetParam=1.0 if l1 else 0.0, regParam=1 / (c * max(n, 1)), maxIter=30).fit(prepared(train.join(F.broadcast(weights), "label")))
    names = F.array(*[F.lit(x) for x in labels.labels])
    return model.transform(prepared(test)).select(key, "label", F.get(names, F.col("prediction").cast("int")).alias("prediction"))
