"""Vectors trained from co-occurrence: weighted least squares, one side after the other.

The entries of a word lie together in one block (by hash). In half a round each block solves for its own words with the other
side's vectors fixed; as the table is symmetric, the same blocks serve both sides. What is sent to the executors is one vector
a word of the vocabulary, never the entries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import cut_lineage, parallelism


def solved(j: np.ndarray, x: np.ndarray, other: np.ndarray, x_max: float, alpha: float, ridge: float) -> np.ndarray:
    """One word's vector and bias (last) with the least weighted squared error against the fixed side's."""
    weight, fixed = np.minimum(1.0, (x / x_max) ** alpha), other[j]
    design = np.concatenate([fixed[:, :-1], np.ones((len(j), 1))], 1)
    weighted = design * weight[:, None]
    return np.linalg.solve(weighted.T @ design + ridge * np.eye(design.shape[1]), weighted.T @ (np.log(x) - fixed[:, -1]))


def half_round(entries: DataFrame, other: np.ndarray, x_max: float, alpha: float, ridge: float) -> np.ndarray:
    sent = entries.sparkSession.sparkContext.broadcast(other)

    def run(batches):
        for f in batches:
            yield pd.DataFrame({"i": f["i"], "v": [solved(np.asarray(j), np.asarray(x), sent.value, x_max, alpha, ridge).tolist() for j, x in zip(f["j"], f["x"], strict=True)]})

    out = np.zeros_like(other)
    for r in entries.mapInPandas(run, "i long, v array<double>").toPandas().itertuples():
        out[r.i] = r.v
    sent.destroy()
    return out


def train_vectors(cooc: DataFrame, counts: DataFrame, words: int | None = None, size: int = 32, rounds: int = 10, x_max: float = 10.0, alpha: float = 0.75, seed: int = 1, ridge: float = 0.1) -> DataFrame:
    """``(word, vec)`` of the words that have entries (of the ``words`` commonest, if given), and ``<unk>``, the mean of the hundred rarest."""
    spark = cooc.sparkSession
    top = counts.orderBy(F.desc("n"), "token").limit(words) if words else counts
    names = top.select("token", "n").toPandas().sort_values("token", ignore_index=True)
    if not len(names):
        return spark.createDataFrame([], "word string, vec array<double>")
    index = spark.createDataFrame(pd.DataFrame({"token": names["token"], "k": np.arange(len(names))}))
    side = lambda word, number: F.broadcast(index.withColumnsRenamed({"token": word, "k": number}))  # noqa: E731  (smaller than the vectors that are sent)
    coded = cooc.join(side("a", "i"), "a").join(side("b", "j"), "b").select("i", "j", F.col("x").cast("double").alias("x"))
    lists = coded.repartition(parallelism(spark), "i").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("e"))
    entries = cut_lineage(lists.select("i", F.col("e.j").alias("j"), F.col("e.x").alias("x")))
    context = (np.random.default_rng(seed).random((len(names), size + 1)) - 0.5) / size
    for _ in range(rounds):
        own = half_round(entries, context, x_max, alpha, ridge)
        context = half_round(entries, own, x_max, alpha, ridge)
    names = names.loc[np.sort(entries.select("i").toPandas()["i"])]
    if not len(names):
        return spark.createDataFrame([], "word string, vec array<double>")
    v = (own + context)[:, :-1]
    rare = names.sort_values(["n", "token"]).index[:100]
    return spark.createDataFrame(pd.DataFrame({"word": [*names["token"], "<unk>"], "vec": [*v[names.index].tolist(), v[rare].mean(0).tolist()]}), "word string, vec array<double>")
