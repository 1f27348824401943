"""Words as numbers: vocabularies with ids, encoded and padded sequences, sampling tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD, UNKNOWN, FIRST = 0, 1, 2


def vocabulary(counts: DataFrame, least: int, most: int) -> DataFrame:
    """``(token, n, id)``: the ``most`` commonest words of ``least`` occurrences or more, ids from ``FIRST`` by count, then word."""
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + (FIRST - 1)).cast("bigint"))  # `most` rows


def encoded(df: DataFrame, words: str, vocab: DataFrame, length: int | None = None) -> DataFrame:
    """Adds ``ids`` and ``n``: each word's id (``UNKNOWN`` outside the vocabulary, also for a record without words).

    With ``length`` the ids are cut or filled with ``PAD`` to it; ``n`` is the number of real ones, the mask's length.
    The vocabulary is bounded by its own parameter and is looked up in Arrow batches.
    """
    listed = sorted((r["id"], r["token"]) for r in vocab.select("id", "token").collect())
    sent = df.sparkSession.sparkContext.broadcast([t for _, t in listed])
    at = df.columns.index(words)

    def run(batches):
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            lists = batch.column(at)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            flat = pc.fill_null(pc.add(pc.index_in(lists.flatten(), value_set=known), FIRST), UNKNOWN).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(offsets)
            start = offsets[:-1] - offsets[0]
            real = np.maximum(sizes, 1) if length is None else np.minimum(np.maximum(sizes, 1), length)
            width = real if length is None else np.full(len(sizes), length)
            ends = np.concatenate([[0], np.cumsum(width)])
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], width)
            owner = np.repeat(np.arange(len(sizes)), width)
            inside = place < np.minimum(sizes, real)[owner]
            ids = np.where(place < real[owner], UNKNOWN, PAD)
            ids[inside] = flat[(start[owner] + place)[inside]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(real)], names=[*batch.schema.names, "ids", "n"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]))


def sampling_table(counts: DataFrame, sample: float = 1e-3, power: float = 0.75) -> DataFrame:
    """``(token, n, keep, negative)``: the chance to keep an occurrence of a frequent word, and that to be drawn as a negative one."""
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(power))).alias("p")).first()
    if not total["n"]:
        return counts.select("token", "n", F.lit(1.0).alias("keep"), F.lit(0.0).alias("negative"))
    expected = F.lit(sample * total["n"])
    keep = F.least((F.sqrt(F.col("n") / expected) + 1) * expected / F.col("n"), F.lit(1.0))
    return counts.select("token", "n", F.round(keep, 8).alias("keep"), F.round(F.pow("n", F.lit(power)) / total["p"], 10).alias("negative"))


def sigmoid_table(spark, bins: int = 1000, most: float = 6.0) -> DataFrame:
    """``(bin, value)`` of the logistic function in ``bins`` steps over ``-most .. most``."""
    x = (F.col("id") / bins * 2 - 1) * most
    return spark.range(bins).select(F.col("id").alias("bin"), F.round(1 / (1 + F.exp(-x)), 8).alias("value"))
