"""Splits and samples by hash order: the same rows in any engine, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.session import cut_lineage


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def first_by_hash(df: DataFrame, key: str, count: int, seed: int, mark: str = "taken") -> DataFrame:
    """Marks the ``count`` rows that come first by hash, exactly.

    Rows are counted by the first three digits of the hash (4,096 rows come to the driver); whole prefixes are in or out and
    only the one at the border is ranked.
    """
    hashed = df.withColumn("__h", hash_key(key, seed)).withColumn("__p", F.left("__h", F.lit(3)))
    left, border = count, None
    for row in sorted(hashed.groupBy("__p").count().collect(), key=lambda r: r["__p"]):
        if row["count"] > left:
            border = row["__p"]
            break
        left -= row["count"]
    if border is None:
        return hashed.withColumn(mark, F.lit(True)).drop("__h", "__p")
    order = Window.partitionBy("__p").orderBy("__h", key)
    edge = hashed.filter(F.col("__p") == border).withColumn(mark, F.row_number().over(order) <= left)
    rest = hashed.filter(F.col("__p") != border).withColumn(mark, F.col("__p") < border)
    return rest.unionByName(edge).drop("__h", "__p")


def split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``split``: train or test; the test part has ``max(1, round(n * share))`` rows, halves to even."""
    n = df.count()
    return first_by_hash(df, key, max(1, round(n * share)) if n else 0, seed).withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def three_way(df: DataFrame, key: str, shares: tuple[float, float], seed: int) -> DataFrame:
    """``split``: train, dev or test by hash order of the groups, so that a group stays whole."""
    groups = cut_lineage(df.select(key).distinct())
    n = groups.count()
    test = max(1, round(n * shares[1])) if n else 0
    dev = max(1, round(n * shares[0])) if n else 0
    marked = first_by_hash(groups, key, test, seed, "in_test")
    marked = first_by_hash(marked, key, test + dev, seed, "in_dev")
    return df.join(marked, key).withColumn("split", F.when(F.col("in_test"), "test").when(F.col("in_dev"), "dev").otherwise("train")).drop("in_test", "in_dev")


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """``split``: train or validation, with ``round(n * share)`` rows of each label in the second, by hash order.

    Counts by label and hash prefix (4,096 at most a label) say which prefixes are in; only a label's prefix at the border is ranked.
    """
    hashed = df.withColumn("__h", hash_key(key, seed)).withColumn("__p", F.left("__h", F.lit(3)))
    by: dict = {}
    for r in hashed.groupBy(label, "__p").count().collect():
        by.setdefault(r[label], []).append((r["__p"], r["count"]))
    plan = []
    for name, sizes in by.items():
        left = round(sum(n for _, n in sizes) * share)
        for prefix, n in sorted(sizes):
            plan.append((name, prefix, n if n <= left else left))
            left -= min(n, left)
    kinds = T.StructType([df.schema[label], T.StructField("__p", T.StringType()), T.StructField("__in", T.LongType())])
    marked = hashed.alias("a").join(df.sparkSession.createDataFrame(plan, kinds).alias("b"), F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}")) & (F.col("a.__p") == F.col("b.__p"))).select("a.*", "b.__in")
    order = Window.partitionBy(label, "__p").orderBy("__h", key)  # a 4,096th of a label
    ranked = marked.withColumn("__r", F.row_number().over(order))
    return ranked.withColumn("split", F.when(F.col("__r") <= F.col("__in"), "validation").otherwise("train")).drop("__h", "__p", "__in", "__r")


def until(df: DataFrame, key: str, size: Column, target: int, seed: int) -> DataFrame:
    """Whole rows in hash order until their sizes reach the target.

    Sums by the first three digits of the hash say which prefixes are taken whole; only the border is summed row by row.
    """
    rows = df.withColumn("__s", size).withColumn("__h", hash_key(key, seed)).withColumn("__p", F.left("__h", F.lit(3)))
    sums, left, border = rows.groupBy("__p").agg(F.sum("__s").alias("s")).collect(), target, None
    for row in sorted(sums, key=lambda r: r["__p"]):
        if row["s"] >= left:
            border = row["__p"]
            break
        left -= row["s"]
    if border is None:
        return rows.drop("__s", "__h", "__p")
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__p").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.filter(F.col("__p") == border).withColumn("__b", before).filter(F.col("__b") < left).drop("__b")
    return rows.filter(F.col("__p") < border).unionByName(edge).drop("__s", "__h", "__p")


def weighted(counts: DataFrame, token: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``(draw, token)``: with replacement, by weight; draw ``i`` is the hash of ``i`` in [0, total).

    Weights are summed by 256 buckets of the token's hash; a draw finds its bucket by range among those and its token
    within the bucket.
    """
    spark = counts.sparkSession
    rows = counts.select(F.col(token).alias("token"), F.col(weight).cast("bigint").alias("w"), F.left(F.md5(token), F.lit(2)).alias("b"))
    rows = rows.withColumn("hi", F.sum("w").over(Window.partitionBy("b").orderBy("token"))).withColumn("lo", F.col("hi") - F.col("w"))
    rows = cut_lineage(rows)
    buckets, at = [], 0
    for r in sorted(rows.groupBy("b").agg(F.sum("w").alias("w")).collect(), key=lambda r: r["b"]):  # 256 rows
        buckets.append((r["b"], at, at + r["w"]))
        at += r["w"]
    if not at:
        return spark.createDataFrame([], "draw bigint, token string")
    table = spark.createDataFrame(buckets, "b string, start bigint, stop bigint")
    point = F.pmod(F.conv(F.left(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}"))), F.lit(15)), 16, 10).cast("bigint"), F.lit(at))
    drawn = spark.range(draws).select(F.col("id").alias("draw"), point.alias("x"))
    placed = drawn.join(F.broadcast(table), (F.col("x") >= F.col("start")) & (F.col("x") < F.col("stop"))).withColumn("y", F.col("x") - F.col("start"))
    return placed.join(rows, "b").filter((F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi"))).select("draw", "token")
