"""Problem 9: items of varying length into as few containers of fixed capacity as one can manage.

The plan is made over the histogram of lengths, which has at most ``capacity`` rows however many items there are: lengths in
descending order are put, count by count, into the group of open containers with the least room that still takes them
(best fit); equal containers stay one group with a count. A planned group gives every length the ranks that its containers
hold, and the items take their places by joining on length and rank within the length.

Ranks are counted without one task per length: items are numbered within (length, salt), and the salts' offsets, a small
table, are added. The plan has a few rows per distinct length; for the join a row is cut at multiples of ``BLOCK`` ranks so
that length and block are equality keys, and Spark picks the join.

Defined cases: an item larger than the capacity is split into full containers and a rest, which is packed like an item (its
``part`` counts from 0); an item of size zero or null takes no space and gets one row without a container; ties among equal
lengths go by key; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import cut_lineage

CAPACITY = 2048
SALTED = 100_000  # items of one length that are ranked in one task
BLOCK = 4096


@dataclass
class Group:
    """``count`` equal containers; held: (length, first rank, items of that length per container)."""

    count: int
    held: list[tuple[int, int, int]]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, per_container, containers, first_container)``; ranks and containers count from 0."""
    room: dict[int, list[Group]] = {}  # by the room left
    full: list[Group] = []

    def put(group: Group, left: int) -> None:
        (room.setdefault(left, []) if left else full).append(group)

    for length in sorted(histogram, reverse=True):
        left_over, rank = histogram[length], 0
        for r in sorted(x for x in room if x >= length):
            groups = room.pop(r)
            while groups and left_over:
                group = groups.pop()
                fits = r // length
                whole = min(group.count, left_over // fits)
                if whole:
                    put(Group(whole, [*group.held, (length, rank, fits)]), r - fits * length)
                    rank, left_over = rank + whole * fits, left_over - whole * fits
                rest = split(group, whole)
                if rest.count and left_over and left_over < fits:
                    put(Group(1, [*split(rest, 0, 1).held, (length, rank, left_over)]), r - left_over * length)
                    rank, left_over, rest = rank + left_over, 0, split(rest, 1)
                if rest.count:
                    groups.append(rest)
                    if not left_over:
                        break
            if groups:
                room.setdefault(r, []).extend(groups)
            if not left_over:
                break
        if left_over:
            fits = capacity // length
            if whole := left_over // fits:
                put(Group(whole, [(length, rank, fits)]), capacity - fits * length)
                rank, left_over = rank + whole * fits, left_over - whole * fits
        if left_over:
            put(Group(1, [(length, rank, left_over)]), capacity - left_over * length)
    rows, first = [], 0
    for group in [*full, *(g for r in sorted(room) for g in room[r])]:
        rows += [(length, rank, per, group.count, first) for length, rank, per in group.held]
        first += group.count
    return rows


def split(group: Group, start: int, count: int | None = None) -> Group:
    """The containers of a group from ``start`` on."""
    count = group.count - start if count is None else count
    return Group(count, [(length, rank + start * per, per) for length, rank, per in group.held])


def parts(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(key, part, n, of)``: items up to the capacity as they are, larger ones as full parts and a rest."""
    size = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    cut = F.when(size > capacity, F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / capacity)), lambda i: F.struct(i.cast("int").alias("part"), F.least(F.lit(capacity).cast("bigint"), size - i * capacity).alias("n"))))
    whole = F.array(F.struct(F.lit(0).alias("part"), size.alias("n")))
    return df.select(F.col(key).alias("key"), F.inline(F.coalesce(cut, whole)))


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, salted: int = SALTED) -> DataFrame:
    """``(key, part, n, container)`` for every part of every item; ``df`` is read twice, so its sizes are written once first."""
    spark = df.sparkSession
    items = cut_lineage(parts(df, key, size, capacity))
    histogram = {r["n"]: r["c"] for r in items.filter("n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `capacity` rows
    salts = max(1, -(-max(histogram.values(), default=1) // salted))  # as many as the commonest length needs
    items = items.withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(salts)).cast("int"))
    counts = items.filter("n > 0").groupBy("n", "salt").agg(F.count("*").alias("c"))
    offsets = cut_lineage(counts.withColumn("offset", F.sum("c").over(Window.partitionBy("n").orderBy("salt")) - F.col("c")))
    rows = best_fit(histogram, capacity)
    plan = spark.createDataFrame(rows, "n bigint, first_rank bigint, per bigint, containers bigint, first_container bigint")
    last_rank = F.col("first_rank") + F.col("per") * F.col("containers") - 1
    plan = plan.select("*", last_rank.alias("last_rank"), F.explode(F.sequence(F.floor(F.col("first_rank") / BLOCK), F.floor(last_rank / BLOCK))).alias("block"))
    ranked = items.filter("n > 0").withColumn("in_salt", F.row_number().over(Window.partitionBy("n", "salt").orderBy("key", "part")) - 1)
    ranked = ranked.join(offsets.select("n", "salt", "offset"), ["n", "salt"]).withColumn("rank", F.col("offset") + F.col("in_salt"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = ranked.join(plan, ["n", "block"]).filter("rank between first_rank and last_rank")
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per"))
    placed = placed.select("key", "part", "n", container.cast("bigint").alias("container"))
    return placed.unionByName(items.filter("n = 0").select("key", "part", "n", F.lit(None).cast("bigint").alias("container")))
