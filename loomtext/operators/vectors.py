"""Term matrices and embedding spaces."""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import arrays as ar
from loomtext.session import FEW, cut_lineage


def term_document(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.groupBy(key, "token").agg(F.count("*").alias("tf"))


def cooccurrence(sentences: DataFrame, window: int, vocab: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """``(a, b, x)``, both directions: how often two words stand within the window, or the sum of 1 / distance.

    Places count after words outside the vocabulary are gone. Pairs are made inside each sentence's array.
    """
    if vocab is not None:
        rows = sentences.select("sid", F.posexplode("words").alias("pos", "token")).join(vocab.select("token"), "token", "left_semi")
        sentences = rows.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")).select("sid", F.col("x.token").alias("words"))
    value = 1.0 / F.col("d") if weighted else F.lit(1)
    half = sentences.select(F.inline(ar.pairs_within(F.col("words"), window))).filter("a <> b" if not weighted else "true").groupBy("a", "b").agg(F.sum(value).alias("x"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "x"))
    return both.groupBy("a", "b").agg(F.sum("x").alias("x"))


def document_cooccurrence(tokens: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """``(a, b, docs)`` of vocabulary words in one document, a < b; pairs are made in a document's own sorted list."""
    lists = tokens.join(vocab.select("token"), "token", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("token")).alias("words"))
    n = F.size("words")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(F.col("words"), i + 1, n), lambda w: F.struct(F.element_at("words", i).alias("a"), w.alias("b")))))
    return lists.filter(n > 1).select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("docs"))


def ppmi(cooc: DataFrame) -> DataFrame:
    """``(a, b, ppmi)`` of a symmetric table ``(a, b, x)``, where above zero."""
    sums = cooc.groupBy("a").agg(F.sum("x").alias("r"))
    total = sums.agg(F.sum("r")).first()[0] or 1
    j = cooc.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("r").alias("s")), "b")
    return j.select("a", "b", F.round(F.ln(F.col("x") * F.lit(float(total)) / (F.col("r") * F.col("s"))), 6).alias("ppmi")).filter("ppmi > 0")


def tfidf(td: DataFrame, key: str, documents: int) -> DataFrame:
    """``(key, token, weight)``: tf * (ln((1 + n) / (1 + df)) + 1), unit length a document."""
    df = td.groupBy("token").agg(F.count("*").alias("df"))
    w = td.join(df, "token").withColumn("w", F.col("tf") * (F.ln((1 + F.lit(documents)) / (1 + F.col("df"))) + 1))
    return w.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))), 6)).select(key, "token", "weight")


def phrases(sentences: DataFrame, least: int = 5, threshold: float = 100.0) -> DataFrame:
    """``(a, b, score)`` of word pairs that stand together more often than chance."""
    one = sentences.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    n = one.agg(F.sum("n")).first()[0] or 0
    two = sentences.select(F.inline(ar.pairs_within(F.col("words"), 1))).groupBy("a", "b").agg(F.count("*").alias("ab"))
    j = two.filter(F.col("ab") >= least).join(one.filter(F.col("n") >= least).select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(one.filter(F.col("n") >= least).select(F.col("token").alias("b"), F.col("n").alias("nb")), "b")
    score = (F.col("ab") - least) / F.col("na") / F.col("nb") * F.lit(n)
    return j.select("a", "b", F.round(score, 6).alias("score")).filter(F.col("score") > threshold)


def singular_values(td: DataFrame, key: str, k: int, rounds: int = 12, more: int = 10) -> list[float]:
    """The largest singular values of a term-document table, by subspace iteration.

    A document is one sparse row. Each round multiplies the rows with a basis over the terms (``k + more`` numbers a term, the
    one thing that is sent) and adds the products up by term, combined in each task; the basis is made orthogonal on the driver.
    """
    spark = td.sparkSession
    terms = cut_lineage(td.groupBy("token").agg(F.count("*").alias("n")))
    names = sorted(r["token"] for r in terms.select("token").toLocalIterator())
    width, size = min(k + more, len(names)), len(names)
    if not size:
        return []
    listed = spark.sparkContext.broadcast(names)
    rows = td.groupBy(key).agg(F.collect_list("token").alias("t"), F.collect_list(F.col("tf").cast("double")).alias("x")).select("t", "x")

    def placed(batches):
        known = pa.array(listed.value, pa.string())
        for batch in batches:
            t = batch.column("t")
            at = pc.index_in(t.flatten(), value_set=known)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.asarray(t.offsets)), at), batch.column("x")], names=["t", "x"])

    rows = cut_lineage(rows.mapInArrow(placed, "t array<int>, x array<double>"))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    values = np.zeros(width)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(basis)

        def product(batches, sent=sent):
            total = np.zeros_like(sent.value)
            for batch in batches:
                t = batch.column("t")
                owner = np.repeat(np.arange(len(t)), np.diff(np.asarray(t.offsets)))
                at, x = t.flatten().to_numpy(), batch.column("x").flatten().to_numpy()
                y = np.zeros((len(t), total.shape[1]))
                np.add.at(y, owner, sent.value[at] * x[:, None])
                np.add.at(total, at, y[owner] * x[:, None])
            for a in range(0, len(total), 4096):
                part = total[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([a // 4096], pa.int32()), pa.array([part.ravel().tolist()], pa.list_(pa.float64()))], names=["block", "part"])

        parts = rows.mapInArrow(product, "block int, part array<double>").select("block", F.posexplode("part").alias("i", "v")).groupBy("block", "i").agg(F.sum("v").alias("v"))
        new = np.zeros(size * width)
        for r in parts.toLocalIterator():
            new[r["block"] * 4096 * width + r["i"]] = r["v"]
        basis, upper = np.linalg.qr(new.reshape(size, width))
        values = np.sqrt(np.abs(np.linalg.svd(upper, compute_uv=False)))
        sent.unpersist()
    return values[:k].tolist()


def usable(df: DataFrame, vec: str, length: int) -> DataFrame:
    """Vectors of the right length without missing or zero content."""
    v = F.col(vec)  # a comparison with a list that holds null is null, and so is the filter
    return df.filter((F.size(v) == length) & ~F.array_contains(v, float("nan")) & ((F.array_max(v) > 0) | (F.array_min(v) < 0)))


ASKED = 1 << 15  # queries that are sent to the executors at a time
BATCH = 1024  # queries that are multiplied with ``ROWS`` vectors at a time, so that their products stay near the core
ROWS = 256
HELD = 1 << 16  # vectors that a task looks through at a time for equal ones
SEED = 4096  # vectors from which a query without any list gets a first floor
MET = 1 << 20  # pairs, those of equal vectors counted each, that may be among the best until lists are brought up to date
TASKS = 8  # tasks a core: each passes on what it finds above the floors of the tasks before it
SLICE = 1 << 15  # pairs whose similarity is worked out anew at a time
NEAR = 1e-6  # what rounding to six places may move two similarities towards each other by
LOWEST = np.finfo(np.float32).min


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places as ``round`` of Spark does: by the shortest decimals, halves away from zero; NaN stays."""
    y = np.abs(x) * 1e6
    out = np.copysign(np.floor(y + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero(np.abs(y % 1 - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first element to the last as ``arrays.dot`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def summed_at(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``summed(a[:, i].T, b[:, j].T)`` of vectors that lie in columns, without copies of whole vectors."""
    total = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        total += x[i] * y[j]
    return total


def norms(m: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(summed(m, m)), 1e-12)


def units(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In single precision; those without a finite norm are not numbers."""
    out = (m / n[:, None]).astype(np.float32)
    out[~np.isfinite(n)] = np.nan
    return out


def leeway(length: int) -> float:
    """By how much a product of ``units`` may at most be under a floor that its rounded similarity reaches.

    Two products in single precision (rounded elements, a sum of ``length`` in any order, of unit vectors) and ``NEAR``.
    """
    return NEAR + 2 * (length + 8) * 2.0**-24


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a table in which little is set: looks at 64 places at a time, then at eight of those."""
    flat = mask.ravel()
    whole = flat.size // 512 * 512
    eights = flat[:whole].view(np.uint64)
    at = (np.flatnonzero((eights != 0).view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = (at[eights[at] != 0][:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], np.flatnonzero(flat[whole:]) + whole])
    return at // mask.shape[1], at % mask.shape[1]


def ranked(at: np.ndarray, sim: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``np.lexsort((key, -sim, at))`` of similarities in six places."""
    if not (np.abs(sim) <= 2).all():
        return np.lexsort((key, -sim, at))
    one = at * (1 << 23) - np.rint(sim * 1e6).astype(np.int64)
    order = np.argsort(one)
    same = np.diff(one[order]) == 0
    ties = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if len(at) else order
    rows = order[ties]
    order[ties] = rows[np.lexsort((key[rows], one[rows]))]
    return order


def rows_of(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def lots(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, lot)``: a row of each lot of rows equal in every bit, and each row's lot."""
    bits = np.ascontiguousarray(m).view(np.uint64)
    odd = np.random.default_rng(9).integers(0, 1 << 63, bits.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, lot = np.unique((bits ^ (bits >> np.uint64(32))) @ odd, return_index=True, return_inverse=True)
    if len(first) == len(m) or not np.array_equal(bits[first][lot], bits):  # unlike rows of one hash: each by itself
        return np.arange(len(m)), np.arange(len(m))
    return first, lot


def members(lot: np.ndarray, number: int, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, ends)``: the rows of lot k, in the order given, are ``rows[ends[k] : ends[k + 1]]``."""
    return np.lexsort((*order, lot)), np.r_[0, np.cumsum(np.bincount(lot, minlength=number))]


def opened(at: np.ndarray, ends: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(pair, place)``: each lot in ``at`` as often as it has members, with their places; no more than ``most`` of each."""
    n = (ends[1:] - ends[:-1])[at] if most is None else np.minimum((ends[1:] - ends[:-1])[at], most)
    return np.repeat(np.arange(len(at)), n), np.arange(n.sum()) + np.repeat(ends[:-1][at] - (np.cumsum(n) - n), n)


def held(columns):
    """Pairs of columns put together to at least ``HELD`` rows."""
    met, n = [], 0
    for pair in columns:
        met.append(pair)
        n += len(pair[0])
        if n >= HELD:
            yield tuple(map(pa.concat_arrays, zip(*met, strict=True)))
            met, n = [], 0
    if met:
        yield tuple(map(pa.concat_arrays, zip(*met, strict=True)))


_floors: dict[str, np.ndarray] = {}  # of the queries that this worker's last task was asked


class Best:
    """The ``top`` rows of each query, by rounded similarity and key, of the vectors that have come so far; none is passed over.

    Products of matrices in single precision only say which pairs may be among them (all within ``leeway`` of the last place);
    those are worked out anew in double precision and in the order of ``arrays.cosine``. Equal vectors are multiplied once.
    ``name`` stands for a set of queries and vectors: a task begins at the floors that the worker's earlier tasks with that name
    found, since whatever is below the last place of a part is below that of the whole.
    """

    def __init__(self, queries: np.ndarray, without: list[tuple[np.ndarray, np.ndarray]], top: int, name: str | None = None):
        first, lot = lots(queries)
        self.queries, self.ends = members(lot, len(first))
        self.columns, self.n, self.top, self.without, self.name = np.ascontiguousarray(queries[first].T), norms(queries[first]), top, without, name
        self.unit, self.near = units(queries[first], self.n), leeway(queries.shape[1])
        self.odd = not np.isfinite(self.n).all()
        self.at, self.sim, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.last = _floors.get(name, np.full(len(queries), -np.inf)).copy()  # the similarity at the last place, once all places are taken
        self.border = np.full(len(queries), np.iinfo(np.int64).max)  # the key there

    def leave(self) -> None:
        """The next task of this worker goes on from the floors that were found."""
        _floors.clear()
        _floors[self.name] = self.last

    def floors(self) -> np.ndarray:
        """The lowest floor of the queries of each lot."""
        return np.minimum.reduceat(self.last[self.queries], self.ends[:-1])

    def add(self, m: np.ndarray, keys: np.ndarray) -> None:
        if not len(m):
            return
        first, lot = lots(m)
        rows, ends = members(lot, len(first), keys)
        columns, n = np.ascontiguousarray(m[first].T), norms(m[first])
        unit, odd = units(m[first], n), self.odd or not np.isfinite(n).all()
        beside = self.top + len(self.without) * int(np.unique(keys, return_counts=True)[1].max())  # so many rows hold the best of any query
        space, mask = np.empty(BATCH * max(ROWS, min(SEED, len(n))), np.float32), np.empty(BATCH * ROWS, bool)

        def product(a: int, part: np.ndarray) -> np.ndarray:
            q = self.unit[a : a + BATCH]
            s = np.matmul(q, part, out=space[: len(q) * part.shape[1]].reshape(len(q), -1))
            if odd:
                np.copyto(s, np.inf, where=np.isnan(s))
            return s

        floor = self.floors()
        if (floor == -np.inf).any():
            part, size = np.ascontiguousarray(unit[:SEED].T), np.diff(ends)[:SEED]
            for a in range(0, len(floor), BATCH):
                new = np.flatnonzero(floor[a : a + BATCH] == -np.inf)
                if len(new):
                    s = product(a, part)[new]
                    if s.shape[1] > beside:
                        best = np.argpartition(s, s.shape[1] - beside, axis=1)[:, s.shape[1] - beside :]
                    else:
                        best = np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    s = np.take_along_axis(s, best, 1)
                    order = np.argsort(-s, axis=1)
                    held = np.cumsum(size[np.take_along_axis(best, order, 1)], axis=1) >= beside
                    lowest = np.take_along_axis(np.take_along_axis(s, order, 1), held.argmax(1)[:, None], 1)[:, 0]
                    floor[a + new] = np.where(held[:, -1], lowest, -np.inf)
        met, pairs, asking, copies = [], 0, np.diff(self.ends), np.minimum(np.diff(ends), beside)
        for b in range(0, len(n), ROWS):
            part = np.ascontiguousarray(unit[b : b + ROWS].T)
            least = np.maximum(floor - self.near, LOWEST).astype(np.float32)[:, None]
            for a in range(0, len(floor), BATCH):
                s = product(a, part)
                i, j = places(np.greater_equal(s, least[a : a + BATCH], out=mask[: s.size].reshape(s.shape)))
                if len(i):
                    met.append((i + a, j + b))
                    pairs += int((asking[i + a] * copies[j + b]).sum())
            if met and (pairs >= MET or b + ROWS >= len(n)):
                self.merge(*map(np.concatenate, zip(*met, strict=True)), columns, n, keys[rows], ends, beside)
                met, pairs, floor = [], 0, np.maximum(floor, self.floors())

    def merge(self, i: np.ndarray, j: np.ndarray, columns: np.ndarray, n: np.ndarray, keys: np.ndarray, ends: np.ndarray, beside: int) -> None:
        sim = np.concatenate([summed_at(self.columns, columns, i[x : x + SLICE], j[x : x + SLICE]) / (self.n[i[x : x + SLICE]] * n[j[x : x + SLICE]]) for x in range(0, len(i), SLICE)])
        sim = rounded(sim)
        sim[np.isnan(sim)] = np.inf  # stands first, as in Spark
        pair, place = opened(i, self.ends)
        at = self.queries[place]
        good = sim[pair] >= self.last[at]
        pair, at = pair[good], at[good]
        again, place = opened(j[pair], ends, beside)
        at, sim, key = at[again], sim[pair][again], keys[place]
        good = (sim > self.last[at]) | (key < self.border[at])
        for banned, ok in self.without:
            good &= (key != banned[at]) | ~ok[at]
        at, sim, key = np.concatenate([self.at, at[good]]), np.concatenate([self.sim, sim[good]]), np.concatenate([self.key, key[good]])
        order = ranked(at, sim, key)
        at, sim, key = at[order], sim[order], key[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        full = place == self.top - 1
        self.last[at[full]], self.border[at[full]] = sim[full], key[full]
        kept = place < self.top
        self.at, self.sim, self.key = at[kept], sim[kept], key[kept]


def asked(queries: DataFrame, space: DataFrame, key: str, vec: str, top: int, without: tuple[str, ...] = ("q",)) -> DataFrame:
    """``(q, rank, key, similarity)``: a stated query set ``(q, qv)`` by cosine against all vectors but those whose key stands in ``without``.

    Keys are whole numbers. The queries are counted and sent in blocks of about ``ASKED``; every task multiplies its vectors with
    a block as matrices and keeps its best rows of a query before anything is shuffled.
    """
    spark = space.sparkSession
    rows = queries.select("q", "qv", *(F.col(c).cast("bigint").alias(f"__{c}") for c in without))
    queries = cut_lineage(rows.filter(F.size("qv") > 0))
    space = space.select(F.col(key).cast("bigint").alias("__key"), F.col(vec).alias("__vec")).filter((F.size("__vec") > 0) & F.col("__key").isNotNull())
    cores = spark.sparkContext.defaultParallelism
    space = space.repartition(cores) if space.rdd.getNumPartitions() < cores else space.coalesce(TASKS * cores)
    blocks = -(-queries.count() // ASKED)
    out = []
    for b in range(max(blocks, 1)):
        block = queries if blocks <= 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        found = block.toArrow().combine_chunks()
        length = len(found["qv"][0]) if found.num_rows else 1
        banned = [(found[f"__{c}"].fill_null(0).to_numpy(), found[f"__{c}"].is_valid().to_numpy()) for c in without]
        sent = spark.sparkContext.broadcast((rows_of(found["qv"].combine_chunks(), length), banned, found["q"].fill_null(0).to_numpy(), found["q"].is_valid().to_numpy()))

        def run(batches, sent=sent, length=length, name=uuid.uuid4().hex):
            m, banned, names, named = sent.value
            best = Best(m, banned, top, name)
            for vecs, keys in held((batch.column("__vec"), batch.column("__key")) for batch in batches if batch.num_rows and len(m)):
                best.add(rows_of(vecs, length), keys.to_numpy())
            best.leave()
            q = pa.array(names[best.at], pa.int64(), mask=~named[best.at])
            yield pa.RecordBatch.from_arrays([q, pa.array(best.key, pa.int64()), pa.array(np.where(np.isinf(best.sim), np.nan, best.sim))], names=["q", "__key", "similarity"])

        out.append(space.mapInArrow(run, "q bigint, __key bigint, similarity double"))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "__key")
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("q", "rank", F.col("__key").alias(key), "similarity")


def analogies(questions: DataFrame, space: DataFrame, key: str, vec: str, top: int, unit: bool = False) -> DataFrame:
    """``(a, b, c, rank, key, similarity)`` of b - a + c, without the three themselves; raw or unit vectors."""
    v = space.select(F.col(key).alias("k"), (ar.unit(F.col(vec)) if unit else F.col(vec)).alias("v"))
    q = questions
    for name in ("a", "b", "c"):
        q = q.join(v.select(F.col("k").alias(name), F.col("v").alias(f"v{name}")), name)
    q = q.select("a", "b", "c", ar.combined(F.col("va"), F.col("vb"), F.col("vc")).alias("qv"))
    pairs = space.join(F.broadcast(q), ~F.col(key).isin(F.col("a"), F.col("b"), F.col("c")))  # a stated set of questions
    order = Window.partitionBy("a", "b", "c").orderBy(F.desc("similarity"), key)
    scored = pairs.select("a", "b", "c", key, F.round(ar.cosine(F.col("qv"), F.col(vec)), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("a", "b", "c", "rank", key, "similarity")


def analogy_answers(questions: DataFrame, space: DataFrame, key: str, vec: str, top: int) -> DataFrame:
    """``(*questions, is_known, rank)``: the rank at which ``expected`` comes out for b - a + c over unit vectors, null beyond ``top``.

    A question one of whose words has no vector is not known and is not asked.
    """
    q = cut_lineage(questions.withColumn("q", F.xxhash64("a", "b", "c", "expected")))
    names = ("a", "b", "c", "expected")
    words = q.select("q", "a", "b", "c", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(n).alias("k")) for n in names)))).select("q", "a", "b", "c", "col.*")
    words = F.broadcast(words) if q.count() * len(names) <= FEW else words
    met = words.join(space.select(F.col(key).alias("k"), F.col(vec).alias("v")), "k")
    found = met.groupBy("q", "a", "b", "c").agg(*(F.min(F.when(F.col("part") == n, F.col("v"))).alias(f"v{n}") for n in names)).dropna(subset=[f"v{n}" for n in names])
    found = cut_lineage(found.select("q", "a", "b", "c", ar.combined(*(ar.unit(F.col(f"v{n}")) for n in names[:3])).alias("qv")))
    answers = asked(found, space.select(key, vec), key, vec, top, without=("a", "b", "c"))
    known = q.join(found.select("q", F.lit(True).alias("is_known")), "q", "left")
    ranked = known.join(answers.select("q", F.col(key).alias("expected"), "rank"), ["q", "expected"], "left")
    return ranked.select(*questions.columns, F.coalesce("is_known", F.lit(False)).alias("is_known"), "rank")


def mean_vector(df: DataFrame, vec: str, group: list[str]) -> DataFrame:
    """``(*group, v)``: element-wise means; one row an element is shuffled after a map-side combine."""
    parts = df.select(*group, F.posexplode(vec).alias("i", "x")).groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def nearest_class(df: DataFrame, means: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, class)``: the class whose mean is nearest by cosine, ties to the lower; ``means`` has a row a class."""
    scored = df.join(F.broadcast(means), how="cross").select(key, F.round(ar.cosine(F.col(vec), F.col("v")), 6).alias("s"), (-F.col("class")).alias("c"))
    return scored.groupBy(key).agg(F.max(F.struct("s", "c")).alias("b")).select(key, (-F.col("b.c")).alias("class"))


def kmeans_step(df: DataFrame, key: str, vec: str, classes: int) -> DataFrame:
    """``(key, class)`` after one round from the start ``key mod classes``."""
    return kmeans(df, key, vec, classes, 1)


def kmeans(df: DataFrame, key: str, vec: str, classes: int, rounds: int) -> DataFrame:
    """``(key, class)`` after some rounds from the start ``key mod classes``; ends early when no vector changes its class."""
    placed = df.select(key, F.pmod(F.col(key), F.lit(classes)).alias("class"))
    for _ in range(rounds):
        means = mean_vector(df.select(key, vec).join(placed, key), vec, ["class"])
        after = cut_lineage(nearest_class(df.select(key, vec), means, key, vec))
        same = rounds > 1 and after.join(placed.withColumnRenamed("class", "__before"), key).filter("class <> __before").limit(1).count() == 0
        placed = after
        if same:
            break
    return placed
