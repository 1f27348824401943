"""What the second round's review found."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from loomtext import session
from loomtext.functions.udfs import typed_variants
from loomtext.operators import spelling, vectors
from tests.conftest import SF


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Four copies of the word vectors under further ids: every similarity stands in ties."""
    at = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    con.execute(f"copy (select word_id + k * 1000 as word_id, word || k as word, vec from read_parquet('{SF}/word_vectors.parquet'), range(4) r(k)) to '{at}/word_vectors.parquet'")
    con.execute(f"create view word_vectors as select * from read_parquet('{at}/word_vectors.parquet')")
    return str(at), con


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def against_sql(spark, copies, name):
    """As in SQL, and not by a loop over all pairs in columns, which did not end on a table of 1 GB."""
    at, con = copies
    got = entry.queries()[name](spark, at)
    assert "NestedLoopJoin" not in plan(got) and "CartesianProduct" not in plan(got)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("blocks", [1, 5])
def test_asked_keeps_every_best_row(spark, monkeypatch, blocks):
    """Ties, copies, an infinite vector and queries in blocks, beside all pairs at once."""
    r = np.random.default_rng(2)
    m = np.repeat(r.integers(-3, 4, (60, 6)).astype(float), 5, axis=0)
    m = m[np.abs(m).sum(1) > 0]
    m[7, 2] = np.inf
    ids = r.permutation(len(m)) + 1
    monkeypatch.setattr(vectors, "ASKED", -(-40 // blocks))
    monkeypatch.setattr(vectors, "BATCH", 7)
    monkeypatch.setattr(vectors, "SLICE", 11)
    space = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], "id bigint, v array<double>").repartition(3)
    queries = spark.createDataFrame([(int(i), v.tolist()) for i, v in list(zip(ids, m, strict=True))[:40]], "q bigint, qv array<double>")
    got = sorted((r["q"], r["rank"], r["id"], repr(r["similarity"])) for r in vectors.asked(queries, space, "id", "v", 6).collect())
    n = np.sqrt((m * m).sum(1))
    want = []
    for i in range(40):
        with np.errstate(invalid="ignore"):
            s = np.round(m @ m[i] / (n * n[i]), 6) + 0.0
        order = sorted((np.where(np.isnan(x), -np.inf, -x), k, repr(float(x))) for x, k in zip(s, ids, strict=True) if k != ids[i])[:6]
        want += [(int(ids[i]), p + 1, int(k), x) for p, (_, k, x) in enumerate(order)]
    assert got == sorted(want)


@pytest.mark.parametrize("top", [3, 40])
def test_single_precision_decides_nothing(top):
    """Similarities that differ by less than single precision, of vectors at many lengths: the products only name candidates."""
    r = np.random.default_rng(top)
    m = np.repeat(r.standard_normal((9, 96)), 200, axis=0) + r.standard_normal((1800, 96)) * 10.0 ** r.integers(-9, -2, (1800, 1))
    m *= 10.0 ** r.integers(-20, 20, (1800, 1))
    m[1700, 5] = np.inf
    m[1701] = 1e200  # its norm is beyond double precision
    ids, asked = r.permutation(1800), np.arange(0, 1800, 100)
    best = vectors.Best(m[asked], [(ids[asked], np.ones(len(asked), bool))], top)
    assert best.unit.dtype == np.float32
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, 1800, 250):
            best.add(m[a : a + 250], ids[a : a + 250])
        got = sorted(zip(best.at.tolist(), (-best.sim).tolist(), best.key.tolist(), strict=True))
        n, want = vectors.norms(m), []
        for k, i in enumerate(asked):
            s = vectors.rounded(vectors.summed(np.repeat(m[i : i + 1], 1800, axis=0), m) / (n[i] * n))
            s[np.isnan(s)] = np.inf
            want += sorted((k, -x, y) for x, y in zip(s.tolist(), ids.tolist(), strict=True) if y != ids[i])[:top]
    assert got == want


@pytest.mark.parametrize("width", [1, 7, 8, 1001])
def test_places(width):
    r = np.random.default_rng(width)
    for share in (0, 0.01, 0.5, 1):
        mask = r.random((13, width)) < share
        assert all(np.array_equal(x, y) for x, y in zip(vectors.places(mask), np.nonzero(mask), strict=True))


@pytest.mark.parametrize("parts", [2, 100])
def test_tasks_go_with_the_cores(spark, parts):
    """Each task passes on a list of each query: neither the table's partitions nor those of shuffles may multiply them."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, parts).selectExpr("id", "array(cast(id + 1 as double), 1.0D) as v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        shown = plan(vectors.asked(rows.filter("id < 5").selectExpr("id as q", "v as qv"), rows, "id", "v", 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert f"RoundRobinPartitioning({cores})" in shown if parts < cores else f"Coalesce {vectors.TASKS * cores}" in shown


def test_rounded_as_spark_does(spark):
    from pyspark.sql import functions as F

    x = [0.1234565, -0.1234565, 0.0000005, -0.0000005, 0.9999995, 1.0000000000000002, -0.0000001, 0.1234564999999999, 0.3, float("nan")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert np.array_equal(vectors.rounded(np.array(x)), np.array(want), equal_nan=True)


@pytest.mark.parametrize("name", ["knn_forty", "neighbour_cosine", "analogy_rollup", "knn"])
def test_shuffle_partitions_do_not_multiply_the_lists(spark, copies, name):
    """The tables of the queries too are multiplied in as many tasks as there are cores, whatever the session's shuffles are cut into."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        shown = plan(entry.queries()[name](spark, copies[0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "MapInArrow" in shown and "RoundRobinPartitioning(200)" not in shown


@pytest.mark.parametrize("name", ["analogy_answers", "knn_forty", "neighbour_cosine", "analogy_rollup", "knn"])
def test_nearest_vectors_against_sql(spark, copies, name):
    against_sql(spark, copies, name)


def test_one_pass_for_the_words_asked(spark):
    """On a table of 1 GB 26,000 words are asked; each block of them goes through the whole table."""
    rows = spark.range(0, 5000, 1, 2).selectExpr("id", "array(cast(id + 1 as double), 1.0D) as v")
    shown = vectors.asked(rows.filter("id < 2500").selectExpr("id as q", "v as qv"), rows, "id", "v", 40)._jdf.queryExecution().analyzed().toString()
    assert shown.count("MapInArrow") == 1


def test_equal_vectors_are_multiplied_once(monkeypatch):
    """Of 40 copies of 50 vectors one product each, with every row in its place; a later task of a worker passes on only what is above the earlier one's floors."""
    r = np.random.default_rng(3)
    m = np.tile(r.standard_normal((50, 8)), (40, 1))
    ids = r.permutation(2000)
    without = [(ids[:500], np.ones(500, bool))]
    n, want = vectors.norms(m), []
    for i in range(500):
        s = vectors.rounded(vectors.summed(np.repeat(m[i : i + 1], 2000, axis=0), m) / (n[i] * n))
        want.append(sorted((-x, y) for x, y in zip(s.tolist(), ids.tolist(), strict=True) if y != ids[i])[:45])
    monkeypatch.setattr(vectors, "MET", 1000)
    found = [[] for _ in range(500)]
    for part in (slice(0, 700), slice(700, 2000)):
        best = vectors.Best(m[:500], without, 45, "a set")
        assert len(best.unit) == 50
        best.add(m[part], ids[part])
        best.leave()
        for q, x, y in zip(best.at.tolist(), best.sim.tolist(), best.key.tolist(), strict=True):
            found[q].append((-x, y))
    assert [sorted(x)[:45] for x in found] == want
    assert all(x >= floor for x, floor in zip(best.sim, vectors._floors["a set"][best.at], strict=True))
    vectors._floors.clear()


@pytest.mark.parametrize("few", [1 << 20, 3])
def test_only_repeated_rows_are_compared(spark, monkeypatch, few):
    """Records as of ``one_record``; rows whose key stands once are neither moved nor sorted."""
    monkeypatch.setattr(session, "FEW", few)
    r = random.Random(few)
    rows = [(k, [float(r.randint(0, 1))]) for k in range(60) for _ in range(r.choice([1, 1, 1, 4]))] + [(None, [1.0]), (None, [2.0])]
    df = spark.createDataFrame(rows, "k bigint, v array<float>")
    got = session.sole_record(df, "k")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, session.one_record(df, "k").collect()))
    assert few == 3 or "Exchange hash" not in plan(got)
    once = df.filter("k is not null").dropDuplicates(["k"])
    assert sorted(session.sole_record(once, "k").collect()) == sorted(once.collect())


def test_vectors_stay_where_they_are_for_the_questions(spark, copies, monkeypatch):
    """The questions' words go to the vectors; the table of vectors is not sorted for them."""
    seen = []
    monkeypatch.setattr(vectors, "cut_lineage", lambda df: (seen.append(plan(df)), session.cut_lineage(df))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entry.queries()["analogy_rollup"](spark, copies[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen and not any("SortMergeJoin" in x for x in seen)


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [1.0], [0.0, 0.0], [0.0, -0.0], [0.0, -1.0], [1.0, None], [None, None], [nan, 1.0], [None, nan], [inf, 1.0], [-inf, 0.0], [0.0, None]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<float>")
    assert sorted(r["k"] for r in vectors.usable(df, "v", 2).collect()) == [5, 10, 11]


def test_decoded_as_token_by_token():
    """All ids of a batch in one look-up: missing and empty lists, a slice of a batch, pieces of signs, ids that there are not."""
    pytest.importorskip("loomtext.llm.tokens")
    from loomtext.llm import tokens

    r = random.Random(8)
    path = tokens.vocabulary_path()
    each = tokens.token_bytes(path)
    lists = [None, [], *([r.randrange(len(each)) for _ in range(r.randint(0, 30))] for _ in range(300)), [], None]
    want = [None if x is None else b"".join(each[i] for i in x).decode(errors="replace") for x in lists]
    assert any("\ufffd" in x for x in want if x)
    column = pa.array(lists, pa.list_(pa.int32()))
    assert tokens.decoded(column, tokens.token_column(path)).to_pylist() == want
    assert tokens.decoded(column.slice(7, 90), tokens.token_column(path)).to_pylist() == want[7:97]
    for none in ([], [None], [[]]):
        assert tokens.decoded(pa.array(none, pa.list_(pa.int32())), tokens.token_column(path)).to_pylist() == ["" if x == [] else x for x in none]
    for wrong in (-1, len(each), None):
        with pytest.raises((IndexError, ValueError)):
            tokens.decoded(pa.array([[0], [wrong]], pa.list_(pa.int32())), tokens.token_column(path))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("width", [40, 3])
def test_expanded_suggestions_of_plain_forms(spark, monkeypatch, width):
    """As with a lookup for every variant, each cut to the best five, but without one: those did not end on a table of 1 GB."""

    def looked_up(*_):
        raise AssertionError("every variant is looked up")

    monkeypatch.setattr(spelling, "close_words", looked_up)
    r = random.Random(width)
    made = lambda letters, least, most: "".join(r.choices(letters, k=r.randint(least, most)))
    words = sorted({made("csghewvat", 1, 8) for _ in range(60)} | {"sh", "cha", "gh", "w", "shch", "cococogigesu"})
    vocab = [(t, r.randint(2, 5)) for t in sorted({made("cçsşgğheəwvat", 3, 8) for _ in range(250)} | {"şam", "çay", "ağa", "əşə"})]
    want = []
    for w in words:
        best = {}
        for x in typed_variants(w, 2, width):
            near = sorted((d, -n, t) for t, n in vocab if (d := distance(x["variant"], t)) <= 2)[:5]
            for d, m, t in near:
                best[t] = min(best.get(t, (9, 0, 0)), (d, m, x["edits"]))
        first = sorted((*b, t) for t, b in best.items())[:5]
        want += [(w, k + 1, t, d, -m, e) for k, (d, m, e, t) in enumerate(first)]
    found = spelling.expanded_suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(vocab, "token string, n bigint"), width=width)
    assert found.columns == ["word", "rank", "token", "dist", "n", "edits"] and len(want) > 150
    assert sorted(map(tuple, found.collect())) == sorted(want)
