"""Queries over all of their tables, where a part of them was taken before."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.llm import neighbours
from loomtext.operators import corpus, training
from loomtext.plans import language_models
from loomtext.plans import vectors as plans_vectors
from tests.conftest import SF


@pytest.fixture(scope="module")
def vocabulary(spark):
    return {r["token"] for r in language_models.spell_tables(spark, SF)[1].collect()}


def test_every_word_is_asked(spark, vocabulary):
    asked = lambda name: {r["word"] for r in entry.queries()[name](spark, SF).select("word").distinct().collect()}
    assert len(vocabulary) > 500
    assert asked("spell_suggest") == vocabulary
    assert asked("spell_variants") == vocabulary
    assert entry.queries()["spell_accuracy"](spark, SF).first()["asked"] == len(vocabulary)
    wrong = spark.createDataFrame([(w,) for w in vocabulary], "word string").select(language_models.spelling.corrupted(F.col("word")).alias("w")).distinct().count()
    assert 0.95 * wrong < len(asked("spell_weighted")) <= wrong
    plain = {w.translate(str.maketrans("çşğəöüı", "csgeoui")) for w in vocabulary}
    assert 0.95 * len(plain) < len(asked("spell_expanded")) <= len(plain)
    confusions = entry.queries()["confusion_costs"](spark, SF).agg(F.sum("n")).first()[0]
    assert confusions > 0.9 * len(vocabulary)


def test_suggestions_agree_with_sql_where_it_asks(spark):
    """The SQL asks a part of the words; a word's suggestions don't hang on which others are asked."""
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(f"select word, rank, token, dist, n from ({entry.oracle_sql()['spell_suggest']})").fetchall())
    rows = entry.queries()["spell_suggest"](spark, sf).select("word", "rank", "token", "dist", "n").collect()
    asked = {w[0] for w in want}
    assert want and sorted(tuple(r) for r in rows if r["word"] in asked) == want


def test_expanded_suggestions_have_the_operators_bounds(spark):
    got = entry.queries()["spell_expanded"](spark, SF).agg(F.max("rank"), F.max("dist")).first()
    assert tuple(got) == (5, 2)


def test_merges_against_counting_all_pairs_each_time():
    random.seed(3)
    words = {"".join(random.choices("aabc", k=random.randint(1, 9))): random.randint(2, 9) for _ in range(80)}
    parts, want = {w: [*w, "</w>"] for w in words}, []
    while True:
        pairs = Counter()
        for w, s in parts.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        want.append((a, b))
        for w, s in parts.items():
            out = []
            for x in s:
                if out and out[-1] == (a, False) and x == b:
                    out[-1] = (a + b, True)
                else:
                    out.append((x, False))
            parts[w] = [x for x, _ in out]
    assert len(want) > 50
    assert corpus.learned_merges(list(words), list(words.values()), 10**6, 2) == want


def test_five_thousand_merges(spark):
    sf = SF.replace("0.001", "0.01")
    merges = entry.queries()["bpe_merges"](spark, sf).orderBy("rank").collect()
    assert [r["rank"] for r in merges] == list(range(1, 5001))
    symbols = {r["a"] + r["b"] for r in merges}
    found = entry.queries()["bpe_subwords"](spark, sf).collect()
    assert len({r["subword"] for r in found} & symbols) > 1000


def test_recall_where_leaves_are_a_small_part_of_the_table(spark, monkeypatch):
    """As in a large table: a leaf holds a hundredth of the rows."""
    monkeypatch.setattr(neighbours, "LEAF", 40)
    m = np.random.default_rng(4).standard_normal((4000, 24))
    rows = neighbours.unit_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "k long, v array<double>"), "k", "v").cache()
    exact = neighbours.exact_neighbours(rows, rows.filter("id % 20 = 0")).select("id", "near_id")
    assert exact.count() == 1000
    assert exact.join(neighbours.neighbour_lists(rows), ["id", "near_id"], "left_semi").count() >= 900


def test_every_word_gets_a_vector(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r["word"]: r["length"] for r in entry.queries()["trained_vectors"](spark, sf).collect()}
    words = {r["token"] for r in plans_vectors.vocabulary(spark, sf).collect()}
    assert len(words) > 500 and set(got) - {"<unk>"} <= words and len(got) > 0.99 * len(words)
    assert set(got.values()) == {32}


def test_vectors_fit_the_entries(spark):
    m = np.random.default_rng(5).standard_normal((30, 3))
    x = np.exp(m @ m.T)
    cooc = spark.createDataFrame([(f"w{i}", f"w{j}", float(x[i, j])) for i in range(30) for j in range(30)], "a string, b string, x double")
    counts = spark.createDataFrame([(f"w{i}", 20 + i) for i in range(30)], "token string, n long")
    v = {r["word"]: np.array(r["vec"]) for r in training.train_vectors(cooc, counts, size=6, rounds=10).collect()}
    assert len(v) == 31
    near = np.array([[v[f"w{i}"] @ v[f"w{j}"] for j in range(30)] for i in range(30)])
    assert np.corrcoef(near.ravel(), np.log(x).ravel())[0, 1] > 0.8
