import math
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import boundaries, corpus, lm, retrieval, sampling, sentiment, spelling, vectors


def sentences(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "sid bigint, words array<string>")


TRAIN, TEST = [["a", "b", "c"], ["a", "b", "d"], ["b", "c", "d"]], [["a", "c", "d"], ["d", "a", "b"]]


def test_smoothers_give_masses_near_one(spark):
    train = sentences(spark, TRAIN)
    words = ["a", "b", "c", "d"]
    test = sentences(spark, [["a", w] for w in words])
    events = lm.event_table(train, test)
    grid = {(m, s): p for m, o, s, p in lm.models() if o == 2}
    for (method, params), p in grid.items():
        if method in ("laplace", "backoff", "kneser_ney"):
            row = events.filter("n2 = 2 and c1 > 0").select(p.alias("p"), "times").collect()
            assert all(0 <= r["p"] <= 1 for r in row), (method, params)


def test_laplace_formula(spark):
    events = lm.event_table(sentences(spark, TRAIN), sentences(spark, [["a"]]))
    got = {round(r["p"], 6) for r in events.select(lm.laplace(1, 1.0).alias("p")).collect()}
    assert got == {round((2 + 1) / (12 + 5), 6), round((3 + 1) / (12 + 5), 6)}


def test_perplexity_is_infinite_with_a_zero_event(spark):
    scores = {(r["method"], r["order_n"]): r for r in lm.evaluated(lm.event_table(sentences(spark, TRAIN), sentences(spark, TEST))).collect()}
    assert scores["mle", 3]["is_inf"] and scores["mle", 3]["perplexity"] is None
    assert scores["mle", 1]["zero_events"] == 0 and scores["mle", 1]["perplexity"] > 1


def test_next_words(spark):
    rows = lm.next_words(sentences(spark, TRAIN), 1).collect()
    assert {(r["h"], r["w"], r["c"]) for r in rows} == {("a", "b", 2), ("b", "c", 2), ("c", "d", 1)}


def test_unknown_words(spark):
    train = sentences(spark, TRAIN)
    got = {r["sid"]: r["words"] for r in lm.in_vocabulary(train, lm.vocabulary(train, 3)).collect()}
    assert got[0] == ["<unk>", "b", "<unk>"]


def test_heaps_against_a_scan(spark):
    random.seed(1)
    texts = [" ".join(random.choices("abcdefghijklmnop", k=random.randint(0, 9))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    got = [(r["n"], r["v"]) for r in corpus.heaps(df, "k", "text", 10).orderBy("n").collect()]
    words, want = [w for t in texts for w in t.split()], []
    for end in [*range(10, len(words), 10), len(words)]:
        want.append((end, len(set(words[:end]))))
    assert got == want


def test_merges(spark):
    words = spark.createDataFrame([("aab", 3), ("ab", 2)], "token string, n bigint")
    assert corpus.train_merges(words, 2) == [("a", "b"), ("ab", "</w>")]


def test_fuzzy_lookup_misses_nothing(spark):
    random.seed(2)
    vocab = sorted({"".join(random.choices("abc", k=random.randint(1, 7))) for _ in range(120)})
    asked = sorted({"".join(random.choices("abc", k=random.randint(1, 7))) for _ in range(25)})
    got = spelling.close_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, 1) for w in vocab], "token string, n bigint"), 2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            up, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                up, row[j] = row[j], min(up + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    assert {(r["word"], r["token"]) for r in got.collect()} == {(a, b) for a in asked for b in vocab if distance(a, b) <= 2}


def test_suggestions_order(spark):
    vocab = spark.createDataFrame([("azərbaycan", 10), ("azerbaycan", 5), ("kitab", 3)], "token string, n bigint")
    rows = spelling.suggestions(spark.createDataFrame([("azrbaycan",)], "word string"), vocab).orderBy("rank").collect()
    assert [r["token"] for r in rows] == ["azərbaycan", "azerbaycan"]


def test_rule_and_features(spark):
    df = spark.createDataFrame([(1, "Qiymət 50.5 manatdır. Prof. Əli gəldi."), (2, None), (3, "")], "k bigint, text string")
    rows = boundaries.words_around(boundaries.dots(df, "k", "text"))
    got = [(r["at"], r["eos"]) for r in rows.select("at", boundaries.rule(rows).alias("eos")).orderBy("at").collect()]
    assert got == [(9, 0), (20, 1), (26, 0), (37, 1)]
    first = boundaries.features(df, "k", "text").orderBy("char_index").first()
    assert first["is_decimal_pattern"] and first["prev_token"] == "50" and first["next_token"] == "5"


def test_boundary_metrics(spark):
    a = spark.createDataFrame([(1, 5), (1, 9)], "k bigint, p bigint")
    b = spark.createDataFrame([(1, 5), (2, 3)], "k bigint, p bigint")
    r = boundaries.boundary_metrics(a, b, "k", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"], r["error_rate"]) == (1, 1, 1, 0.5, 1.0)
    empty = boundaries.boundary_metrics(a.filter("false"), b.filter("false"), "k", "p").first()
    assert empty["f1"] == 1.0 and empty["tp"] == 0


def test_exact_and_f1(spark):
    df = spark.createDataFrame([(1, "alpha beta", ["alpha gamma"]), (2, "", []), (3, None, ["x"])], "k bigint, p string, g array<string>")
    got = {r["k"]: (r["em"], r["f1"]) for r in retrieval.exact_and_f1(df, "k", "p", "g").collect()}
    assert got == {1: (0, 0.5), 2: (1, 1.0), 3: (0, 0.0)}


def test_best_span(spark):
    logits = spark.createDataFrame([(1, p, s, e) for p, s, e in [(0, 0.1, 0.0), (1, 2.0, 0.3), (2, 0.0, 1.5), (3, 0.1, 5.0), (4, 0.0, 0.0)]], "k bigint, pos int, start_logit double, end_logit double")
    r = retrieval.best_spans(logits, "k", 2).first()
    assert (r["start"], r["end"]) == (3, 3)


def test_file_names(spark):
    df = spark.createDataFrame([(1, "AAPL", 2022.0, "x"), (2, "AAPL", 2022.0, "y"), (3, "B", None, "z"), (4, "C", 2020.0, " ")], "k bigint, t string, y double, x string")
    assert [r["name"] for r in retrieval.file_names(df, "k", "t", "y", "x").orderBy("k").collect()] == ["AAPL_2022.txt", "AAPL_2022_2.txt"]


def test_analogy_and_cooccurrence(spark):
    space = spark.createDataFrame([("man", [1.0, 0.0]), ("woman", [-1.0, 0.0]), ("king", [1.0, 1.0]), ("queen", [-1.0, 1.0]), ("apple", [0.0, -1.0])], "w string, v array<double>")
    q = spark.createDataFrame([("man", "woman", "king")], "a string, b string, c string")
    assert vectors.analogies(q, space, "w", "v", 1).first()["w"] == "queen"
    c = {(r["a"], r["b"]): r["x"] for r in vectors.cooccurrence(sentences(spark, [["a", "b", "c"], ["b", "a"]]), 1).collect()}
    assert c == {("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 1, ("c", "b"): 1}


def test_splits_are_exact_and_stable(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = sampling.split(df, "k", 0.2, 1)
    assert a.filter("split = 'test'").count() == 21
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sampling.split(df.repartition(7), "k", 0.2, 1).collect()))
    assert sampling.split(df.filter("false"), "k", 0.2, 1).count() == 0


def test_mcnemar_and_holm(spark):
    a = spark.createDataFrame([(i, "x", "x" if i < 8 else "y") for i in range(10)], "k bigint, label string, prediction string")
    b = spark.createDataFrame([(i, "x", "x" if i >= 8 else "y") for i in range(10)], "k bigint, label string, prediction string")
    r = sentiment.mcnemar(a, b, "k").first()
    want = min(1.0, 2 * sum(math.comb(10, i) for i in range(3)) / 2**10)
    assert (r["only_a"], r["only_b"]) == (8, 2) and abs(r["p"] - want) < 1e-6
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: r["rejected"] for r in sentiment.holm(tests, "name", "p").collect()} == {"a": True, "c": False, "b": False}


@pytest.mark.parametrize("score, mode, want", [(5, "sentiment3", "positive"), (3, "sentiment3", "neutral"), (3, "binary", None), (5, "score5", "5"), (9, "score5", None), (None, "binary", None)])
def test_labels(spark, score, mode, want):
    assert spark.createDataFrame([(score,)], "s int").select(sentiment.label(F.col("s"), mode).alias("l")).first()["l"] == want


def test_in_vocabulary_by_list_and_by_join(spark, monkeypatch):
    train = spark.createDataFrame([("1-0", ["a", "b", "a"]), ("1-1", [])], "sid string, words array<string>")
    vocab = spark.createDataFrame([("a",)], "token string")
    want = {"1-0": ["a", "<unk>", "a"]}
    for most in (10, 0):
        monkeypatch.setattr(lm, "LISTED", most)
        assert {r["sid"]: r["words"] for r in lm.in_vocabulary(train, vocab).collect() if r["words"]} == want


def test_suggestions_fall_back(spark):
    train = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "d"],), (["a", "b", "c"],)], "words array<string>")
    contexts = spark.createDataFrame([(1, ["a", "b"]), (2, ["x", "b"]), (3, ["x"])], "k bigint, words array<string>")
    got = {(r["k"], r["order_n"]): (r["is_fallback"], r["w"]) for r in lm.suggestions(contexts, train, "k").filter("rank = 1").collect()}
    assert got[1, 3] == (False, "c") and got[2, 3] == (True, "c") and got[3, 2] == (True, "a") and got[3, 3] == (False, "a")


def test_winner_of_two_close_methods(spark):
    rows = [(3, "backoff", "d", 10.0, 100.0), (3, "laplace", "k", 9.0, 100.2), (2, "laplace", "k", 5.0, None), (2, "backoff", "d", 6.0, 50.0)]
    chosen = spark.createDataFrame(rows, "order_n bigint, method string, params string, dev_perplexity double, test_perplexity double")
    got = {r["order_n"]: (r["winner"], r["is_tie"]) for r in lm.winner(lm.ranking(chosen)).collect()}
    assert got == {3: ("laplace", True), 2: ("backoff", False)}


def test_labels_are_checked_and_grouped(spark):
    texts = spark.createDataFrame([(1, "Ev. Su"), (2, None)], "k bigint, text string")
    labels = spark.createDataFrame([(1, 2, 1), (1, 3, 0), (1, 9, 0), (2, 0, 1), (7, 0, 1)], "k bigint, char_index bigint, eos int")
    got = {(r["k"], r["char_index"]): r["fault"] for r in boundaries.invalid_labels(labels, texts, "k", "text").collect()}
    assert got == {(1, 3): "no stop", (1, 9): "outside", (2, 0): "outside", (7, 0): "no document"}
    first = boundaries.by_document(labels, "k").filter("k = 1").first()["labels"]
    assert [x["char_index"] for x in first] == [2, 3, 9]


def test_stops_of_a_long_text(spark):
    text = "".join(f"Söz{i}. " for i in range(3000))
    rows = boundaries.dots(spark.createDataFrame([(1, text)], "k bigint, t string"), "k", "t").orderBy("at").collect()
    assert [r["at"] for r in rows] == [i for i, c in enumerate(text) if c == "."] and [r["dot_index"] for r in rows] == list(range(3000))
    assert all(r["text"][r["p"]] == "." and r["text"] == text[r["at"] - r["p"] : r["at"] - r["p"] + len(r["text"])] for r in rows)


def test_encoded_sequences(spark):
    from loomtext.operators import sequences

    vocab = sequences.vocabulary(spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "token string, n bigint"), 2, 2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"c": 2, "a": 3}
    df = spark.createDataFrame([(1, ["a", "b", "c", "c"]), (2, []), (3, ["c"])], "k bigint, w array<string>")
    assert {r["k"]: (r["ids"], r["n"]) for r in sequences.encoded(df, "w", vocab, 3).collect()} == {1: ([3, 1, 2], 3), 2: ([1, 0, 0], 1), 3: ([2, 0, 0], 1)}
    assert {r["k"]: r["ids"] for r in sequences.encoded(df, "w", vocab).collect()} == {1: [3, 1, 2, 2], 2: [1], 3: [2]}


def test_unlike_rows_with_one_key_stay(spark):
    from loomtext.session import one_record

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "k bigint, t string")
    assert sorted((r["k"], r["t"] or "") for r in one_record(df, "k").collect()) == [(1, "a"), (1, "b"), (2, "")]


def test_analogies_by_rank(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0]), (5, [-1.0, 0.0])]
    space = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 9)], "a bigint, b bigint, c bigint, expected bigint")
    got = {r["expected"]: (r["is_known"], r["rank"]) for r in vectors.analogy_answers(asked, space, "id", "v", 2).collect()}
    assert got == {4: (True, 1), 9: (False, None)}


def test_singular_values_against_numpy(spark):
    import numpy as np

    m = np.random.default_rng(3).poisson(0.6, (40, 12))
    td = spark.createDataFrame([(int(i), f"w{j}", int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "k bigint, token string, tf bigint")
    assert np.allclose(vectors.singular_values(td, "k", 3, rounds=40), np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-4)
