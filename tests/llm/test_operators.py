"""The operators over small tables: dirty rows, ties, copies, empty tables, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomtext.llm.queries")
from loomtext.llm import lookalikes, neighbours, overlap, packing, pieces, quality, queries, repair, sentences, terms, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(spark, rows):
    return spark.createDataFrame(rows, "k bigint, text string, term string, class int, words int")


DIRTY = [(1, None, "x", 1, 1), (2, "", None, None, 1), (3, " 　", "x", 1, None), (4, "Bir ev. İki ev.", "x", 1, 1), (4, "Bir ev. İki ev.", "x", 1, 1)]


def test_sentence_rows(spark):
    got = sentences.split(texts(spark, DIRTY[:4]), ["k"], "text").collect()
    assert [(r["k"], r["start_char"], r["end_char"]) for r in got] == [(4, 0, 7), (4, 8, 15)]
    assert sentences.split(texts(spark, []), ["k"], "text").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pieces_rebuild_the_text(spark, seed):
    random.seed(seed)
    rows = [(i, "".join(random.choices("ab c.\n　。​ə😀" if i % 3 else "x", k=random.choice((0, 9, 2000, 2001, 5000, 9000)))), "t", 0, 0) for i in range(12)]
    got = {}
    for r in pieces.pieces(texts(spark, [*rows, (99, None, "t", 0, 0)]), ["k"], "text").collect():
        got.setdefault(r["k"], []).append(r)
    assert set(got) == {r[0] for r in rows}
    for k, text, *_ in rows:
        end, longest, run = 0, 0, 0
        for c in text:
            run = 0 if c.isspace() else run + 1
            longest = max(longest, run)
            run = 0 if c in ".!?。！？…" else run
        for i, r in enumerate(sorted(got[k], key=lambda r: r["piece"])):
            assert r["start_char"] == (max(0, end - 200) if i else 0) and r["piece_text"] == text[r["start_char"] : r["end_char"]]
            assert len(r["piece_text"]) <= 2000 and r["end_char"] > end or not text
            end = r["end_char"]
            assert r["cut_kind"] == (None if len(text) <= 2000 else "forced" if longest > 2000 else "natural")
        assert end == len(text)


def test_look_alike_pairs(spark):
    rows = [("o", 1, "Salam ev"), ("o", 2, "Ѕalam ev"), ("o", 2, "Ѕalam ev"), ("o", 3, "Salam ev"), ("p", 4, "Ｓalam ev"), ("o", 5, "salam ev"), ("o", 6, None), ("o", 7, " "), ("o", 8, "​")]
    df = spark.createDataFrame(rows, "origin string, key bigint, text string")
    got = lookalikes.look_alike_pairs(lookalikes.fingerprints(df, ["origin", "key"], "text"), "key", "origin").collect()
    assert sorted((r["key_a"], r["key_b"]) for r in got) == [(1, 2), (2, 3)]
    classes = lookalikes.look_alike_classes(lookalikes.fingerprints(df, ["origin", "key"], "text"), "key", "origin").collect()
    assert sorted((r["key"], r["texts"], r["records"]) for r in classes) == [(1, 2, 3), (2, 2, 3), (3, 2, 3)]
    forms = lookalikes.one_form(df, "text", "form").select("key", "form").collect()
    assert {r["form"] for r in forms} == {"Salam ev", "salam ev", None, ""}


def test_overlap_against_brute_force(spark):
    random.seed(8)
    base = [" ".join(random.choices([f"söz{i}" for i in range(60)], k=random.randint(7, 30))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = random.choice(base).split()
        random.shuffle(words)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(len(words))] = f"yeni{random.randint(0, 40)}"
        rows.append((i, random.choice(("train", "train", "test", "validation", None)), " ".join(words), "s"))
    rows += [(900, "train", None, "s"), (901, "test", "", "s"), rows[0]]
    got = overlap.overlaps(spark.createDataFrame(rows, "id bigint, split string, content string, source string"), "id", "content", "split", ["source"])
    from collections import Counter

    kept = {r[0]: (r[1], Counter(overlap.plain(w) for w in r[2].split())) for r in rows if r[1] and r[2] and len(r[2].split()) >= 8}
    want = {(a, b) for a, (x, p) in kept.items() if x == "train" for b, (y, q) in kept.items() if y != "train" and sum((p & q).values()) >= 0.8 * max(p.total(), q.total())}
    assert {(r["key_a"], r["key_b"]) for r in got.collect()} == want and want


def test_overlap_when_common_words_are_many(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_WORDS", 2)
    rows = [(i, "train" if i % 2 else "test", f"a b c d e f g h i{i // 2}", "s") for i in range(60)]
    got = overlap.overlaps(spark.createDataFrame(rows, "id bigint, split string, content string, source string"), "id", "content", "split").count()
    assert got == 30 * 30


def unit_rows(spark, n=1500, seed=9):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, 16))
    m[::3] = m[rng.integers(0, n // 10, len(m[::3])) * 3] + 0.1 * rng.standard_normal((len(m[::3]), 16))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    return m, spark.createDataFrame([*rows, rows[0], (n, None), (n + 1, [0.0] * 16), (n + 2, [1.0]), (n + 3, [float("nan")] * 16)], "id bigint, vec array<double>")


def test_neighbours_have_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    monkeypatch.setattr(neighbours, "MEET", 10)
    monkeypatch.setattr(neighbours, "UNIT", 500)
    m, df = unit_rows(spark)
    vectors = neighbours.unit_vectors(df, "id", "vec")
    assert vectors.count() == len(m)
    lists = neighbours.neighbour_lists(vectors)
    exact = neighbours.exact_neighbours(vectors, vectors.filter("id % 10 = 0"), block=64)
    row = queries.recall(exact, lists).first()
    assert row["recall"] >= 0.9 and row["recall_close"] >= 0.99
    nodes, graph, leaves = neighbours.build(vectors)
    assert queries.recall(exact, neighbours.search(nodes, graph, leaves, vectors.filter("id % 10 = 0"))).first()["recall_close"] >= 0.9


def test_neighbours_of_copies_and_of_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)] + [(30, [2.0, 1.0])], "id bigint, vec array<double>")
    lists = neighbours.neighbour_lists(neighbours.unit_vectors(df, "id", "vec"))
    by = {}
    for r in lists.collect():
        by.setdefault(r["id"], []).append(r["near_id"])
    assert set(by) == {*range(20), 30} and sorted(by[15]) == [0, 1, 2, 3, 4] and sorted(by[0]) == [1, 2, 3, 4, 5]
    assert neighbours.neighbour_lists(neighbours.unit_vectors(df.filter("false"), "id", "vec")).count() == 0


def test_deltas_give_the_state_of_a_fresh_count(spark, tmp_path):
    old = spark.createDataFrame([(1, "ev ev su"), (2, "su"), (3, None)], "k bigint, t string")
    new = spark.createDataFrame([(1, "ev dağ"), (3, "dağ dağ"), (4, " ")], "k bigint, t string")
    counts = lambda df: {(r["term"], r["occurrences"], r["records"]) for r in df.filter("term <> ''").select("term", "occurrences", "records").collect()}
    records = lambda: terms.read_state(spark, path).filter("term = ''").first()["records"]
    fresh = terms.merge_counts(None, terms.term_deltas(terms.signed_changes(None, new, "k", "t")))
    path = str(tmp_path / "state")
    assert terms.read_state(spark, path).count() == 0
    terms.update_state(path, terms.term_deltas(terms.signed_changes(None, old, "k", "t")), 1)
    assert counts(terms.read_state(spark, path)) == {("ev", 2, 1), ("su", 2, 2)} and records() == 2
    for _ in range(2):  # the second time the batch is in the state already
        terms.update_state(path, terms.term_deltas(terms.signed_changes(old, new, "k", "t")), 2)
        assert counts(terms.read_state(spark, path)) == counts(fresh) == {("ev", 1, 1), ("dağ", 3, 2)} and records() == 2
    terms.update_state(path, terms.term_deltas(terms.signed_changes(new, new.filter("false"), "k", "t")), 3)
    assert terms.read_state(spark, path).count() == 0


def test_changed_texts_alone_are_fetched(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e"), (5, "e")], "k bigint, t string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, "b"), (4, "b")], "k bigint, t string")
    got = sorted((r["text"], r["sign"]) for r in terms.signed_changes(old, new, "k", "t").collect())
    assert got == [("b", -1), ("b", 1), ("c", 1), ("d", 1), ("e", -1)]


def test_saved_counts(spark):
    rows = [("ev", 0, 5, "2024-01-02", 2), ("ev", 0, 9, "2024-01-01", 1), ("ev", 1, 1, "2024-01-01", 3), (None, 0, 3, "2024-01-01", 4), ("su", 0, None, "2024-01-01", 5)]
    df = spark.createDataFrame(rows, "word string, batch_no bigint, cn bigint, saved_at string, vocab_id bigint")
    assert [(r["term"], r["occurrences"], r["records"]) for r in terms.saved_deltas(df).collect()] == [("ev", 6, 2)]
    assert [r["occurrences"] for r in terms.saved_deltas(df, "2024-01-01").collect()] == [-4]


def test_page_quality(spark):
    prose = [(i, "Bu gün böyük kitab və köhnə dəftər çox yaxşı yazılıb. Sonra bir ilə görə kiçik məktəb tikilib, amma göl olan kimi qalıb. " * (1 + i % 7), "x", 0, 0) for i in range(60)]
    junk = [(100, "\n".join(f"- Ad{i}" for i in range(30)), "x", 0, 0), (101, "\n".join(f"a{i} | {i} | 5.5%" for i in range(30)), "x", 0, 0), (102, None, "x", 0, 0), (103, " ", "x", 0, 0)]
    got = quality.rate(texts(spark, prose + junk), "k", "text", {"az": ["və", "bir", "ilə", "çox", "sonra", "amma", "görə", "olan", "kimi", "bu"]}).collect()
    assert {int(r["key"]) for r in got if r["is_junk"]} == {100, 101} and len(got) == 62
    assert all(abs(sum(r["contributions"]) - r["distance"]) < 1e-6 for r in got)
    assert quality.rate(texts(spark, []), "k", "text", {}).count() == 0


def test_ids_round_trip(spark):
    df = texts(spark, [*DIRTY[:4], (5, "a" * 2000, "t", 1, 1)])
    ids = tokens.encode(df.withColumn("ids0", F.lit(1)))
    back = {r["k"]: r["text"] for r in tokens.decode(ids).select("k", "text").collect()}
    assert back == {1: "", 2: "", 3: " 　", 4: "Bir ev. İki ev.", 5: "a" * 2000}
    assert tokens.encode(texts(spark, [])).count() == 0


def test_packing(spark):
    random.seed(10)
    sizes = [(i, random.choice((None, 0, 3, 3, 3, 7, 50, 64, 65, 200))) for i in range(500)]
    rows = packing.pack(spark.createDataFrame(sizes, "key bigint, n int"), "key", "n", 64).collect()
    parts, used = {}, {}
    for r in rows:
        parts.setdefault(r["key"], []).append(r["n"])
        if r["container"] is not None:
            used[r["container"]] = used.get(r["container"], 0) + r["n"]
    assert {k: sum(v) for k, v in parts.items()} == {k: n or 0 for k, n in sizes}
    assert all(len(parts[k]) == 1 for k, n in sizes if (n or 0) <= 64) and max(used.values()) <= 64
    assert len(used) <= -(-sum(used.values()) // 64) + 2
    assert packing.pack(spark.createDataFrame([], "key bigint, n int"), "key", "n", 64).count() == 0


def test_garbled_documents(spark):
    clean = [(i, f"Məktəbdə böyük şəhər haqqında yeni kitab oxundu, çünki dəniz {i} göründü.", "s") for i in range(120)]
    table = {b: chr(c) for c, b in repair.bytes_of("cp1252").items()}
    spoilt = [(500 + i, "".join(table[b] for b in clean[i][1].encode()), "s") for i in range(5)] + [(600, "M?kt?bd? böyük ş?h?r", "t"), (700, None, None), (701, "", "s")]
    df = spark.createDataFrame(clean + spoilt, "k bigint, text string, source string")
    got = {r["key"]: r["restored"] for r in repair.find_garbled(df, "k").collect()}
    assert set(got) == {500, 501, 502, 503, 504, 600} and got[501] == clean[1][1]
    assert repair.find_garbled(df.filter("false"), "k").count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_ids", "p9_fill", "p10_found"])
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
