import json
import struct

import pytest

from loomtext.sources import readers, sinks
from loomtext.streaming.token_counts import windowed_counts


def test_corpus_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(5, 'a "q"\nb'), (7, "c")], "k bigint, text string")
    sinks.corpus_csv(df, "k", str(tmp_path / "c"))
    rows = readers.corpus(spark, str(tmp_path / "c")).orderBy("k").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [("0", 'a "q"\nb'), ("1", "c")]
    with pytest.raises(FileNotFoundError):
        readers.corpus(spark, str(tmp_path / "none"))
    (tmp_path / "x.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.corpus(spark, str(tmp_path / "x.csv"))


def test_dot_labels_are_checked(spark, tmp_path):
    head = "row_id,doc_idx,doc_id,char_index,char,left_context,right_context,window_text,prev_char,next_char,prev_token,next_token,rule_guess,gold_label,annotator_note,dot_idx_in_doc\n"
    row = "{},0,0,1,.,a,b,a.b,a,b,a,b,1,{},,0\n"
    good, bad, twice = tmp_path / "g.csv", tmp_path / "b.csv", tmp_path / "t.csv"
    good.write_text(head + row.format("r1", 1))
    bad.write_text(head + row.format("r1", 2))
    twice.write_text(head + row.format("r1", 1) * 2)
    assert readers.dot_labels(spark, str(good)).count() == 1
    for path in (bad, twice):
        with pytest.raises(ValueError):
            readers.dot_labels(spark, str(path))


def test_squad_json(spark, tmp_path):
    data = {"data": [{"title": "T", "paragraphs": [{"context": "Ev Var", "qas": [{"id": "1", "question": "Nə?", "answers": [{"text": "Ev", "answer_start": 0}]}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(data))
    r = readers.squad(spark, str(tmp_path / "s.json")).first()
    assert (r["context"], r["answers"], r["answer_starts"]) == ("ev var", ["ev"], [0])


def test_text_and_binary_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nalpha 1 2 3\nbeta 4 5 6\nshort 1 2\nbad 1 x 3\n")
    assert {r["word"]: r["vec"] for r in readers.text_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"alpha": [1, 2, 3], "beta": [4, 5, 6]}
    (tmp_path / "v.bin").write_bytes(b"1 2\nev " + struct.pack("<2f", 3, 4) + b"\n")
    r = readers.binary_vectors(spark, str(tmp_path / "v.bin")).first()
    assert r["word"] == "ev" and [round(x, 4) for x in r["vec"]] == [0.6, 0.8]


def test_latest_evaluation(spark, tmp_path):
    for name, q in (("rag_eval_1.json", "old"), ("rag_eval_2.json", "new")):
        (tmp_path / name).write_text(json.dumps({"records": [{"question": q}]}))
    assert readers.latest_evaluation(spark, str(tmp_path)).first()["question"] == "new"
    (tmp_path / "rag_eval_3.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError):
        readers.latest_evaluation(spark, str(tmp_path))


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "bir iki bir")], "t string, text string").selectExpr("cast(t as timestamp) as t", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, text string").parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "t", "text").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert {r["token"]: r["n"] for r in spark.table("counts").collect()} == {"bir": 2, "iki": 1}


def test_sql_functions(spark):
    from loomtext.functions.registry import register

    register(spark)
    assert spark.sql("select size(sentences_of('Bir ev. İki ev.')) as n").first()["n"] == 2
    rows = spark.sql("select sentence from (select 'Bir ev. İki ev.' as x) t, lateral sentence_rows(t.x)").collect()
    assert [r["sentence"] for r in rows] == ["Bir ev.", "İki ev."]
    assert spark.sql("select edits_between('ab', 'b')[0].op as op").first()["op"] == "del"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_writers_of_counts_and_lines(spark, tmp_path):
    counts = spark.createDataFrame([("ev", 2), ("su", 3), ("ad", 2)], "token string, n bigint")
    sinks.counts_csv(counts, str(tmp_path / "c"), 2)
    assert rows_of(spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("token")) == [("ad", "2"), ("su", "3")]
    sinks.vocabulary_text(counts, str(tmp_path / "v"))
    assert sorted(rows_of(spark.read.text(str(tmp_path / "v")))) == [("ad 2",), ("ev 2",), ("su 3",)]
    sinks.merges_text([("a", "b"), ("ab", "c")], spark, str(tmp_path / "m"))
    assert rows_of(spark.read.text(str(tmp_path / "m"))) == [("a b",), ("ab c",)]
    sinks.json_summary(counts.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.sentence_lines(spark.createDataFrame([(["bir", "ev"],)], "words array<string>"), "words", str(tmp_path / "s"))
    assert rows_of(spark.read.text(str(tmp_path / "s"))) == [("bir ev",)]


def test_writers_of_matrices_and_vectors(spark, tmp_path):
    entries = spark.createDataFrame([("ev", "x", 2), ("su", "y", 3)], "w string, d string, n int")
    sinks.sparse_matrix(entries, "w", "d", "n", str(tmp_path / "s"))
    assert sorted(rows_of(spark.read.parquet(str(tmp_path / "s")))) == [("ev", "x", 2.0), ("su", "y", 3.0)]
    sinks.dense_matrix_csv(entries, "w", "d", "n", ["x", "y"], str(tmp_path / "d"))
    assert sorted(rows_of(spark.read.option("header", True).csv(str(tmp_path / "d")))) == [("ev", "2", "0"), ("su", "0", "3")]
    sinks.vectors_text(spark.createDataFrame([("ev", [1.0, 2.5])], "word string, vec array<float>"), str(tmp_path / "v"))
    assert rows_of(readers.text_vectors(spark, str(tmp_path / "v"))) == [("ev", [1.0, 2.5])]
    wanted = spark.createDataFrame([("ev",)], "word string")
    assert rows_of(readers.subset_vectors(readers.text_vectors(spark, str(tmp_path / "v")), wanted, 3)) == [("ev", [1.0, 2.5, 0.0])]


def test_text_files_are_named(spark, tmp_path):
    df = spark.createDataFrame([("A_2020", "bir"), ("B_2021", "ə"), ("C_2022", None)], "name string, text string")
    assert sorted(rows_of(sinks.text_files(df, "name", "text", str(tmp_path)))) == [("A_2020", 3), ("B_2021", 2), ("C_2022", 0)]
    assert (tmp_path / "A_2020.txt").read_text() == "bir" and (tmp_path / "C_2022.txt").read_text() == ""
    got = readers.text_folder(spark, str(tmp_path)).orderBy("source_file").select("source_file", "ticker", "year").collect()
    assert [tuple(r) for r in got] == [("A_2020.txt", "A", 2020), ("B_2021.txt", "B", 2021)]


def test_vector_index_takes_the_place_of_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        readers.vector_store(spark, path)
    row = "id bigint, collection string, vec array<float>"
    sinks.vector_index(spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], row), path, "id")
    sinks.vector_index(spark.createDataFrame([(2, "b", [3.0]), (3, "a", [4.0])], row), path, "id")
    assert sorted((r["id"], r["vec"][0]) for r in readers.vector_store(spark, path).collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    assert readers.vector_store(spark, path, "a").count() == 2
    with pytest.raises(ValueError):
        readers.vector_store(spark, path, "none")
    sinks.vector_index(spark.createDataFrame([(9, "a", [1.0])], row), path, "id", rebuild=True)
    assert readers.vector_store(spark, path).count() == 1


def test_results_and_report(spark, tmp_path):
    records = spark.createDataFrame([("q", ["a", "b"])], "question string, sources array<string>")
    sinks.results(records, spark.createDataFrame([("rate", 0.5)], "name string, value double"), str(tmp_path))
    assert rows_of(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "records.csv"))) == [("q", '["a","b"]')]
    assert spark.read.json(str(tmp_path / "metrics.json")).first()["value"] == 0.5
    sections = spark.createDataFrame([("b", "x", "1"), ("a", "z", None), ("a", "y", "2")], "section string, name string, value string")
    assert sinks.report_markdown(sections).first()["markdown"] == "## a\n\n- y: 2\n- z: n/a\n\n## b\n\n- x: 1"


def test_small_readers(spark, tmp_path):
    (tmp_path / "b.json").write_text("[3, 17]")
    assert sorted(r["idx"] for r in readers.boundary_places(spark, str(tmp_path / "b.json")).collect()) == [3, 17]
    (tmp_path / "r.csv").write_text("ticker,year,preprocessed_content\nA,2020,x\n")
    assert readers.reports(spark, str(tmp_path / "r.csv")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"sub": {"a->b": 2}, "del": {"x": 1}}))
    assert sorted(rows_of(readers.confusion_costs(spark, str(tmp_path / "c.json")))) == [("del", "", "x", 1.0), ("sub", "a", "b", 2.0)]
    (tmp_path / "l.txt").write_text("birinci  ev\n")
    assert readers.corpus_lines(spark, str(tmp_path / "l.txt"), "</s>", 3).first()["words"] == ["bir", "ev", "</s>"]
    labels = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    assert readers.label_order(labels).count() == 2
