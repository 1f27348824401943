"""Readers: files in, DataFrames out; what is required is checked by name and fails early."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators.sentiment import label
from loomtext.sources import schemas


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus CSV; only ``text`` is required, null becomes the empty text."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return require(csv(spark, path), "text").withColumn("text", F.coalesce("text", F.lit("")))


def sentiment(train: DataFrame, test: DataFrame, text: str, score: str, mode: str) -> DataFrame:
    """Both splits with labels and a ``split`` column; rows without label or text are dropped."""
    rows = [require(df, text, score).select(F.col(text).alias("content"), label(F.col(score).cast("string").try_cast("double"), mode).alias("label"), F.lit(name).alias("split")) for df, name in ((train, "train"), (test, "test"))]
    return rows[0].unionByName(rows[1]).filter(F.col("label").isNotNull() & F.col("content").isNotNull())


def label_order(df: DataFrame) -> DataFrame:
    """``(label, id)``: labels numbered from 0 in order of their names."""
    return df.select("label").distinct().withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)  # one row a label


def dot_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV, all text; blank or repeated ids and labels other than 0 and 1 are errors."""
    df = require(csv(spark, path, schemas.DOT_LABELS), "row_id", "gold_label")
    bad = df.agg(F.count_if(F.coalesce(F.trim("row_id"), F.lit("")) == "").alias("blank"), F.count_if(~F.coalesce(F.col("gold_label"), F.lit("")).isin("0", "1")).alias("domain")).first()
    if bad["blank"] or bad["domain"]:
        raise ValueError(f"{bad['blank']} blank row ids, {bad['domain']} labels that are neither 0 nor 1")
    twice = df.groupBy("row_id").count().filter("count > 1").orderBy("row_id").first()
    if twice:
        raise ValueError(f"row id twice: {twice['row_id']}")
    return df


def squad(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, title, context, question, answers, answer_starts)``, texts in lower case."""
    data = spark.read.schema(schemas.SQUAD).option("multiLine", True).json(path)
    p = data.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    q = p.select("title", "p.context", F.explode("p.qas").alias("q"))
    texts = F.transform("q.answers", lambda a: F.lower(a["text"]))
    return q.select(F.col("q.id").alias("question_id"), F.lower("title").alias("title"), F.lower("context").alias("context"), F.lower("q.question").alias("question"), texts.alias("answers"), F.col("q.answers.answer_start").alias("answer_starts"))


def text_vectors(spark: SparkSession, path: str, length: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """``(word, vec)`` from lines ``word x x …``; a header ``n d`` gives the length, else the commonest; other lines are skipped. With ``words`` only theirs come."""
    parts = spark.read.text(path).select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("p")).filter(F.size("p") > 1)
    if length is None:
        head = parts.filter((F.size("p") == 2) & F.forall("p", lambda x: x.rlike(r"^\d+$"))).first()
        common = parts.filter(F.size("p") > 2).groupBy(F.size("p").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = int(head["p"][1]) if head else common["n"] - 1 if common else 0
    vec = F.transform(F.slice("p", F.lit(2), F.lit(max(length, 1))), lambda x: x.try_cast("float"))
    found = parts.filter(F.size("p") == length + 1).select(F.element_at("p", 1).alias("word"), vec.alias("vec")).filter(~F.exists("vec", lambda x: x.isNull()))
    return found.join(words.select("word").distinct(), "word", "left_semi") if words is not None else found


def binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` from files ``n d`` then words and packed floats; vectors to unit length. One file is one task."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                head, _, rest = bytes(content).partition(b"\n")
                n, d = map(int, head.split())
                words, vectors, at = [], [], 0
                for _ in range(n):
                    end = rest.index(b" ", at)
                    v = np.frombuffer(rest[end + 1 : end + 1 + 4 * d], "<f4")
                    words.append(rest[at:end].strip().decode())
                    vectors.append((v / (np.sqrt((v * v).sum()) or 1)).tolist())
                    at = end + 1 + 4 * d
                yield pd.DataFrame({"word": words, "vec": vectors})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, vec array<float>")


def subset_vectors(space: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The vectors of wanted words alone, cut or filled with zeros to a length."""
    v = F.concat(F.slice("vec", 1, length), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - F.size("vec"), F.lit(0))))
    return space.join(wanted.select("word").distinct(), "word", "left_semi").withColumn("vec", v)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank; none is an error."""
    df = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    if df.isEmpty():
        raise ValueError(f"nothing in {path}")
    return df


def boundary_places(spark: SparkSession, path: str) -> DataFrame:
    """Numbers from a JSON array or from lines."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))).alias("x")).select(F.col("x").cast("int").alias("idx"))


def corpus_lines(spark: SparkSession, path: str, boundary: str | None = None, longest: int | None = None) -> DataFrame:
    """``words`` of each line, split at blanks and tabs; a boundary word may end each, and words may be cut to a length."""
    words = F.filter(F.split(F.replace("value", F.lit("\r"), F.lit("")), r"[ \t]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.left(w, F.lit(longest))) if longest else words
    return spark.read.text(path).select((F.concat(words, F.array(F.lit(boundary))) if boundary else words).alias("words"))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, text, ticker, year)`` of all ``.txt`` files below a folder."""
    df = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    name = F.col("_metadata.file_name")
    return df.select(name.alias("source_file"), F.col("value").alias("text"), tx.ticker_of(name).alias("ticker"), tx.year_of(name).alias("year"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    return require(csv(spark, path), "ticker", "year", "preprocessed_content")


def confusion_costs(spark: SparkSession, path: str) -> DataFrame:
    """``(op, a, b, n)`` from a JSON object of objects whose keys read ``a->b``, split at the first arrow."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("op", "m")).select("op", F.explode("m").alias("k", "n"))
    arrow = F.instr("k", "->")
    return rows.select("op", F.when(arrow > 0, F.left("k", arrow - 1)).otherwise("").alias("a"), F.when(arrow > 0, F.substring(F.col("k"), arrow + 2, F.length("k"))).otherwise(F.col("k")).alias("b"), "n")


def index_version(spark: SparkSession, path: str) -> int | None:
    """The last complete version of a vector index."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    complete = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(complete, default=None)


def vector_store(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """A vector index, or one of its collections; one that is not there or is empty is an error."""
    version = index_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no index in {path}")
    df = spark.read.parquet(f"{path}/version={version}")
    df = df.filter(F.col("collection") == collection) if collection is not None else df
    if df.isEmpty():
        raise ValueError(f"nothing in {path}" + (f", collection {collection}" if collection else ""))
    return df


def latest_evaluation(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """The records of the last file ``rag_eval_*.json`` by name that has ``least`` of them; a payload without records is an error."""
    df = spark.read.schema(schemas.EVALUATION).option("multiLine", True).option("pathGlobFilter", "rag_eval_*.json").json(folder).select("*", F.col("_metadata.file_name").alias("file"))
    last = df.filter(F.coalesce(F.size("records"), F.lit(0)) >= least).agg(F.max("file")).first()[0] if least else df.agg(F.max("file")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no evaluation in {folder}")
    rows = df.filter(F.col("file") == last)
    if rows.filter("records is null").head(1):
        raise ValueError(f"no records in {last}")
    return rows.select("file", F.inline("records"))
