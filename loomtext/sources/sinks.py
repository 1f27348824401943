"""Writers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.session import cut_lineage
from loomtext.sources import readers


def counts_csv(counts: DataFrame, path: str, top: int = 0) -> None:
    """Counts by size, then word; ``top`` of 0 writes all."""
    rows = counts.orderBy(F.desc("n"), "token")
    (rows.limit(top) if top else rows).write.mode("overwrite").option("header", True).csv(path)


def corpus_csv(df: DataFrame, order: str, path: str) -> None:
    """A corpus with ``doc_id`` from 0 in order. Numbers come from range partitions' counts, not from one window over all rows."""
    ranged = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}  # one row a partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts, "__p int, __o bigint")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    ranged.withColumn("__k", place).join(F.broadcast(offsets), "__p").withColumn("doc_id", F.col("__o") + F.col("__k")).drop("__p", "__k", "__o").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def sentence_lines(sentences: DataFrame, words: str, path: str) -> None:
    sentences.select(F.array_join(words, " ")).write.mode("overwrite").text(path)


def merges_text(merges: list[tuple[str, str]], spark: SparkSession, path: str) -> None:
    """Ordered merges, one a line (as many as were asked for)."""
    spark.createDataFrame([(f"{a} {b}",) for a, b in merges], "value string").coalesce(1).write.mode("overwrite").text(path)


def vocabulary_text(counts: DataFrame, path: str) -> None:
    """``word count`` lines, the commonest first."""
    counts.orderBy(F.desc("n"), "token").select(F.concat_ws(" ", "token", F.col("n").cast("string"))).write.mode("overwrite").text(path)


def vectors_text(vectors: DataFrame, path: str) -> None:
    """A word and its numbers on each line, as ``readers.text_vectors`` reads them."""
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws(" ", "word", numbers)).write.mode("overwrite").text(path)


def sparse_matrix(entries: DataFrame, row: str, column: str, value: str, path: str) -> None:
    """A matrix as its entries, in parquet: ``row``, ``col`` and ``value``."""
    entries.select(F.col(row).alias("row"), F.col(column).alias("col"), F.col(value).cast("double").alias("value")).write.mode("overwrite").parquet(path)


def dense_matrix_csv(entries: DataFrame, row: str, column: str, value: str, columns: list[str], path: str) -> None:
    """A stated set of columns as one CSV with a line a row; what has no entry is 0."""
    entries.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0).orderBy(row).write.mode("overwrite").option("header", True).csv(path)


def text_files(df: DataFrame, name: str, text: str, folder: str) -> DataFrame:
    """Writes ``<folder>/<name>.txt`` for every row, each in its task; gives back ``(name, bytes)``. Names have to differ.

    A task that is run again writes the same files again.
    """
    source = df.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        for batch in batches:
            names, texts = batch.column("name").to_pylist(), batch.column("text").to_pylist()
            sizes = []
            for one, content in zip(names, texts, strict=True):
                data = content.encode("utf-8", "replace")
                with files.open_output_stream(f"{base}/{one}.txt") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return cut_lineage(source.mapInArrow(run, "name string, bytes bigint"))


def vector_index(df: DataFrame, path: str, key: str, rebuild: bool = False) -> None:
    """Puts rows into an index; a row takes the place of that with its key. ``rebuild`` begins anew.

    A version is a folder of its own: readers see the last one that is complete, and older ones go when the new one is there.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = readers.index_version(spark, path)
    new = df.dropDuplicates([key])
    if last is not None and not rebuild:
        old = spark.read.parquet(f"{path}/version={last}")
        new = old.join(new.select(key), key, "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{path}/version={(last or 0) + 1}")
    if last is not None:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/version={last}"), True)


def results(records: DataFrame, metrics: DataFrame, path: str) -> None:
    """Records and metrics as JSON and as CSV; in the CSV what is nested is JSON."""
    for name, df in (("records", records), ("metrics", metrics)):
        df.write.mode("overwrite").json(f"{path}/{name}.json")
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields]
        df.select(flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}.csv")


def report_markdown(sections: DataFrame) -> DataFrame:
    """``(section, name, value)`` rows (a report's worth) as one text, sections and names in order."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("value", F.lit("n/a")))
    each = sections.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    text = F.concat(F.lit("## "), "section", F.lit("\n\n"), "body")
    return each.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def session_markdown(rows: DataFrame, order: str, question: str, answer: str) -> DataFrame:
    """One text: a heading and an answer for each exchange of one session, in order."""
    part = F.concat(F.lit("## "), F.coalesce(question, F.lit("")), F.lit("\n\n"), F.coalesce(answer, F.lit("")))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))
