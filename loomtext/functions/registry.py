"""The Arrow functions and a table function under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext.functions import udfs


@F.udtf(returnType="sent_id int, sentence string")
class Sentences:
    """``select * from t, lateral sentence_rows(t.text)``: the sentences of a prepared text."""

    def eval(self, text: str):
        for i, sentence in enumerate(udfs.segmented(text or "")):
            yield i, sentence


def register(spark: SparkSession) -> None:
    spark.udf.register("sentences_of", udfs.segments)
    spark.udf.register("edits_between", udfs.alignment)
    spark.udf.register("words_with_places", udfs.words_with_places)
    spark.udf.register("typed_variants", udfs.variants())
    spark.udf.register("composed", udfs.composed)
    spark.udtf.register("sentence_rows", Sentences)
