"""Queries on term matrices and embedding spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import arrays as ar
from loomtext.operators import vectors
from loomtext.operators.corpus import token_rows
from loomtext.plans.common import LINES, TOKENS, counts, docs, sentences, tokens_sql
from loomtext.session import cut_lineage, one_record, sole_record, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TD = f"t as (select doc_id, unnest({tokens_sql('text')}) as token from documents), c as (select token, count(*) as n from t group by token), td as (select doc_id, token, count(*) as tf from t group by doc_id, token)"
TOP = "v as (select token from c order by n desc, token limit 50)"


def term_table(spark, d):
    return vectors.term_document(token_rows(docs(spark, d), "doc_id", "text"), "doc_id")


def top_words(spark, d, k=50):
    return cut_lineage(counts(spark, d).orderBy(F.desc("n"), "token").limit(k).select("token"))


query("term_doc", f"with {TD} select doc_id, token, tf from td")(term_table)


@query("term_doc_pivot", f"with {TD}, w as (select token from c order by n desc, token limit 5) select token, sum(case when doc_kind = 'article' then tf else 0 end)::bigint as article, sum(case when doc_kind = 'report' then tf else 0 end)::bigint as report, sum(case when doc_kind = 'qa' then tf else 0 end)::bigint as qa, sum(case when doc_kind = 'review' then tf else 0 end)::bigint as review from td join documents using (doc_id) where token in (from w) group by token")
def term_doc_pivot(spark, d):
    rows = term_table(spark, d).join(F.broadcast(top_words(spark, d, 5)), "token").join(docs(spark, d).select("doc_id", "doc_kind"), "doc_id")
    return rows.groupBy("token").pivot("doc_kind", ["article", "report", "qa", "review"]).agg(F.sum("tf")).na.fill(0)


VOCABULARY = f"{LINES}, wc as (select token, count(*) as n from (select unnest(words) as token from s) group by token), v as (select token from wc where n >= 20), fw as (select sid, list(token order by k) as words from (select sid, unnest(words) as token, generate_subscripts(words, 1) as k from s) semi join v using (token) group by sid)"

def pair_sql(source, window):
    return f"select unnest(flatten(list_transform(generate_series(1, len(words) - 1), lambda i: list_transform(generate_series(i + 1, least(i + {window}, len(words))), lambda j: {{'a': words[i], 'b': words[j], 'd': j - i}}))), recursive := true) from {source} where len(words) > 1"


COOC = f"{VOCABULARY}, pp as ({pair_sql('fw', 2)}), co as (select a, b, count(*) as x from (select a, b from pp where a <> b union all select b, a from pp where a <> b) group by a, b)"


def vocabulary(spark, d):
    words = sentences(spark, d).select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return cut_lineage(words.filter("n >= 20"))


query("cooc_window", f"with {COOC} select a, b, x from co")(lambda spark, d: vectors.cooccurrence(sentences(spark, d), 2, vocabulary(spark, d)))
query("cooc_weighted", f"with {VOCABULARY}, pp as ({pair_sql('fw', 15)}) select a, b, round(sum(1.0::double / d), 6) as x from (select a, b, d from pp union all select b, a, d from pp) group by a, b")(lambda spark, d: vectors.cooccurrence(sentences(spark, d), 15, vocabulary(spark, d), weighted=True).withColumn("x", F.round("x", 6)))
query("ppmi", f"with {COOC}, r as (select a, sum(x) as r from co group by a), z as (select co.a, co.b, round(ln(x * (select sum(r) from r)::double / (p.r * q.r)), 6) as ppmi from co join r p on p.a = co.a join r q on q.a = co.b) select * from z where ppmi > 0")(lambda spark, d: vectors.ppmi(cut_lineage(vectors.cooccurrence(sentences(spark, d), 2, vocabulary(spark, d)))))
query("doc_cooc", f"with {TD}, {TOP}, w as (select doc_id, token from td semi join v using (token)) select a.token as a, b.token as b, count(*) as docs from w a join w b on a.doc_id = b.doc_id and a.token < b.token group by 1, 2")(lambda spark, d: vectors.document_cooccurrence(token_rows(docs(spark, d), "doc_id", "text"), "doc_id", top_words(spark, d)))
query("tfidf", f"with {TD}, df as (select token, count(*) as df from td group by token), w as (select doc_id, token, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from td join df using (token)) select doc_id, token, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w")(lambda spark, d: vectors.tfidf(term_table(spark, d), "doc_id", docs(spark, d).count()))
query("phrases", f"with {LINES}, o as (select token, count(*) as n from (select unnest(words) as token from s) group by token), pp as ({pair_sql('s', 1)}), b as (select a, b, count(*) as ab from pp group by a, b having count(*) >= 5), z as (select b.a, b.b, round((ab - 5) / p.n / q.n * (select sum(n) from o), 6) as score from b join o p on p.token = b.a join o q on q.token = b.b where p.n >= 5 and q.n >= 5) select * from z where score > 20")(lambda spark, d: vectors.phrases(sentences(spark, d), 5, 20.0))


@query("singular_values")
def singular_values(spark, d):
    td = term_table(spark, d).join(F.broadcast(top_words(spark, d, 200)), "token")
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(vectors.singular_values(td, "doc_id", 5))], "rank bigint, value double")


# ---- embedding spaces: queries are the rows whose id is divisible by 100
WORDS = "w as (select distinct on (word_id) word_id, word, vec::double[] as v from word_vectors where len(vec) = 96 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0)"


def space(spark, d):
    return cut_lineage(vectors.usable(one_record(table(spark, d, "word_vectors").select("word_id", "word", "vec"), "word_id"), "vec", 96))


def read_space(spark, d):
    """``space`` for a query that goes through it once: read from its table, not from a copy of it in the shared folder."""
    return vectors.usable(sole_record(table(spark, d, "word_vectors").select("word_id", "word", "vec"), "word_id"), "vec", 96)


@query("knn", f"with {WORDS} select a.word_id as q, b.word_id as word_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity, row_number() over (partition by a.word_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.word_id) as rank from w a join w b on a.word_id <> b.word_id where a.word_id % 100 = 0 qualify rank <= 3")
def knn(spark, d):
    s = read_space(spark, d)
    return vectors.asked(s.filter("word_id % 100 = 0").select(F.col("word_id").alias("q"), F.col("vec").alias("qv")), s, "word_id", "vec", 3)


@query("knn_forty", f"with {WORDS} select a.word_id as q, b.word_id as word_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity, row_number() over (partition by a.word_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.word_id) as rank from w a join w b on a.word_id <> b.word_id where a.word_id % 100 = 0 qualify rank <= 40")
def knn_forty(spark, d):
    """The forty nearest words of each word that is asked."""
    s = read_space(spark, d)
    return vectors.asked(s.filter("word_id % 100 = 0").select(F.col("word_id").alias("q"), F.col("vec").alias("qv")), s, "word_id", "vec", 40)


def questions(spark):
    return spark.createDataFrame([(a, a + 1, a + 2) for a in (10, 110, 210)], "a bigint, b bigint, c bigint")


def analogy_sql(unit):
    v = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))" if unit else "v"
    return f"""with {WORDS}, u as (select word_id, {v} as v from w), q as (select unnest([10, 110, 210])::bigint as a), k as (select q.a, q.a + 1 as b, q.a + 2 as c, list_transform(list_zip(x.v, y.v, z.v), lambda t: t[2] - t[1] + t[3]) as qv from q join u x on x.word_id = q.a join u y on y.word_id = q.a + 1 join u z on z.word_id = q.a + 2)
select a, b, c, word_id, round(list_cosine_similarity(qv, v), 6) as similarity, row_number() over (partition by a order by round(list_cosine_similarity(qv, v), 6) desc, word_id) as rank from k join w on word_id not in (a, b, c) qualify rank <= 5"""


query("analogy_raw", analogy_sql(False))(lambda spark, d: vectors.analogies(questions(spark), space(spark, d), "word_id", "vec", 5))
query("analogy_unit", analogy_sql(True))(lambda spark, d: vectors.analogies(questions(spark), space(spark, d), "word_id", "vec", 5, unit=True))


# ---- analogy questions: one for each word whose id is divisible by 100; the first five of fourteen files are semantic ones
FILES, SEMANTIC, FIRST_ANSWERS = 14, 5, 10
ANSWERS = f"""{WORDS}, u as (select word_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from w), q as (select distinct word_id as a, word_id + 1 as b, word_id + 2 as c, word_id + 3 as expected from word_vectors where word_id % 100 = 0),
k as (select q.*, list_transform(list_zip(x.v, y.v, z.v), lambda t: t[2] - t[1] + t[3]) as qv from q join u x on x.word_id = a join u y on y.word_id = b join u z on z.word_id = c semi join u e on e.word_id = expected),
s as (select a, word_id, row_number() over (partition by a order by round(list_cosine_similarity(qv, v), 6) desc, word_id) as rank from k join w on word_id not in (a, b, c) qualify rank <= {FIRST_ANSWERS}),
an as (select q.*, (a // 100) % {FILES} as file, k.a is not null as is_known, rank from q left join k using (a, b, c, expected) left join s on s.a = q.a and s.word_id = expected)"""


def answers(spark, d):
    ids = table(spark, d, "word_vectors").filter("word_id % 100 = 0").select(F.col("word_id").alias("a")).distinct()
    asked = ids.select("a", (F.col("a") + 1).alias("b"), (F.col("a") + 2).alias("c"), (F.col("a") + 3).alias("expected"))
    return vectors.analogy_answers(asked, read_space(spark, d), "word_id", "vec", FIRST_ANSWERS)


query("analogy_answers", f"with {ANSWERS} select a, b, c, expected, is_known, rank from an")(answers)
query("analogy_summary", f"with {ANSWERS} select count(*) as asked, coalesce(count_if(is_known), 0)::bigint as evaluated, coalesce(count_if(not is_known), 0)::bigint as skipped, round(coalesce(count_if(rank = 1) / nullif(count_if(is_known), 0), 0), 6) as hit_1, round(coalesce(count_if(rank is not null) / nullif(count_if(is_known), 0), 0), 6) as hit_k from an")(
    lambda spark, d: answers(spark, d).agg(
        F.count("*").alias("asked"), F.count_if("is_known").alias("evaluated"), F.count_if(~F.col("is_known")).alias("skipped"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("rank") == 1), F.count_if("is_known")), F.lit(0.0)), 6).alias("hit_1"), F.round(F.coalesce(F.try_divide(F.count("rank"), F.count_if("is_known")), F.lit(0.0)), 6).alias("hit_k"),
    )
)


@query("analogy_rollup", f"with {ANSWERS}, x as (select case when file < {SEMANTIC} then 'semantic' else 'syntactic' end as kind, file, rank from an where is_known) select kind, file::bigint as file, count(*) as asked, count_if(coalesce(rank = 1, false))::bigint as hits, round(count_if(coalesce(rank = 1, false)) / count(*), 6) as accuracy from x group by rollup (kind, file) having count(*) > 0")
def analogy_rollup(spark, d):
    """Accuracy of the first answer by kind, by file within it, and over all."""
    rows = answers(spark, d).filter("is_known").withColumn("file", F.floor(F.col("a") / 100) % FILES).withColumn("kind", F.when(F.col("file") < SEMANTIC, "semantic").otherwise("syntactic"))
    hits = F.count_if(F.coalesce(F.col("rank") == 1, F.lit(False)))
    return rows.rollup("kind", "file").agg(F.count("*").alias("asked"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("accuracy"))


query("neighbour_cosine", f"with {WORDS}, x as (select round(list_cosine_similarity(a.v, b.v), 6) as s from w a join w b on a.word_id <> b.word_id where a.word_id % 100 = 0 qualify row_number() over (partition by a.word_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.word_id) <= 3) select round(coalesce(avg(s), 0), 5) as mean, count(*) as n from x")(
    lambda spark, d: knn(spark, d).agg(F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 5).alias("mean"), F.count("*").alias("n"))
)


@query("kmeans")
def kmeans(spark, d):
    """Word classes after ten rounds from the start ``id mod 10``: a row a vector."""
    return vectors.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10, 10)


@query("centroid_query", """with u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y)))) as v from embeddings), e as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select label, list(x order by i) as v from (select label, i, avg(x) as x from e group by label, i) group by label)
select m.label::bigint as label, vec_id, round(list_cosine_similarity(m.v, u.v), 6) as similarity, row_number() over (partition by m.label order by round(list_cosine_similarity(m.v, u.v), 6) desc, vec_id) as rank from m, u qualify rank <= 3""")
def centroid_query(spark, d):
    """The vectors nearest to each class's mean of unit vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", ar.unit(F.col("embedding")).alias("v"))
    means = vectors.mean_vector(rows, "v", ["label"]).select(F.col("label").cast("bigint").alias("q"), F.col("v").alias("qv"))
    return class_neighbours(means, rows)


def class_neighbours(means, rows):
    from pyspark.sql import Window

    pairs = rows.select("vec_id", "v").join(F.broadcast(means), how="cross").select(F.col("q").alias("label"), "vec_id", F.round(ar.cosine(F.col("qv"), F.col("v")), 6).alias("similarity"))  # one row a class
    order = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 3")


query("vector_blend", f"with {WORDS}, k as (select list_transform(list_zip(x.v, y.v), lambda t: 0.7 * t[1] + 0.3 * t[2]) as qv from w x, w y where x.word_id = 10 and y.word_id = 11) select word_id, round(list_cosine_similarity(qv, v), 6) as similarity, row_number() over (order by round(list_cosine_similarity(qv, v), 6) desc, word_id) as rank from k, w where word_id not in (10, 11) qualify rank <= 10")(lambda spark, d: blend(spark, d))


def blend(spark, d):
    s = space(spark, d)
    x, y = (s.filter(F.col("word_id") == k).select(F.col("vec").alias(n)) for k, n in ((10, "x"), (11, "y")))
    q = x.join(y, how="cross").select(F.lit(None).cast("bigint").alias("q"), F.zip_with("x", "y", lambda a, b: a.cast("double") * 0.7 + b.cast("double") * 0.3).alias("qv"))  # one row
    return vectors.asked(q, s.filter("word_id not in (10, 11)"), "word_id", "vec", 10).select("word_id", "similarity", "rank")


query("vector_coverage", f"with {TOKENS}, {WORDS} select count(*) as types, count_if(token in (select word from w))::bigint as covered, round(count_if(token in (select word from w)) / count(*), 6) as share from c")(
    lambda spark, d: counts(spark, d).join(space(spark, d).select(F.col("word").alias("token"), F.lit(1).alias("k")).distinct(), "token", "left").agg(F.count("*").alias("types"), F.count("k").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("types"), 6))
)
query("kmeans_step", """with e as (select vec_id, embedding::double[] as v from embeddings), x as (select vec_id % 10 as c, unnest(v) as x, generate_subscripts(v, 1) as i from e), m as (select c, list(x order by i) as v from (select c, i, avg(x) as x from x group by c, i) group by c)
select vec_id, c as class from e, m qualify row_number() over (partition by vec_id order by round(list_cosine_similarity(e.v, m.v), 6) desc, c) = 1""")(lambda spark, d: vectors.kmeans_step(table(spark, d, "embeddings"), "vec_id", "embedding", 10))


@query("principal_plane")
def principal_plane(spark, d):
    """Two principal components of the embeddings; signs are arbitrary, so their squares come out."""
    from pyspark.ml.functions import array_to_vector

    return plane(table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))


def plane(rows):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    out = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).withColumn("a", vector_to_array("p"))
    return out.select("vec_id", F.round(F.pow(F.col("a")[0], 2), 6).alias("x2"), F.round(F.pow(F.col("a")[1], 2), 6).alias("y2"))


@query("word2vec")
def word2vec(spark, d):
    """Skip-gram vectors of the commonest words, trained on the sentences: a word, the length of its vector and its norm."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = cut_lineage(sentences(spark, d).select("words"))
    model = Word2Vec(vectorSize=16, minCount=20, maxIter=1, numPartitions=4, seed=1, inputCol="words", outputCol="v").fit(rows)
    rows = model.getVectors().select("word", vector_to_array("vector").alias("vec"))
    return rows.select("word", F.size("vec").cast("bigint").alias("length"), F.round(ar.norm(F.col("vec")), 4).alias("norm"))


@query("trained_vectors")
def trained_vectors(spark, d):
    """Vectors of the vocabulary's words, fitted to distance-weighted co-occurrence: a word, the length of its vector and its norm."""
    from loomtext.operators.training import train_vectors

    vocab = vocabulary(spark, d)
    cooc = cut_lineage(vectors.cooccurrence(sentences(spark, d), 10, vocab, weighted=True))
    return train_vectors(cooc, vocab).select("word", F.size("vec").cast("bigint").alias("length"), F.round(ar.norm(F.col("vec")), 4).alias("norm"))
