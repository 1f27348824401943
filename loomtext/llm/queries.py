"""The queries of the problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import lookalikes, neighbours, overlap, packing, pieces, quality, repair, sentences, terms, tokens
from loomtext.session import cut_lineage, one_record, shared_path, spread, table


def function_words(spark, d) -> dict[str, list[str]]:
    """The fixed list of common words by language."""
    common: dict[str, list[str]] = {}
    for row in table(spark, d, "common_words").select("lang", "word").distinct().collect():
        if row["lang"] and row["word"]:
            common.setdefault(row["lang"], []).append(row["word"])
    return common


# ---- 1: sentences
def p1_found(spark, d):
    pages = one_record(table(spark, d, "corpus_pages").select(F.lit("corpus_pages").alias("origin"), F.col("doc_id").alias("doc_key"), "text"), "doc_key")
    docs = one_record(table(spark, d, "corpus_docs").select(F.lit("corpus_docs").alias("origin"), F.col("doc_idx").alias("doc_key"), "text"), "doc_key")
    return sentences.split(pages.unionByName(docs), ["origin", "doc_key"], "text", function_words(spark, d))


def p1_per_document(spark, d):
    """Sentences and characters in them, per document."""
    found = p1_found(spark, d)
    return found.groupBy("origin", "doc_key").agg(F.count("*").alias("sentences"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))


# ---- 2: overlap of splits
def review_overlaps(spark, d, extra=()):
    return overlap.overlaps(spread(table(spark, d, "reviews")), "review_id", "content", "split_name", list(extra))


def p2_found(spark, d):
    found = review_overlaps(spark, d)
    return found.select(F.least("key_a", "key_b").alias("review_id_a"), F.greatest("key_a", "key_b").alias("review_id_b"))


def p2_records(spark, d):
    """Every evaluation record that stands in the train split: its class of equal contents, its train records, its coverage."""
    found = overlap.record_coverage(spread(table(spark, d, "reviews")), "review_id", "content", "split_name", ["source"])
    return found.select(F.col("key").alias("review_id"), F.col("side").alias("split_name"), "source", F.col("class").alias("class_id"), "links", F.round("coverage", 6).alias("coverage"))


def p2_coverage(spark, d):
    """Per split and source: the evaluation records that stand in the train split, their pairs, and their best coverage."""
    return p2_records(spark, d).groupBy("split_name", "source").agg(F.count("*").alias("records"), F.sum("links").alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.sum((F.col("coverage") == 1).cast("bigint")).alias("whole"))


# ---- 3: pieces
def cut_tables(spark: SparkSession, d: str) -> DataFrame:
    pages = one_record(table(spark, d, "corpus_pages").select("doc_id", "text"), "doc_id")
    squad = one_record(table(spark, d, "squad_examples").select("question_id", "context"), "question_id")
    return pages.select(F.lit("corpus_pages").alias("origin"), F.col("doc_id").cast("string").alias("item_key"), "text").unionByName(squad.select(F.lit("squad_examples").alias("origin"), F.col("question_id").alias("item_key"), F.col("context").alias("text")))


def p3_found(spark, d):
    """Items longer than the limit, by the stretches that the piece operator had to cut through."""
    return pieces.cut_texts(cut_tables(spark, d), ["origin", "item_key"], "text").filter("cut_kind is not null").select("origin", "item_key", "cut_kind")


def p3_pieces(spark, d):
    rows = pieces.pieces(cut_tables(spark, d), ["origin", "item_key"], "text")
    return rows.select("origin", "item_key", "piece", "start_char", "end_char", "is_forced", "piece_text")


# ---- 4: look-alikes
def prints_of(spark, d):
    reviews = table(spark, d, "reviews").filter("split_name = 'train'").select(F.lit("reviews").alias("origin"), F.col("review_id").alias("key"), F.col("content").alias("text"))
    pages = table(spark, d, "corpus_pages").select(F.lit("corpus_pages").alias("origin"), F.col("doc_id").alias("key"), "text")
    return lookalikes.fingerprints(spread(reviews.unionByName(pages)), ["origin", "key"], "text")


def p4_found(spark, d):
    return lookalikes.look_alike_pairs(prints_of(spark, d), "key", "origin")


def p4_classes(spark, d):
    """Every record that looks like another one, with its class."""
    return lookalikes.look_alike_classes(prints_of(spark, d), "key", "origin")


def p4_forms(spark, d):
    """The one form of every train review and page."""
    reviews = one_record(table(spark, d, "reviews").filter("split_name = 'train'").select("review_id", "content"), "review_id")
    pages = one_record(table(spark, d, "corpus_pages").select("doc_id", "text"), "doc_id")
    texts = reviews.select(F.lit("reviews").alias("origin"), F.col("review_id").alias("key"), F.col("content").alias("text")).unionByName(pages.select(F.lit("corpus_pages").alias("origin"), F.col("doc_id").alias("key"), "text"))
    return lookalikes.one_form(texts, "text", "form").select("origin", "key", "form")


# ---- 5: neighbours
def word_units(spark, d):
    return cut_lineage(neighbours.unit_vectors(spread(table(spark, d, "word_vectors")), "word_id", "vec"))


def p5_found(spark, d):
    pairs = neighbours.mutual_pairs(neighbours.neighbour_lists(word_units(spark, d)), 0.8)
    return pairs.select(F.col("id_a").alias("word_id_a"), F.col("id_b").alias("word_id_b"))


def p5_neighbours(spark, d):
    """The five most similar words of every word."""
    words = one_record(table(spark, d, "word_vectors").select("word_id", "word"), "word_id")
    lists = neighbours.neighbour_lists(word_units(spark, d))
    named = lists.join(words.withColumnRenamed("word_id", "id"), "id").join(words.select(F.col("word_id").alias("near_id"), F.col("word").alias("near_word")), "near_id")
    return named.select(F.col("id").alias("word_id"), "word", "rank", F.col("near_id").alias("near_word_id"), "near_word", F.round("similarity", 5).alias("similarity"))


def recall(exact, found):
    both = exact.join(found.select("id", "near_id").distinct().withColumn("hit", F.lit(1)), ["id", "near_id"], "left")
    close = F.col("similarity") >= 0.8
    return both.agg(F.count("*").alias("asked"), (F.count("hit") / F.count("*")).alias("recall"), (F.count(F.when(close, F.col("hit"))) / F.count(F.when(close, 1))).alias("recall_close"))


def p5_recall(spark, d):
    """Recall of the graph's lists against brute force, for the words whose id is divisible by 100."""
    vectors = word_units(spark, d)
    exact = neighbours.exact_neighbours(vectors, vectors.filter("id % 100 = 0"))
    return recall(exact, neighbours.neighbour_lists(vectors))


def p5_search_recall(spark, d):
    """Recall of greedy search of the graph against brute force, for the words whose id is divisible by 100."""
    vectors = word_units(spark, d)
    asked = vectors.filter("id % 100 = 0")
    nodes, graph, leaves = neighbours.build(vectors)
    return recall(neighbours.exact_neighbours(vectors, asked), neighbours.search(nodes, graph, leaves, asked))


# ---- 6: terms
def page_counts(spark, d):
    """The state of the pages' terms: built from an earlier version (the older half of the revisions), then the changes to the whole table are merged."""
    pages = table(spark, d, "corpus_pages").select("doc_id", "text", "revision_id")
    middle = pages.agg(F.percentile_approx("revision_id", 0.5)).first()[0]
    earlier = pages.filter(F.col("revision_id") <= F.lit(middle))
    state = shared_path(spark)
    terms.update_state(state, terms.term_deltas(terms.signed_changes(None, earlier, "doc_id", "text")), 1)
    terms.update_state(state, terms.term_deltas(terms.signed_changes(earlier, pages, "doc_id", "text")), 2)
    return terms.read_state(spark, state)


def vocab_counts(spark, d):
    """The state of the saved counts: as of the middle of the saves, then the later ones take the place of those that they replace."""
    saves = table(spark, d, "vocab_words")
    middle = saves.agg(F.timestamp_micros(F.percentile_approx(F.unix_micros("saved_at"), 0.5))).first()[0]
    state = shared_path(spark)
    terms.update_state(state, terms.saved_deltas(saves.filter(F.col("saved_at") <= F.lit(middle))), 1)
    terms.update_state(state, terms.saved_deltas(saves, middle), 2)
    return terms.read_state(spark, state)


def p6_found(spark, d):
    counts, words = page_counts(spark, d), vocab_counts(spark, d).filter("occurrences > 0")
    pages = counts.filter(F.col("term") == terms.ALL).agg(F.sum("records")).first()[0] or 0
    counts = counts.filter(F.col("term") != terms.ALL)
    total = words.agg(F.sum("occurrences")).first()[0] or 0
    found = terms.mark_terms(counts, 3, F.col("records") * 4 > pages).select(F.lit("corpus_pages").alias("origin"), "term", "mark")
    return found.unionByName(terms.mark_terms(words, 5, F.col("occurrences") * 200 > total).select(F.lit("vocab_words").alias("origin"), "term", "mark"))


def p6_page_terms(spark, d):
    return page_counts(spark, d).filter(F.col("term") != terms.ALL)


def p6_vocab_terms(spark, d):
    return vocab_counts(spark, d).filter("occurrences > 0").select("term", "occurrences", F.col("records").alias("batches"))


# ---- 7: quality
def rated_pages(spark, d):
    return quality.rate(one_record(table(spark, d, "corpus_pages").select("doc_id", "text"), "doc_id"), "doc_id", "text", function_words(spark, d))


def p7_found(spark, d):
    return rated_pages(spark, d).filter("is_junk").select(F.col("key").cast("bigint").alias("doc_id"))


def p7_statistics(spark, d):
    """Every page's statistics, distance, and the contribution of each statistic to it."""
    rated = rated_pages(spark, d)
    each = [F.round(F.col(c)[i], 6).alias(f"{prefix}{name}") for i, name in enumerate(quality.NAMES) for c, prefix in (("stats", ""), ("contributions", "by_"))]
    plain = [F.col("reported")[i].alias(name) for i, name in enumerate(quality.REPORTED)]
    return rated.select(F.col("key").cast("bigint").alias("doc_id"), "lang", *plain, F.round("distance", 6).alias("distance"), *each, "is_junk")


# ---- 8: tokens
def p8_ids(spark, d):
    return tokens.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_roundtrip(spark, d):
    """Every document's number of ids, and whether they decode to its text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = tokens.encode(spread(docs.withColumn("original", F.col("text"))))
    back = tokens.decode(ids.withColumn("n_ids", F.size("ids").cast("bigint")))
    return back.select("doc_id", "n_ids", (F.col("text") == F.coalesce(F.col("original"), F.lit(""))).alias("is_exact"))


def p8_exact(spark, d):
    """Whether every document's ids decode to its text."""
    return p8_roundtrip(spark, d).select("doc_id", "is_exact")


# ---- 9: packing
def document_sizes(spark, d):
    return tokens.count_tokens(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_containers(spark, d):
    """Every document's place: container, part (larger documents are split) and tokens."""
    return packing.pack(document_sizes(spark, d), "doc_id", "n_tokens").select(F.col("key").alias("doc_id"), "part", F.col("n").alias("n_tokens"), "container")


def p9_fill(spark, d):
    """How well the containers are filled: with the least number that any packing needs."""
    packed = packing.pack(document_sizes(spark, d), "doc_id", "n_tokens").filter("container is not null")
    by = packed.groupBy("container").agg(F.sum("n").alias("used"), F.count("*").alias("parts"))
    return by.agg(F.count("*").alias("containers"), F.ceil(F.sum("used") / packing.CAPACITY).alias("least"), F.max("used").alias("fullest"), F.sum("parts").alias("parts"), (F.sum("used") / (F.count("*") * packing.CAPACITY)).alias("share_used"))


def p9_bounds(spark, d):
    """Whether no container is over its capacity, and whether there is no container more than the sizes need at the least."""
    return p9_fill(spark, d).select((F.col("containers") == F.col("least")).alias("is_least"), (F.col("fullest") <= packing.CAPACITY).alias("none_over"))


# ---- 10: encodings
def garbled_source(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "source"))


def p10_found(spark, d):
    return repair.decide(garbled_source(spark, d), "doc_id")[0].select(F.col("key").alias("doc_id"))


def p10_restored(spark, d):
    """The chain, its posterior and the text as far as it can be had."""
    return repair.find_garbled(garbled_source(spark, d), "doc_id").select(F.col("key").alias("doc_id"), repair.chain_name(F.col("chain")).alias("chain"), F.round("posterior", 4).alias("posterior"), "restored")


def queries():
    found = {k: f for k, f in globals().items() if k[:1] == "p" and k.partition("_")[0][1:].isdigit()}
    return dict(sorted(found.items(), key=lambda x: (int(x[0].partition("_")[0][1:]), x[0])))
