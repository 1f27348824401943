import pytest
from pyspark.sql import functions as F

from loomtext.functions import arrays as ar
from loomtext.functions import text as tx
from loomtext.functions import udfs


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, words",
    [
        ("Salam, Azərbaycan!", ["salam", "azərbaycan"]),
        ("Qiymət 3,14 manatdır, 2024-cü il.", ["qiymət", "3,14", "manatdır", "2024", "cü", "il"]),
        ("İstanbul", ["i", "stanbul"]),
        ("ev’in  ön-arxa", ["ev'in", "ön-arxa"]),
        ("Kateqoriya olan mətn silinir", []),
        ("", []),
        (None, None),
    ],
)
def test_tokens(spark, text, words):
    assert one(spark, tx.tokens, text) == words


def test_normalized(spark):
    assert one(spark, tx.normalized, " a  b – ‘c’\n") == "a b - 'c'"


def test_cleaned_page(spark):
    text = "Başlıq_mətn {{şablon}}\nKateqoriya: x\n<b>qalın</b>\n== Notes ==\nson"
    assert one(spark, tx.cleaned_page, text) == "Başlıq mətn qalın"


def test_review_form(spark):
    assert one(spark, tx.review_form, "  Çooox   gözəl​ tətbiqdir!!!  ") == "Çooox gözəl tətbiqdir!!"
    assert one(spark, tx.review_form, "aaaaaa") == "aaa"


def test_legacy_tokens(spark):
    assert one(spark, tx.legacy_tokens, "Kitablar çox yaxşı-dır, və s.") == [one(spark, tx.stemmed, w) for w in ("kitablar", "yaxsi", "dir", "s")]
    assert one(spark, tx.legacy_tokens, "bizler sagda coxlar birer") == []  # stop words once they are stemmed
    assert one(spark, tx.legacy_tokens, "gozel❤\ufe0f ev👍👍") == ["gozel", "❤\ufe0f", "ev", "👍"]
    assert one(spark, tx.stemmed, "kitablar") == "kitab"


def test_answer_form(spark):
    assert one(spark, tx.answer_form, "The  Alpha, a beta!") == "alpha beta"


def test_file_names(spark):
    assert one(spark, tx.filename_part, " A/B inc. ") == "A_B_inc"
    assert one(spark, tx.ticker_of, "AAPL_2022_3.txt") == "AAPL" and one(spark, tx.year_of, "AAPL_2022_3.txt") == 2022
    assert one(spark, tx.ticker_of, "badname.txt") is None
    assert [one(spark, tx.year_part, v) for v in ("2022.0", "n/a", None)] == ["2022", "n_a", ""]


def test_small_helpers(spark):
    assert one(spark, tx.list_items, "a, b\na,,c") == ["a", "b", "c"]
    assert one(spark, tx.truthy, " Yes ") and not one(spark, tx.truthy, "no")
    assert [one(spark, tx.char_kind, c) for c in ("", " ", "5", "Ə", "ə", "ه", "«", "+")] == ["none", "space", "digit", "upper", "lower", "alpha", "quote", "other"]
    assert one(spark, lambda c: tx.prompt("Q: {q}!", q=c), "x") == "Q: x!"
    assert one(spark, tx.word_count, "bir iki, üç") == 3 and one(spark, tx.word_count, None) == 0


def test_ngrams(spark):
    got = one(spark, lambda c: ar.ngrams(F.split(c, " "), 2), "a b")
    assert [(r["h"], r["w"]) for r in got] == [("<s>", "a"), ("a", "b"), ("b", "</s>")]


@pytest.mark.parametrize("n, sizes", [(1000, [500, 500]), (200, None), (499, [499])])
def test_chunk_sizes(spark, n, sizes):
    got = one(spark, lambda c: ar.chunk_sizes(c, 201, 500, 420), n, "x int")
    assert (None if got is None else [r["size"] for r in got]) == sizes


def test_window_starts(spark):
    assert one(spark, lambda c: ar.window_starts(c, 4, 2), 6, "x int") == [0, 2]


def test_segments(spark):
    cases = {"… 4239 kv. verst …": 1, "prof. Samir gəlir. Salam.": 2, "Bu 50.5 manatdır. Bəli!": 2, "A.Məlikli gəldi. Getdi.": 2, "": 0}
    for text, n in cases.items():
        assert len(udfs.segmented(text)) == n, text


def test_alignment_and_distance():
    ops = [(e["op"], e["a"], e["b"]) for e in udfs.aligned("okean", "okan")]
    assert [o for o in ops if o[0] != "match"] == [("del", "e", "")]
    assert udfs.weighted_distance("abc", "abd", {("sub", "c", "d"): 0.5}, 2.0) == 0.5
    assert udfs.weighted_distance("abc", "xyz", {}, 1.0) == 2.0


def test_variants():
    assert {(v["variant"], v["edits"]) for v in udfs.typed_variants("cay", 2, 40)} == {("cay", 0), ("çay", 1)}
    assert "çay" in [v["variant"] for v in udfs.typed_variants("chay", 2, 40)]
    assert len(udfs.typed_variants("sherbet", 2, 5)) <= 5


def test_word_spans():
    assert [(s["word"], s["start"], s["end"]) for s in udfs.word_spans("Bu, 3 ev.�")] == [("Bu", 0, 2), (",", 2, 3), ("3", 4, 5), ("ev", 6, 8), (".", 8, 9)]


def test_markup_becomes_text(spark):
    page = "{{Məlumat|a={{b}}}}\n'''Ad''' bir [[Bakı|şəhər]]dir<ref name=x>qeyd</ref>. [[Fayl:x.jpg|thumb]] [https://a.b c d] <b>yox</b> son[[Kateqoriya:X]]"
    assert one(spark, tx.wikitext_plain, page) == "bir şəhərdir. c d son"


def test_lines_of_a_language_are_dropped(spark):
    words = {"en": ["the", "of", "and"], "az": ["və", "bu"]}
    assert one(spark, lambda c: tx.without_lines_in(c, words), "bu ev və su\nthe end of it\nthe\nbu the of və") == "bu ev və su\nthe\nbu the of və"


def test_sentences_at_given_boundaries():
    from loomtext.functions.udfs import sentences_at

    text = "A.b gəldi.» Nə?) Bəli."
    assert sentences_at(text, {9, 21}) == [{"sentence": "A.b gəldi.»", "boundary": 9}, {"sentence": "Nə?)", "boundary": 14}, {"sentence": "Bəli.", "boundary": 21}]
    assert sentences_at("son", set()) == [{"sentence": "son", "boundary": None}] and sentences_at("", set()) == []


def test_lists_softmax_and_stamps(spark):
    from pyspark.sql import functions as F

    from loomtext.functions import arrays as ar

    row = spark.range(1).select(ar.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"), ar.fitted(F.array(F.lit(1), F.lit(2)), 3, 0).alias("f"), tx.utc_stamp().alias("t"), tx.list_items(F.lit("a, b\na,,")).alias("l"), tx.truthy(F.lit(" Yes ")).alias("y")).first()
    assert row["s"] == [0.5, 0.5] and row["f"] == [1, 2, 0] and len(row["t"]) == 16 and row["l"] == ["a", "b"] and row["y"]
