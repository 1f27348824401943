"""Full stops as candidates for sentence ends: rows, rule, features, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import udfs

CLOSERS = "\"'”»›‟’‛」』）)]}"
OPENERS = "\"'“«‹„‘‚「『（([{"
WINDOW, RADIUS = 40, 4
BLOCK, PAD = 2048, 256  # a text is cut into blocks; of a stop's sides so many signs are looked at


def dots(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, end, at, dot_index, text, p)``: one row a full stop, ``at`` its place from 0, ``n`` the text's length, ``end`` that without white space at its end.

    ``text`` is the stop's surroundings (``PAD`` signs on both sides), ``p`` its place in them: a text is cut into blocks once,
    and a stop's row does not hold the text, so that time and size grow with the text whatever the number of stops.
    """
    t, n = F.col(text), F.length(text)
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: i * BLOCK)
    block = lambda s: F.struct(s.alias("start"), F.least(s, F.lit(PAD)).alias("before"), F.substring(t, F.greatest(s - PAD, F.lit(0)) + 1, F.least(s, F.lit(PAD)) + BLOCK + PAD).alias("text"))
    blocks = df.filter(t.contains(".")).select(key, n.cast("bigint").alias("n"), F.length(F.regexp_replace(t, r"\s+\z", "")).cast("bigint").alias("end"), F.transform(starts, block).alias("blocks"))
    core = lambda b: F.substring(b["text"], b["before"] + 1, F.lit(BLOCK))
    stops = F.transform("blocks", lambda b: F.length(core(b)) - F.length(F.replace(core(b), F.lit("."), F.lit(""))))
    sums = F.aggregate(stops, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c)))
    rows = blocks.select(key, "n", "end", F.explode(F.arrays_zip(F.col("blocks").alias("b"), F.slice(sums, 1, F.size("blocks")).alias("base"))).alias("x")).select(key, "n", "end", "x.b.*", "x.base")
    parts = F.split(F.substring(F.col("text"), F.col("before") + 1, F.lit(BLOCK)), r"\.")
    ends = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1)) + 1).otherwise(0) + F.length(p))))
    found = rows.select(key, "n", "end", "start", "before", "base", "text", F.posexplode(ends).alias("__k", "local"))
    place = F.col("before") + F.col("local")
    return found.select(key, "n", "end", (F.col("start") + F.col("local")).alias("at"), (F.col("base") + F.col("__k")).alias("dot_index"), F.substring(F.col("text"), F.greatest(place - PAD, F.lit(0)) + 1, F.least(place, F.lit(PAD)) + 1 + PAD).alias("text"), F.least(place, F.lit(PAD)).alias("p"))


def sign(at: Column) -> Column:
    """The sign at a place of the surroundings, empty outside the text."""
    return F.when(at >= 0, F.substring(F.col("text"), at + 1, F.lit(1))).otherwise("")


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = dots(df, key, text)
    at, p = F.col("at"), F.col("p")
    left = F.substring(F.col("text"), F.greatest(p - WINDOW, F.lit(0)) + 1, F.least(p, F.lit(WINDOW)))
    right = F.substring(F.col("text"), p + 2, F.lit(WINDOW))
    return rows.select(
        F.concat(F.lit("d"), F.col(key), F.lit("_p"), at).alias("row_id"), key, F.col("dot_index").cast("bigint").alias("dot_index"), at.cast("bigint").alias("char_index"),
        sign(p - 1).alias("prev_char"), sign(p + 1).alias("next_char"), left.alias("left_context"), right.alias("right_context"),
    )


def words_around(rows: DataFrame) -> DataFrame:
    """Adds ``left``, ``right`` (the sides of the stop, ``PAD`` signs each) and the words next to it."""
    rows = rows.withColumn("left", F.substring(F.col("text"), F.lit(1), F.col("p"))).withColumn("right", F.substring(F.col("text"), F.col("p") + 2, F.lit(PAD)))
    word = r"([\p{L}\p{N}_'’\-]+)"
    return rows.withColumn("prev_token", F.regexp_extract("left", rf"{word}\s*$", 1)).withColumn("next_token", F.regexp_extract("right", rf"^\s*{word}", 1)).withColumn("last", F.regexp_extract("left", r"(\S*)$", 1))


def is_abbreviation(word: Column) -> Column:
    bare = F.regexp_replace(word, rf"^[{regex_set(OPENERS + CLOSERS)}]+|[{regex_set(OPENERS + CLOSERS)}]+$", "")
    return F.lower(F.regexp_replace(bare, "[.,!?;:]+$", "")).isin(*sorted(udfs.ABBREVIATIONS))


def regex_set(signs: str) -> str:
    return "".join("\\" + c if c in "[](){}\\^-\"'" else c for c in signs)


def rule(rows: DataFrame) -> Column:
    """1 where the rules let a full stop end a sentence. ``rows`` come from ``words_around``."""
    before, after = sign(F.col("p") - 1), sign(F.col("p") + 1)
    first = F.regexp_extract("right", r"^\s*(\S)", 1)
    decimal = before.rlike(r"^\p{Nd}$") & after.rlike(r"^\p{Nd}$")
    tight = ~before.isin("", " ") & ~after.isin("", " ")
    initial = before.rlike(r"^\p{Lu}$")
    word = F.concat("last", F.lit("."))
    compact = word.rlike(r"(?:^|[^\p{L}\p{N}_])[A-Z]\.[A-ZƏÖÜİĞÇŞ]")
    held = decimal | tight | initial | is_abbreviation(word) | compact | first.rlike(r"^\p{Ll}$") | ((after != "") & (F.instr(F.lit(CLOSERS), after) > 0))
    return F.when(held, 0).otherwise(1).cast("bigint")


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a full stop with what a classifier may look at."""
    rows = words_around(dots(df, key, text))
    at, n, p = F.col("at"), F.col("n"), F.col("p")
    chars = {"prev": sign(p - 1), "next": sign(p + 1), "prev2": sign(p - 2), "next2": sign(p + 2), "prev_nonspace": F.regexp_extract("left", r"(\S)\s*$", 1), "next_nonspace": F.regexp_extract("right", r"^\s*(\S)", 1)}
    kinds = {"digit": r"^\p{Nd}$", "upper": r"^\p{Lu}$", "lower": r"^\p{Ll}$", "space": r"^\s$"}
    norm = lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, rf"^[{regex_set(OPENERS + CLOSERS)}]+|[{regex_set(OPENERS + CLOSERS)}]+$", ""), "[.,!?;:]+$", ""))
    prev, nxt = norm(F.col("prev_token")), norm(F.col("next_token"))
    joined = (at > 0) & (at + 1 < n) & ~chars["prev"].rlike(r"^\s$") & ~chars["next"].rlike(r"^\s$")
    out = [F.col(key), at.cast("bigint").alias("char_index"), *[c.alias(f"{name}_char") for name, c in chars.items()]]
    out.append(F.substring(F.col("text"), F.greatest(p - RADIUS, F.lit(0)) + 1, F.least(p, F.lit(RADIUS)) + 1 + RADIUS).alias("char_window"))
    for name in ("prev", "next"):
        out += [chars[name].rlike(p).alias(f"{name}_is_{kind}") for kind, p in kinds.items()]
        out.append(((chars[name] != "") & (F.instr(F.lit(OPENERS + CLOSERS), chars[name]) > 0)).alias(f"{name}_is_quote"))
    out += [chars["next_nonspace"].rlike(kinds[k]).alias(f"next_nonspace_is_{k}") for k in ("upper", "lower", "digit")] + [chars["prev_nonspace"].rlike(kinds["digit"]).alias("prev_nonspace_is_digit")]
    out += [F.left("prev_token", F.lit(40)).alias("prev_token"), F.left("next_token", F.lit(40)).alias("next_token"), F.left(prev, F.lit(40)).alias("prev_token_lower"), F.left(nxt, F.lit(40)).alias("next_token_lower"), F.length(prev).cast("bigint").alias("prev_token_len"), F.length(nxt).cast("bigint").alias("next_token_len")]
    out += [((F.length(prev) == 1) & F.col("prev_token").rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")).alias("prev_token_is_single_upper"), prev.isin(*sorted(udfs.ABBREVIATIONS)).alias("is_known_abbreviation")]
    out += [F.col("prev_token").rlike(r"\p{Nd}").alias("prev_token_contains_digit"), F.col("next_token").rlike(r"\p{Nd}").alias("next_token_contains_digit")]
    out += [joined.alias("joined_no_space_around_dot"), (chars["prev"].rlike(kinds["digit"]) & chars["next"].rlike(kinds["digit"])).alias("is_decimal_pattern"), (joined & chars["prev"].rlike(kinds["upper"]) & chars["next"].rlike(kinds["upper"])).alias("is_compact_initials_pattern")]
    closing = (chars["next"] != "") & (F.instr(F.lit(CLOSERS), chars["next"]) > 0)
    out += [(closing & chars["next2"].rlike(kinds["space"]) & sign(p + 3).rlike(kinds["upper"])).alias("quote_then_space_upper"), (at + 1 >= F.col("end")).alias("end_of_text_after_dot"), F.left("right", F.lit(3)).contains("\n").alias("line_break_after_dot")]
    for k in (1, 2, 3):
        out += [F.left(prev, F.lit(k)).alias(f"prev_prefix_{k}"), F.right(prev, F.lit(k)).alias(f"prev_suffix_{k}")]
    out.append(tx.char_kind(F.left("next_token", F.lit(1))).alias("next_token_first_char_type"))
    return rows.select(*out)


def labelled_documents(sentences: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``(doc, text, gold)``: documents of up to ``size`` sentences of a group in order (numbers from 0), with the places of their last stops."""
    doc = F.concat(F.col(group).cast("string"), F.lit("-"), F.floor(F.col(order) / size).cast("string"))
    docs = sentences.withColumn("doc", doc).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(order, "sentence"))).alias("s"))  # `size` sentences each
    texts = docs.select("doc", F.col("s.sentence").alias("s"))
    starts = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(x) - F.when(F.endswith(x, F.lit(".")), 1).otherwise(0))).alias("out")), lambda acc: acc["out"])
    ends = F.transform(F.filter(F.arrays_zip(F.col("s").alias("x"), starts.alias("p")), lambda z: F.endswith(z["x"], F.lit("."))), lambda z: z["p"])
    return texts.select("doc", F.array_join("s", " ").alias("text"), ends.alias("gold"))


def invalid_labels(labels: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, char_index, fault)``: labels whose document is missing, whose place lies outside it, or at whose place no stop stands."""
    found = labels.join(texts.select(key, F.col(text).alias("__t"), F.lit(True).alias("__known")), key, "left")
    at = F.col("char_index")
    fault = F.when(F.col("__known").isNull(), "no document").when((at < 0) | (at >= F.coalesce(F.length("__t"), F.lit(0))), "outside").when(F.substring(F.col("__t"), at.cast("int") + 1, F.lit(1)) != ".", "no stop")
    return found.withColumn("fault", fault).filter("fault is not null").select(key, "char_index", "fault")


def by_document(labels: DataFrame, key: str) -> DataFrame:
    """``(key, labels)``: the labels of each document in order of their place."""
    rest = [c for c in labels.columns if c not in (key, "char_index")]
    return labels.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("char_index", *rest))).alias("labels"))


def boundary_metrics(found: DataFrame, gold: DataFrame, key: str, place: str) -> DataFrame:
    """Precision, recall, F1 and error rate of boundary sets, over all documents; two empty sets agree."""
    both = found.select(key, place, F.lit(1).alias("f")).distinct().join(gold.select(key, place, F.lit(1).alias("g")).distinct(), [key, place], "full_outer")
    one = both.agg(F.coalesce(F.sum(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)), F.lit(0)).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    rate = lambda x: F.round(F.when(empty, 1.0).otherwise(F.coalesce(x, F.lit(0.0))), 6)
    return one.select("tp", "fp", "fn", rate(p).alias("precision"), rate(r).alias("recall"), rate(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), F.round(F.coalesce(F.try_divide(F.col("fp") + F.col("fn"), F.col("tp") + F.col("fn")), F.lit(0.0)), 6).alias("error_rate"))
