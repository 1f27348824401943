"""Text columns: every function takes and gives a Column, and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
#: A token: letters with inner apostrophes or hyphens, or a number with inner points or commas.
TOKEN = r"(\p{L}+(?:['\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*)"
# Lines and labels of encyclopedia markup.
MARKER_LINE = r"(?imu)^\s*(kateqoriya|istinadlar|qeydlər|əlavəədəbiyyat)\b.*$"
MARKER_LINE_SPACED = r"(?imu)^[ \t]*(kateqoriya|istinadlar|qeydlər|əlavəədəbiyyat)\b.*$"
MARKER_LABELS = ("kateqoriya", "istinadlar", "qeydlər", "əlavə ədəbiyyat")
CATEGORY_LINE = r"(?iu)^\s*(kateqoriya:|category:)"
END_SECTIONS = ("İstinadlar", "References", "Xarici keçidlər", "External links", "Qeydlər", "Notes", "See also")


def collapsed(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """No-break blanks, curly apostrophes and long dashes to plain ones; white space collapsed."""
    return collapsed(F.translate(text, NBSP + "’‘–—", " ''--"))


def without_markers(text: Column) -> Column:
    """Removes a line that begins with a marker word, and marker labels anywhere."""
    out = F.regexp_replace(text, MARKER_LINE, " ")
    for label in MARKER_LABELS:
        out = F.regexp_replace(out, rf"(?iu)\b{label}\b\s*:\s*", " ")
    return out


def lowered(text: Column) -> Column:
    return F.lower(text)


def tokens(text: Column, lowercase: bool = True, strip: bool = True) -> Column:
    """The tokens of a text. White space is collapsed before markers are stripped, so that a text beginning with one is empty."""
    t = normalized(text)
    t = without_markers(t) if strip else t
    t = lowered(t) if lowercase else t
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))


def without_category_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, r"\n"), lambda x: ~x.rlike(CATEGORY_LINE)), "\n")


def before_end_sections(text: Column) -> Column:
    """Cut at the first heading ``== title ==`` whose title is one of the closing sections."""
    lines = F.split(text, r"\n")
    title = lambda x: F.regexp_extract(x, r"^==\s*(.+?)\s*==\s*$", 1)
    hits = F.transform(lines, lambda x: title(x).isin(*END_SECTIONS))
    first = F.array_position(hits, True)
    return F.array_join(F.when(first > 0, F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(lines), "\n")


def without_templates(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\{\{[^}]+\}\}", " "), r"<[^>]+>", " ")


def cleaned_page(text: Column) -> Column:
    """Category lines, closing sections, templates and tags removed; underscores and white space collapsed."""
    out = without_templates(before_end_sections(without_category_lines(text)))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "_+", " "), r"(?U)\s+", " "))


def sentence_text(text: Column) -> Column:
    """What the segmenter reads: colons and semicolons to blanks, white space collapsed."""
    out = F.regexp_replace(text, r"(?U)\s*[;:]+\s*", " ")
    return collapsed(F.regexp_replace(out, r"(?U)\(\s*;\s*\)", " "))


def segmenter_text(text: Column) -> Column:
    """Lines that begin with a marker word removed, the category label anywhere."""
    return F.regexp_replace(F.regexp_replace(text, MARKER_LINE_SPACED, " "), r"(?iu)\bkateqoriya\b\s*:\s*", " ")


def wikitext_plain(text: Column, depth: int = 4) -> Column:
    """Markup to plain text: templates (nested up to ``depth``), tags and emphasis with what they hold, links to files and categories removed; of other links the label stays."""
    t = text
    for _ in range(depth):
        t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"<[A-Za-z][^<>]*/>", "")
    for _ in range(depth):
        t = F.regexp_replace(t, r"<[A-Za-z][^<>]*>[^<]*</[A-Za-z]+>", "")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    t = F.regexp_replace(t, r"'{2,5}[^'\n]+'{2,5}", "")
    t = F.regexp_replace(t, r"(?iu)\[\[(?:Kateqoriya|Fayl|File):[^\]]+\]\]", " ")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://[^ \]]+ ([^\]]*)\]", "$1")
    return collapsed(t)


def wikitext_page(text: Column) -> Column:
    """What ``wikitext_plain`` leaves, cleaned like any page."""
    return cleaned_page(wikitext_plain(text))


def without_lines_in(text: Column, words: dict[str, list[str]], lang: str = "en", share: float = 0.7) -> Column:
    """Lines dropped whose function words are of one language: more than ``share`` of those of any language, and two at least."""
    every = sorted({w for v in words.values() for w in v})
    own = sorted(words.get(lang, []))

    def keeps(line: Column) -> Column:
        found = F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))
        hits = lambda listed: F.size(F.filter(found, lambda w: w.isin(*listed)))
        return (hits(own) < 2) | (hits(own) <= share * hits(every)) if own else F.lit(True)

    return F.array_join(F.filter(F.split(text, r"\n"), keeps), "\n")


def page_url(title: Column, base: str = "https://az.wikipedia.org/wiki/") -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


# Letters written plainly, stop words, suffixes in their order, emoji.
PLAIN = (("ch", "c"), ("sh", "s"), ("gh", "g"))
PLAIN_LETTERS = ("çəığöşü", "ceigosu")
STOP_WORDS = (
    "men sen o biz siz onlar ne kim hara niye nece hansi vaxt sonra eger heqiqeten lakin cunki bu ki butun ve ya veya amma yoxsa "
    "ancag sadece qisa uzun kicik boyuk ora bura sag sol salam bele cox az e bir her"
).split()
SUFFIXES = (
    "lar ler larin lerin mis mak mek liq luq acaq eceq ma m am em ar er araq ereq arak erek ca ce ci cu da de dan den di diq "
    "dir du duq dur duk ib ici il inci uncu istan is in la le las les luk maq mus n nci ncu s ub ucu ul ustan us y cil "
    "dar der an en gec kar kes ken lik t me nan nen ova ov san siniz sul sunas"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_letters(text: Column) -> Column:
    """Digraphs and letters of the alphabet written with plain Latin letters."""
    for a, b in PLAIN:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, *PLAIN_LETTERS)


def legacy_words(text: Column) -> Column:
    """Lower-case, plain letters, hyphens to blanks, ASCII punctuation and stop words dropped."""
    t = F.replace(plain_letters(F.lower(text)), F.lit("-"), F.lit(" "))
    t = collapsed(F.translate(t, PUNCTUATION, ""))
    return F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def stemmed(word: Column) -> Column:
    """Strips every suffix that fits, in the fixed order, as long as something is left."""
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES])
    return F.aggregate(suffixes, word, lambda acc, s: F.when(F.endswith(acc, s) & (F.length(acc) > F.length(s)), F.left(acc, F.length(acc) - F.length(s))).otherwise(acc))


# Emoji that are words of their own; the heart is one with its variation sign.
HEART = "❤\ufe0f"
EMOJI = "👍👎👌🙃😉🖤💔💕💖💗💘💙💚💛💜💝💞💟💠🤗🤔🤣🤤🤥🤦🤧🤨🤩🤪🤫🤬🤭🤮🤯🤰🤱🤲🎉😡🥰"
EMOJI_WORD = f"({HEART}|[{EMOJI}])"


def legacy_tokens(text: Column) -> Column:
    """Stemmed words, without those that are stop words once they are stemmed; each different emoji of a word stands behind it."""

    def parts(word: Column) -> Column:
        plain = F.regexp_replace(word, EMOJI_WORD, "")
        return F.filter(F.concat(F.array(F.when(plain.isin(*STOP_WORDS), "").otherwise(plain)), F.array_distinct(F.regexp_extract_all(word, F.lit(EMOJI_WORD), F.lit(1)))), lambda w: w != "")

    return F.flatten(F.transform(F.transform(legacy_words(text), stemmed), parts))


def answer_form(text: Column) -> Column:
    """Lower-case, no ASCII punctuation, no articles, single blanks: for comparing answers."""
    t = collapsed(F.translate(F.lower(text), PUNCTUATION, ""))
    return F.array_join(F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin("a", "an", "the")), " ")


def filename_part(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")


def year_part(value: Column) -> Column:
    """A year as digits where it is a number, else as a file-name part; null gives the empty text."""
    number = value.cast("string").try_cast("double").cast("bigint").cast("string")
    return F.coalesce(number, filename_part(value), F.lit(""))


def ticker_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(.+?)_(\d{4})(?:_\d+)?\.txt$", 1), F.lit(""))


def year_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(.+?)_(\d{4})(?:_\d+)?\.txt$", 2), F.lit("")).cast("int")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\w+\b"))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def list_items(text: Column) -> Column:
    """Items of a comma or newline list, trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def char_kind(c: Column) -> Column:
    quotes = "\"'“«‹„‘‚「『（([{”»›‟’‛」』）)]}"
    return (
        F.when(c == "", "none").when(c.rlike(r"(?U)^\s$"), "space").when(c.rlike(r"^\p{Nd}$"), "digit").when(c.rlike(r"^\p{Lu}$"), "upper")
        .when(c.rlike(r"^\p{Ll}$"), "lower").when(c.rlike(r"^\p{L}$"), "alpha").when(F.instr(F.lit(quotes), c) > 0, "quote").otherwise("other")
    )


def partial_word(text: Column) -> Column:
    return F.regexp_extract(text, r"[\p{L}\p{N}_'’\-]+$", 0)


def review_form(text: Column) -> Column:
    """Composed, unseen signs and typographic marks plain, control signs dropped, drawn-out signs and letters shortened."""
    from loomtext.functions.udfs import composed

    t = composed(text)
    for a, b in (("​", " "), ("‌", " "), ("‍", " "), ("﻿", " "), ("’", "'"), ("`", "'"), ("´", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"([!?.,])\1{2,}", "$1$1")
    t = F.regexp_replace(t, r"(?U)(\w)\1{3,}", "$1$1$1")
    return collapsed(t)


def prompt(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled in."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def utc_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")
