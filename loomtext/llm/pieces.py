"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

One regular expression with bounded quantifiers consumes the text. Its alternatives are ordered by the strength of the
boundary they end at (paragraph, line, sentence sign, white space), each greedy up to the limit, and the last one takes
characters where no boundary is in reach. The first piece may consume ``size`` code points, a later one ``size - overlap``
(its first ``overlap`` code points are looked back to), so that no piece is longer than ``size``. Ends are the running sum of
the consumed lengths, starts are the previous end less the overlap; all of it is array functions, nothing leaves the JVM.

Defined cases: null gives no piece; a text up to ``size`` (the empty one too) is one piece; a weaker boundary is taken
only if no stronger one lies in the second half of what may be consumed, so that pieces do not get tiny; concatenating the
pieces without their overlaps gives the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 2000, 200
#: Signs right behind which a text may be cut.
SIGNS = ".!?。！？…"


def piece_pattern(size: int = SIZE, overlap: int = OVERLAP) -> str:
    """Alternatives by strength for the first piece (after ``\\A``) and for the later ones."""

    def alternatives(most: int) -> str:
        least = most // 2
        strong = [r"\n{2}", r"[\n\x0B\f\r\x85  ]", rf"[{SIGNS}][\"'”’»)\]]{{0,3}}\s", rf"[{SIGNS}]", r"\s"]
        tail = [rf"[\s\S]{{{least},{most}}}(?<={b})" for b in strong]  # a piece's end includes its boundary
        return "|".join([*tail, rf"[\s\S]{{1,{most}}}(?<=[{SIGNS}\s])", rf"[\s\S]{{1,{most}}}"])

    return rf"(?U)\A[\s\S]{{1,{size}}}\z|\A(?:{alternatives(size)})|[\s\S]{{1,{size - overlap}}}\z|(?:{alternatives(size - overlap)})"


PIECES = "array<struct<piece:int,start_char:int,end_char:int,is_forced:boolean,stretch:int>>"


def cut(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The array of ``(piece, start_char, end_char, is_forced, stretch)``; positions count code points, ends are exclusive.

    ``is_forced`` says that the piece ends neither at the text's end nor at white space nor behind one of the signs;
    ``stretch`` is the length of the stretch without a natural boundary that the cut before this piece went through, as far as
    this piece shows it (0 where that cut was natural).
    """
    parts = F.regexp_extract_all(text, F.lit(piece_pattern(size, overlap)), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.length(text).alias("total"), F.lit(0).alias("run"), F.lit(None).cast(PIECES).alias("out"))
    inner = rf"[^\s{SIGNS}]"

    def step(acc: Column, part: Column) -> Column:
        long = F.length(part)
        end = acc["at"] + long
        forced = (end < acc["total"]) & ~F.right(part, F.lit(1)).rlike(rf"(?U)[{SIGNS}\s]")
        head = F.when(acc["run"] > 0, acc["run"] + F.length(F.regexp_extract(part, rf"(?U)\A{inner}*+[{SIGNS}]?", 0))).otherwise(F.lit(0))
        tail = F.when(forced, F.length(F.regexp_extract(part, rf"(?U){inner}*+\z", 0))).otherwise(F.lit(0))
        run = F.when(forced & (tail == long), acc["run"] + long).otherwise(tail)
        piece = F.struct(F.greatest(F.coalesce(F.size(acc["out"]), F.lit(0)), F.lit(0)).alias("piece"), F.greatest(F.lit(0), acc["at"] - overlap).alias("start_char"), end.alias("end_char"), forced.alias("is_forced"), head.alias("stretch"))
        return F.struct(end.alias("at"), acc["total"].alias("total"), run.alias("run"), F.concat(F.coalesce(acc["out"], F.array().cast(PIECES)), F.array(piece)).alias("out"))

    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"), F.lit(False).alias("is_forced"), F.lit(0).alias("stretch")))
    return F.when(F.length(text) <= size, whole).otherwise(F.aggregate(parts, start, step, lambda acc: acc["out"]))


def cut_kind(found: Column, size: int = SIZE) -> Column:
    """Of the pieces of one text: ``forced`` if a cut went through a stretch of more than ``size`` code points, else ``natural``; null where nothing is cut.

    A longer stretch fits no piece, so that a cut goes through every one of them.
    """
    return F.when(F.size(found) > 1, F.when(F.exists(found, lambda x: x["stretch"] > size), F.lit("forced")).otherwise(F.lit("natural")))


def cut_texts(df: DataFrame, key: list[str], text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(*key, cut_kind, pieces)``: one row for each text, its pieces as places."""
    return df.select(*key, cut(F.col(text), size, overlap).alias("pieces")).select(*key, cut_kind(F.col("pieces"), size).alias("cut_kind"), "pieces")


def pieces(df: DataFrame, key: list[str], text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece, with its text."""
    texts = df.select(*key, F.col(text).alias("__text"), cut(F.col(text), size, overlap).alias("__pieces"))
    rows = texts.select(*key, cut_kind(F.col("__pieces"), size).alias("cut_kind"), "__text", F.inline("__pieces"))
    return rows.withColumn("piece_text", F.expr("substring(__text, start_char + 1, end_char - start_char)")).drop("__text")
