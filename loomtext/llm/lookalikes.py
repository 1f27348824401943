"""Problem 4: one form for texts that look the same.

A batch of texts is exploded to one array of code points in their order; a table by code point is joined to it (what a
character decomposes to, unseen signs to nothing, white space to a blank, letters that look like those of another script to
one of them), marks are put in the order of their class and recomposed (the library's NFC), and the strings are rebuilt. The
table is made from the character database by rules and from the list of look-alike letters; its size is bounded by Unicode, and
it is built on every executor, so that explode, join and rebuild are array operations within an Arrow batch. A row for each
code point, joined and grouped by Spark, was measured: see the README.

Defined cases: null stays null; white space of any kind and number is one blank and none at the ends, so that a blank text
becomes the empty one; what is visibly different (case, accents, punctuation, superscripts) stays different; the form of a
form is itself; a text that decodes to a NUL loses it, as an unseen sign.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts and the letters that they look like, in the order of the scripts.
ALIKE = {
    # Cyrillic
    **dict(zip("ЅЈѴѵѠѡ", "SJVvWw", strict=True)),
    **dict(zip("АВЕЅІЈКМНОРСТУХԀԚԜҮӘ", "ABESIJKMHOPCTYXDQWYƏ", strict=True)),
    **dict(zip("аеѕіјорсухһԁԛԝӏә", "aesijopcyxhdqwlə", strict=True)),
    # Greek
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True)),
    **dict(zip("ονραικυ", "ovpaiku", strict=True)),
    **dict(zip("ϹϲϳͿ", "CcjJ", strict=True)),
    # Armenian
    **dict(zip("ՍՏՕԼօոսհցզյ", "USOLonuhgqj", strict=True)),
    # Coptic
    **dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌⲟⲣⲥ", "ABEHIKMNOPCTYXZopc", strict=True)),
    # Cherokee
    **dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True)),
    # Lisu
    **dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True)),
    # further Latin, small capitals of the shape of the small letters among them
    **dict(zip("ǝɑɡᴄᴏᴠᴡᴢᴜꜱ", "əagcovwzus", strict=True)),
    # hyphens
    "‐": "-",
}
#: Kinds of compatibility decomposition whose parts look like the whole.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
NUL = "\x00"


def unseen(code: int) -> bool:
    """Signs without ink or width: format characters, joiners and variation selectors."""
    return unicodedata.category(chr(code)) == "Cf" and not 0x600 <= code <= 0x605 and code not in (0x6DD, 0x70F) or code in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF


def white(code: int) -> bool:
    """The characters of Unicode's White_Space."""
    return code in (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 9 <= code <= 13 or 0x2000 <= code <= 0x200A


def decomposed(code: int) -> str:
    out = ""
    for c in unicodedata.normalize("NFD", chr(code)):
        kind = unicodedata.decomposition(c)
        ligature = kind.startswith("<compat>") and (0xFB00 <= ord(c) <= 0xFB17 or 0x2160 <= ord(c) <= 0x217F)  # Roman numbers as well
        if kind.startswith(SAME_LOOK) or ligature:
            out += "".join(decomposed(int(x, 16)) for x in kind.split()[1:])
        else:
            out += c
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: number of parts, place of the first; and all parts. Characters without an entry are their own part."""
    size = np.ones(sys.maxunicode + 1, np.uint8)
    place = np.arange(sys.maxunicode + 1, dtype=np.int32)
    more: list[int] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0x20000 <= code <= 0x2F7FF or 0x2FA20 <= code < 0xE0000:
            continue  # ideographs and syllables are their own form
        if code == 0 or unseen(code):
            parts = ""
        elif white(code):
            parts = " "
        else:
            parts = "".join(ALIKE.get(c, c) for c in decomposed(code))
        if parts != chr(code):
            size[code], place[code] = len(parts), len(place) + len(more)
            more += map(ord, parts)
    return size, place, np.concatenate([np.arange(sys.maxunicode + 1, dtype=np.uint32), np.array(more, np.uint32)])


def forms(texts: list[str]) -> list[str]:
    """The one form of each text."""
    if not texts:
        return []
    size, place, parts = tables()
    joined = NUL.join(t.replace(NUL, "") if NUL in t else t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 0
    count = size[codes]
    count[ends] = 1
    start = place[codes]
    start[ends] = 0
    if (count == 1).all():
        out = parts[start]
    else:
        shift = np.cumsum(count, dtype=np.int64) - count
        out = parts[np.repeat(start - shift, count) + np.arange(int(count.sum()))]
    if not len(out):
        return [""] * len(texts)
    edge = (out == 32) | (out == 0)
    out = out[~((out == 32) & np.concatenate([[True], edge[:-1]]))]  # one blank of each run, none at the start
    keep = ~((out == 32) & np.concatenate([out[1:] == 0, [True]]))  # none at the end
    return unicodedata.normalize("NFC", out[keep].tobytes().decode("utf-32-le", "surrogatepass")).split(NUL)


def one_form(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``, the one form of ``text``; narrow, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = iter(forms([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if t is None else next(found) for t in texts], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(*keys, form, raw)``: 128-bit hashes of the form and of the text as it stands, for texts whose form is not empty."""
    source = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField("form", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            at = [i for i, t in enumerate(texts) if t]
            found = forms([texts[i] for i in at])
            at, found = zip(*[(i, f) for i, f in zip(at, found, strict=True) if f], strict=True) if any(found) else ((), ())
            take = pa.array(at, pa.int64())
            hashes = [pa.array([digest(x.encode("utf-8", "surrogatepass")) for x in column], pa.binary()) for column in (found, [texts[i] for i in at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), *hashes], names=schema.names)

    return source.mapInArrow(run, schema)


def look_alike_pairs(prints: DataFrame, key: str, origin: str) -> DataFrame:
    """``(origin, key_a, key_b)``, a < b: records of one origin with one form but different texts.

    Exact copies of a record count once. Forms with only one text drop out by an aggregate that the map side combines;
    what is left is joined by its form, texts first (few, whatever the number of records), then the records of each text.
    """
    rows = prints.select(F.col(origin).alias("origin"), F.col(key).alias("key"), "form", "raw")
    several = rows.groupBy("origin", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo < hi").select("origin", "form")
    rows = rows.join(several, ["origin", "form"], "left_semi").distinct()
    texts = rows.select("origin", "form", "raw").distinct()
    a, b = texts.withColumnRenamed("raw", "raw_a"), texts.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["origin", "form"]).filter("raw_a < raw_b")
    left = rows.select("origin", "form", F.col("raw").alias("raw_a"), F.col("key").alias("x"))
    right = rows.select("origin", "form", F.col("raw").alias("raw_b"), F.col("key").alias("y"))
    both = pairs.join(left, ["origin", "form", "raw_a"]).join(right, ["origin", "form", "raw_b"]).filter("x <> y")
    return both.select("origin", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def look_alike_classes(prints: DataFrame, key: str, origin: str) -> DataFrame:
    """``(origin, key, class_id, texts, records)``: each record that looks like another of its origin with an unequal text.

    One row a record, whatever the size of its class: the records of a form and their different texts are counted.
    """
    rows = prints.select(F.col(origin).alias("origin"), F.col(key).alias("key"), "form", "raw").distinct()
    texts = rows.groupBy("origin", "form", "raw").agg(F.count("*").alias("n"))  # combined before a form is one key
    several = texts.groupBy("origin", "form").agg(F.count("*").alias("texts"), F.sum("n").alias("records")).filter("texts > 1")
    return rows.join(several, ["origin", "form"]).select("origin", "key", F.xxhash64("origin", "form").alias("class_id"), "texts", "records")
