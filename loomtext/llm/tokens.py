"""Problem 8: texts to the ids of a public byte-level BPE vocabulary, and back.

The vocabulary file (base64 token and rank a line) is a parameter and is read on every executor; nothing is trained. A text is
cut into words by the vocabulary's split pattern; a word's bytes form a doubly linked list of symbols, and a priority queue
holds the rank of every adjacent pair. The lowest rank is merged, the pairs that it breaks stay in the queue as stale entries
and are skipped when they come up. That is ``O(n log n)`` in the length of a word, so that unbroken strings of any length pass.
Words repeat, so each Python worker keeps the ids of words it has met (``MEMO`` of them, then it starts anew: a bound on
memory, without effect on results).

Defined cases: null and empty texts both give an empty list; strings of special tokens in a text are ordinary text; an
unpaired surrogate cannot occur in Spark's UTF-8; decoding concatenates the tokens' bytes and gives the text back exactly.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
MEMO = 400_000
MEMO_WORD = 64  # longer words are not kept


def vocabulary_path(name: str = DEFAULT, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def char_class(*majors: str, below: int = sys.maxunicode + 1) -> str:
    """The code points of the general categories that start with one of ``majors``, as the inside of a ``re`` class."""
    found = (c for c in range(below) if unicodedata.category(chr(c)).startswith(majors))
    out = []
    for _, run in groupby(enumerate(found), lambda x: x[1] - x[0]):
        cs = [c for _, c in run]
        out.append(f"\\U{cs[0]:08x}" + (f"-\\U{cs[-1]:08x}" if len(cs) > 1 else ""))
    return "".join(out)


@lru_cache(maxsize=2)
def split_pattern(below: int) -> re.Pattern:
    """The split pattern of the public byte-level vocabularies, with letters, numbers and blanks spelled as ranges.

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks before a blank|blanks

    ``below`` bounds the code points: a class of the first plane alone is a table look-up, with the others it is a search.
    """
    letter, number = char_class("L", below=below), char_class("N", below=below)
    blank = r"\t-\r\x85 \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class ByteBpe(dict):
    """Maps a word to its ids, as the bytes of 32-bit integers; a missing word is encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.first_plane, self.all_planes = (split_pattern(below).findall for below in (0x10000, sys.maxunicode + 1))

    def split(self, text: str) -> list[str]:
        return (self.first_plane if max(text) < "\U00010000" else self.all_planes)(text)

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.merge(word.encode())).tobytes()
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        n = len(data)
        rank, none = self.ranks.get, -1
        end = list(range(1, n + 2))  # where the symbol that starts here ends
        left = list(range(-1, n))  # where the symbol before it starts
        pair = [rank(data[i : i + 2], none) for i in range(n)]  # rank of this symbol with the next one
        pair[-1:] = [none]
        queue = [r * n + i for i, r in enumerate(pair) if r >= 0]  # rank first, then place
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, a = divmod(pop(queue), n)
            if pair[a] != r:  # stale: one of the two symbols has been merged with another
                continue
            b = end[a]
            e = end[a] = end[b]
            pair[a] = pair[b] = none
            if e < n:
                left[e] = a
                r = pair[a] = rank(data[a : end[e]], none)
                if r >= 0:
                    push(queue, r * n + a)
            p = left[a]
            if p >= 0:
                r = pair[p] = rank(data[p:e], none)
                if r >= 0:
                    push(queue, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(rank(data[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    by_rank = {r: t for t, r in encoder(path).ranks.items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


@lru_cache(maxsize=2)
def token_column(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.large_binary())


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The texts that lists of ids stand for: one look-up for all ids of a batch; an id that the vocabulary has not is an error."""
    flat = ids.flatten()
    if flat.null_count:
        raise ValueError("an id is missing")
    found = tokens.take(flat)
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)]), dtype=np.int64)
    places = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)])[ends].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return pa.array([str(data[a:b], "utf-8", "replace") if known else None for a, b, known in zip(places, places[1:], ids.is_valid().to_pylist())], pa.string())


def encode(df: DataFrame, text: str = "text", name: str = DEFAULT, folder: str = TOKENIZERS, to: str = "ids") -> DataFrame:
    """``df`` with its ``text`` column replaced by ``to``, an array of ids (int). Narrow: one pass in Arrow batches, no shuffle."""
    path = vocabulary_path(name, folder)
    keep = [c for c in df.columns if c != text]
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add(to, T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            found = [bpe.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, to])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", name: str = DEFAULT, folder: str = TOKENIZERS, to: str = "n_tokens") -> DataFrame:
    """``df`` with its ``text`` column replaced by the number of its ids (long); null and empty texts have none."""
    path = vocabulary_path(name, folder)
    keep = [c for c in df.columns if c != text]
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add(to, T.LongType())

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            sizes = [len(bpe.encode(t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, to])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", name: str = DEFAULT, folder: str = TOKENIZERS, to: str = "text") -> DataFrame:
    """``df`` with its ``ids`` column replaced by the text that they stand for; null ids give null, no ids the empty text."""
    path = vocabulary_path(name, folder)
    keep = [c for c in df.columns if c != ids]
    source = df.select(*keep, F.col(ids).alias("__ids"))
    schema = source.drop("__ids").schema.add(to, T.StringType())

    def run(batches):
        tokens = token_column(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], decoded(batch.column(batch.num_columns - 1), tokens)], names=[*keep, to])

    return source.mapInArrow(run, schema)
