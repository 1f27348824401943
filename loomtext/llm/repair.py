"""Problem 10: text that was decoded with the wrong character encoding.

A *chain* is one way in which a text goes wrong: its bytes in one encoding were read in another (once or twice), or
characters were lost on the way. Which chain a record went through, if any, is a latent variable. Evidence for a chain is the
gain in likelihood, under a character-bigram model of the whole collection, of the spans it would restore over the same spans
as they stand; a lost character counts by the model's mass over what may have stood there. Expectation-maximisation over all
records estimates how common each chain is per source and field, so that weak evidence (one odd word) counts for more where a
source goes wrong that way often, and a record's posterior decides on its repair.

Steps: bigram counts in Arrow batches, pre-aggregated per task (at most ``CODES * CODES`` numbers, whatever the input), over
the texts without signs that only wrong decoding leaves, so that the model is one of clean text; evidence per record in a
second narrow pass over all texts, which looks closely only at spans that hold a character clean text hardly has (a share
under ``RARE``) or a question mark inside a word; EM over the records with evidence, with all records counted per source;
repair by posterior.

Defined cases: null and empty texts are clean; a chain that loses characters (replacement signs, question marks inside words)
marks the record, and its restored text is what can be had: characters that are lost stay as they are; text that is restored
by one chain may go through another round (double encoding). Ties between chains go to the first in ``CHAINS``.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.session import cut_lineage

#: Fixed values: (read as, written as). Pairs with utf-8 first: they prove themselves by valid sequences.
CHAINS = (
    ("cp1252", "utf-8"),
    ("latin-1", "utf-8"),
    ("cp1254", "utf-8"),
    ("cp1250", "utf-8"),
    ("cp1251", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp1254"),
    ("cp1252", "koi8_r"),
    ("cp1252", "cp1256"),
    ("cp1252", "cp874"),
    ("cp1252", "cp932"),
    ("cp1252", "gb18030"),
    ("cp1252", "big5"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("cp850", "utf-8"),
    ("cp437", "utf-8"),
    ("koi8_r", "utf-8"),
)
LOST = len(CHAINS)  # the chain of lost characters
KINDS = LOST + 1
CODES = 2048  # classes of characters in the bigram model
SINGLE = 0x2600  # code points counted one by one; the encodings' characters lie below, but for a private sign
ROUNDS = 20  # at most
SETTLED = 1e-6  # change of a chain's share over all records from which on EM goes on
ALPHA = 20.0  # records of its source's prior that the prior over all sources is worth
START = 0.002  # share of records that a chain is taken to have spoilt, before any evidence
MEMO = 100_000  # spans that a worker keeps the outcome of
VALID = 1.5  # gain of each sign that a valid sequence takes up: other text is valid utf-8 by chance at most
LEAST = 3.0  # gain (nats) from which a span counts
RARE = 1e-5  # share of all characters under which one is rare in clean text


# ---- the bigram model
def classes(text: str) -> np.ndarray:
    """The class of each character: its code point below 1,024, else folded into the rest (scripts stay apart by their blocks)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1024, codes, 1024 + (codes >> 2) % 1024).astype(np.int64) if len(codes) and codes.max() >= 1024 else codes.astype(np.int64)


#: Signs that wrong decoding leaves and that clean text has seldom; texts with one take no part in the model.
LEFT_BEHIND = re.compile(
    "[\x80-\x84\x86-\x9f\ufffd√∂≈∆ƒ∞∫]|[ÂÃÄÅÆÐÑØÙ][\x80-\xbf‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|É™|[â-ï][\x80-\xbf‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2}|[В-Яа-ф][¤¦§©¬®°±µ¶·‚„†‡‰‹‘•™›ЂЃѓЉЊЌЋЏђљњќћџҐґЄєЇїЅѕЈј]|[à-ÿ]{4}|[ÐÑØÙþýð]"
)


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(pair, n)``: how often a class of character follows another; single characters stand as negative pairs."""

    def run(batches):
        total, single, spoilt = np.zeros(CODES * CODES, np.int64), np.zeros(SINGLE, np.int64), LEFT_BEHIND.search
        for batch in batches:
            joined = "\n".join(t for t in batch.column(0).to_pylist() if t and not spoilt(t))
            for at in range(0, len(joined), 1 << 20):
                part = joined[at : at + (1 << 20) + 1]
                c = classes(part)
                pairs, n = np.unique(c[:-1] * CODES + c[1:], return_counts=True)
                total[pairs] += n
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                single += np.bincount(np.minimum(codes, SINGLE - 1), minlength=SINGLE)
        met, one = np.flatnonzero(total), np.flatnonzero(single)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([met, -1 - one])), pa.array(np.concatenate([total[met], single[one]]))], names=["pair", "n"])

    return df.select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of a class after a class, smoothed by the class's own share."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        counts, single = np.zeros(CODES * CODES, np.float32), np.zeros(SINGLE)
        counts[pairs[pairs >= 0]] = n[pairs >= 0]
        single[-1 - pairs[pairs < 0]] = n[pairs < 0]
        known = {c for seen, _ in CHAINS for c in bytes_of(seen) if c >= 0x80}
        least = RARE * max(single.sum(), 1.0)
        self.rare = escaped([c for c in known if c >= SINGLE - 1 or single[c] < least])
        self.look = re.compile(f"[{self.rare}\ufffd]|{LOST_MARK.pattern}").search
        self.rare_in = {i: re.compile(f"[{escaped([c for c in bytes_of(seen) if c >= 0x80 and (c >= SINGLE - 1 or single[c] < least)])}]").search for i, (seen, _) in enumerate(CHAINS)}
        counts = counts.reshape(CODES, CODES)
        own = counts.sum(0) + 0.05
        own /= own.sum()
        rows = counts.sum(1, keepdims=True)
        self.p = (counts + 2 * own) / (rows + 2)
        self.log = np.log(self.p)
        self.memo: dict = {}

    def score(self, text: str) -> float:
        c = classes(text)
        return float(self.log[c[:-1], c[1:]].sum())

    def lost(self, before: str, after: str) -> float:
        """Mass of what may stand between two characters, as a logarithm."""
        a, b = classes(before + after)
        return float(np.log(self.p[a] @ self.p[:, b]))


# ---- the chains
@lru_cache(maxsize=None)
def bytes_of(encoding: str) -> dict[int, int]:
    """Code point to byte of a one-byte encoding; a byte that it leaves undefined stands for the control sign of its number."""
    out = {}
    for b in range(255, -1, -1):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


def escaped(chars: list[int]) -> str:
    return "".join(f"\\U{c:08x}" for c in sorted(chars))


@lru_cache(maxsize=None)
def sequence(chain: int) -> str:
    """A pattern for what one character's bytes in utf-8 look like, read by the chain's encoding."""
    to = {c: b for c, b in bytes_of(CHAINS[chain][0]).items() if b >= 0x80}
    two, three, four, follow = (escaped([c for c, b in to.items() if lo <= b <= hi]) for lo, hi in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF)))
    return f"[{two}][{follow}]|[{three}][{follow} ][{follow}]|[{four}][{follow}]{{3}}"


@lru_cache(maxsize=None)
def spans_of(chain: int) -> re.Pattern:
    """What a chain may have made: for utf-8 runs of sequences, else words with signs beyond ASCII."""
    seen, written = CHAINS[chain]
    if written == "utf-8":
        return re.compile(f"(?:{sequence(chain)})+")
    every = escaped([c for c, b in bytes_of(seen).items() if b >= 0x80])
    if written not in ("cp932", "gb18030", "big5", "cp1254"):
        return re.compile(f"(?<![A-Za-z])[{every}]{{2,}}(?![A-Za-z])")  # words of another script hold no Latin letters
    glue = "A-Za-z" if written == "cp1254" else "!-~"
    return re.compile(f"[{glue}]*[{every}][{every}{glue}]*")


def undone(chain: int, span: str) -> str | None:
    """The span before it went wrong, or nothing where it cannot have come about that way."""
    seen, written = CHAINS[chain]
    raw = codecs.charmap_encode(span, "replace", bytes_of(seen))[0]
    if written == "utf-8":
        raw = re.sub(rb"([\xe0-\xef]) (?=[\x80-\xbf])", b"\\1\xa0", raw)  # a no-break space that became a blank
    try:
        out = raw.decode(written)
    except UnicodeDecodeError:
        return None
    return out if out != span and not re.search(r"[\x00-\x08\x0e-\x1f\x80-\x84\x86-\x9f-]", out) else None


AGAIN = np.array([written == "utf-8" for _, written in CHAINS])  # a further round is one of double encoding
LOST_SIGN = re.compile("\ufffd+")
LOST_MARK = re.compile(r"\?+[^\W\dA-ZА-Я_]")  # starts with a literal: a quick search


def evidence(text: str, model: Model) -> np.ndarray:
    """The gain in nats of each chain over the text as it stands."""
    out = np.zeros(KINDS)
    for chain in range(LOST):
        if model.rare_in[chain](text):
            out[chain] = sum(gain for *_, gain in restored(chain, text, model))
    out[LOST] = 50.0 * len(LOST_SIGN.findall(text))
    for m in LOST_MARK.finditer(text):
        i, marks, b = m.start(), m.group()[:-1], m.group()[-1]
        a = text[i - 1] if i else "\n"
        if b.islower() and (a.isalpha() or a.isspace() or a in "«“\"(["):
            gain = model.lost(a, b) - model.score(a + marks + b)
            out[LOST] += gain if gain > LEAST else 0.0
    return out


def gained(chain: int, span: str, a: str, b: str, model: Model) -> tuple[str, float] | None:
    """The original of a span between two characters and its gain, or nothing."""
    seen, written = CHAINS[chain]
    if not model.rare_in[chain](span) or len(span) < 2 and written != "utf-8":
        return None
    new = undone(chain, span)
    if new is None:
        return None
    gain = model.score(a + new + b) - model.score(a + span + b)
    if written == "utf-8":
        gain += VALID * (len(span) - len(new))
    return (new, gain) if gain > LEAST else None


def restored(chain: int, text: str, model: Model):
    """``(start, end, original, gain)`` of the spans that the chain explains better than the text as it stands."""
    memo, n = model.memo, len(text)
    for m in spans_of(chain).finditer(text):
        i, j = m.span()
        key = (chain, text[i - 1] if i else "\n", m.group(), text[j] if j < n else "\n")
        if key not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = gained(chain, key[2], key[1], key[3], model)
        if found := memo[key]:
            yield i, j, *found


def apply(chain: int, text: str, model: Model) -> str:
    out, at = [], 0
    for start, end, new, _ in restored(chain, text, model):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def repaired(text: str, chain: int, model: Model, rounds: int = 3) -> str:
    """Undoes the chain, and whatever chain then explains more, for double encoding."""
    for _ in range(rounds):
        new = apply(chain, text, model) if chain < LOST else text
        gains = evidence(new, model)[:LOST] * AGAIN
        if new == text and chain < LOST or gains.max() <= LEAST:
            return new
        text, chain = new, int(gains.argmax())
    return text


# ---- over a table
def evidence_rows(df: DataFrame, key: str, text: str, source: str, pairs: DataFrame) -> DataFrame:
    """``(key, source, gains, text)`` of the records with any evidence; narrow, one pass over all texts."""
    rows = pairs.orderBy(F.desc("n"), "pair").limit(CODES * CODES + SINGLE).toPandas()  # all pairs: there are no more than that
    model = df.sparkSession.sparkContext.broadcast((rows["pair"].to_numpy(), rows["n"].to_numpy()))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("gains", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])

    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            keys, sources, texts = (batch.column(i) for i in range(3))
            hits, gains = [], []
            for i, t in enumerate(texts.to_pylist()):
                if t and m.look(t):
                    g = evidence(t, m)
                    if g.max() > 0:
                        hits.append(i)
                        gains.append(g.tolist())
            at = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), sources.take(at), pa.array(gains, pa.list_(pa.float64())), texts.take(at)], names=["key", "source", "gains", "text"])

    found = df.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return found.mapInArrow(run, schema), model


def posteriors(gains: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """Of each chain and (last) of clean text, which gains nothing, a row a record."""
    logs = np.log(np.maximum(priors, 1e-12)) + np.pad(gains, ((0, 0), (0, 1)))
    logs -= logs.max(1, keepdims=True)
    raised = np.exp(logs)
    return raised / raised.sum(1, keepdims=True)


def numbers(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def summed(scored: DataFrame) -> DataFrame:
    """Posterior sums of the chains by source; a batch sends one row a source."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = posteriors(numbers(batch.column("gains")), numbers(batch.column("prior")))[:, :KINDS]
                names, at = np.unique(np.array(batch.column("source").to_pylist(), object).astype(str), return_inverse=True)
                sums = np.zeros((len(names), KINDS))
                np.add.at(sums, at, p)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), *(pa.array(sums[:, k]) for k in range(KINDS))], names=["source", *(f"s{k}" for k in range(KINDS))])

    parts = scored.select("source", "gains", "prior").mapInArrow(run, "source string, " + ", ".join(f"s{k} double" for k in range(KINDS)))
    return parts.groupBy("source").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(KINDS)])


def estimate(found: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(source, prior)`` after EM: the share of each chain and (last) of clean text; ``totals`` counts all records by source.

    Each round sums posteriors by source and draws small sources to the mean of all, until the shares change no more.
    """
    priors = totals.withColumn("prior", F.array(*[F.lit(START / KINDS)] * KINDS, F.lit(1 - START)))
    before = [START / KINDS] * KINDS
    for _ in range(rounds):
        sums = summed(found.join(priors.select("source", "prior"), "source"))
        sums = cut_lineage(totals.join(sums, "source", "left").na.fill(0.0))
        every = sums.agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(KINDS)]).first()
        count = max(every["n"] or 0, 1)
        mean = [((every[f"s{k}"] or 0.0) + START) / (count + 1) for k in range(KINDS)]
        shares = [(F.col(f"s{k}") + ALPHA * mean[k]) / (F.col("n") + ALPHA) for k in range(KINDS)]
        clean = F.greatest(F.lit(1e-6), 1 - sum(shares[1:], shares[0]))
        priors = sums.select("source", "n", F.array(*shares, clean).alias("prior"))
        if max(abs(a - b) for a, b in zip(mean, before, strict=True)) <= SETTLED:
            break
        before = mean
    return priors.select("source", "prior")


def decide(df: DataFrame, key: str, text: str = "text", source: str = "source"):
    """``(key, source, chain, posterior, text)`` of the records that went wrong more likely than not, and the broadcast model."""
    found, model = evidence_rows(df, key, text, source, bigram_counts(df, text))
    found = cut_lineage(found)
    totals = cut_lineage(df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n")))
    scored = found.join(estimate(found, totals), "source")
    schema = T.StructType([found.schema["key"], found.schema["source"], T.StructField("chain", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            p = posteriors(numbers(batch.column("gains")), numbers(batch.column("prior"))) if batch.num_rows else np.zeros((0, KINDS + 1))
            wrong = pa.array(p[:, KINDS] < 0.5)
            chain = pa.array(p[:, :KINDS].argmax(1) if len(p) else np.zeros(0), pa.int32())
            rows = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("source"), chain, pa.array(1 - p[:, KINDS]), batch.column("text")], names=schema.names)
            yield rows.filter(wrong)

    return scored.select("key", "source", "gains", "prior", "text").mapInArrow(run, schema), model


def find_garbled(df: DataFrame, key: str, text: str = "text", source: str = "source") -> DataFrame:
    """The decided records with ``restored``, their text as far as it can be had."""
    wrong, model = decide(df, key, text, source)
    schema = T.StructType([*wrong.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            fixed = [repaired(t, c, m) for t, c in zip(batch.column("text").to_pylist(), batch.column("chain").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fixed, pa.string())], names=schema.names)

    return wrong.mapInArrow(run, schema)


def chain_name(chain: Column) -> Column:
    names = F.array(*[F.lit(f"{written} read as {seen}") for seen, written in CHAINS], F.lit("characters lost"))
    return F.get(names, chain)
