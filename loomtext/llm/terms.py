"""Problem 6: how often every term occurs, and in how many records, kept up by signed deltas.

A state is a table of counts ``(term, occurrences, records)``. It is never recounted: a change of the records becomes a
table of signed texts (``+1`` for what came, ``-1`` for what went), which is aggregated to one delta per term and merged
into the state. Only changed records are tokenised, and only the buckets that hold changed terms are written again. The term
``ALL`` counts the records themselves.

A state on disk is a folder of data (``data/<batch>-<run>/bucket=<n>``) and manifests (``manifests/<batch>``), which name the
folder of each bucket. A batch is merged by writing its buckets to a new folder and then, in one rename, its manifest: a crash
before that leaves the state as it was, a batch that is in the state already is not merged again, and readers see whole
batches only.

Defined cases: null and blank texts hold no term and are no record for the share of "common"; a record whose text is
unchanged gives no delta; a term without records leaves the state; exact copies of a record are one record; an empty table
gives an empty state. Column names of the input other than the named ones play no part.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import cut_lineage, one_record

#: A term: a maximal run of letters and combining marks of the lower-cased text.
TERM = r"[\p{L}\p{M}]+"
BLANK = r"(?U)^\s*$"
BUCKETS = 64
ALL = ""
STATE = "term string, occurrences bigint, records bigint"


def is_filled(text: Column) -> Column:
    return F.coalesce(~text.rlike(BLANK), F.lit(False))


def signed_changes(old: DataFrame | None, new: DataFrame, key: str, text: str) -> DataFrame:
    """``(text, sign)`` of the records that were added, changed or deleted between two versions of a table.

    Without an old version every record is an addition and nothing is joined. Else both versions are compared by key and a
    128-bit hash of the text; the texts of what changed alone are fetched.
    """
    new = one_record(new.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    if old is None:
        return new.select(F.col("t").alias("text"), F.lit(1).alias("sign"))
    old = one_record(old.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    here, there = (side.select("k", F.md5("t").alias("h"), F.lit(sign).alias("sign")) for side, sign in ((new, 1), (old, -1)))
    changed = here.unionByName(there).groupBy("k", "h").agg(F.sum("sign").alias("sign")).filter("sign <> 0 and h is not null")
    came, went = (side.withColumn("h", F.md5("t")).join(changed.filter(f"sign = {sign}").select("k", "h"), ["k", "h"], "left_semi").select(F.col("t").alias("text"), F.lit(sign).alias("sign")) for side, sign in ((new, 1), (old, -1)))
    return came.unionByName(went)


def marked_terms(text: Column) -> Column:
    """The terms of one text with a flag at the first of each, so that one aggregation counts occurrences and records."""
    terms = F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))
    return F.transform(F.arrays_zip(terms.alias("w"), F.concat(F.array(F.lit("")), terms).alias("p")), lambda x: F.struct(x["w"].alias("term"), (x["w"] != x["p"]).cast("int").alias("first")))


def term_deltas(signed: DataFrame) -> DataFrame:
    """``(text, sign)`` to ``(term, occurrences, records)``, signed. The map side combines, so a hot term is one row a task."""
    filled = signed.filter(is_filled(F.col("text")))
    itself = F.array(F.struct(F.lit(ALL).alias("term"), F.lit(1).alias("first")))
    terms = filled.select("sign", F.inline(F.concat(itself, marked_terms(F.col("text"))))).filter(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.sum("sign").alias("occurrences"), F.sum(F.col("sign") * F.col("first")).alias("records"))


def merge_counts(state: DataFrame | None, deltas: DataFrame, *more: str) -> DataFrame:
    """The new state; terms that are gone leave it."""
    columns = [*more, "term", "occurrences", "records"]
    both = deltas.select(*columns) if state is None else state.select(*columns).unionByName(deltas.select(*columns))
    return both.groupBy(*more, "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 or records <> 0")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Store:
    """The files of a state, through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark.sparkContext._jvm
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The last batch and the folder of each bucket."""
        folder = self.at("manifests")
        names = [f.getPath().getName() for f in self.files.listStatus(folder)] if self.files.exists(folder) else []
        batches = sorted(n for n in names if n.isdigit())
        if not batches:
            return 0, {}
        stream = self.files.open(self.at(f"manifests/{batches[-1]}"))
        try:
            return int(batches[-1]), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, batch: int, buckets: dict[str, str]) -> None:
        """Makes a batch's manifest the last one; of two writers of a batch one fails."""
        self.files.mkdirs(self.at("manifests"))
        draft = self.at(f"manifests/_{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(buckets).encode()))
        stream.close()
        if not self.files.rename(draft, self.at(f"manifests/{batch:012d}")):
            raise RuntimeError(f"batch {batch} of {self.path} was merged by another writer")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last batch; a path that does not exist yet is an empty state."""
    folders = sorted(set(Store(spark, path).manifest()[1].values()))
    return spark.read.schema(STATE).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders]) if folders else spark.createDataFrame([], STATE)


def update_state(path: str, deltas: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Merges the deltas of a batch into a persistent state; batches count up, and one that has been merged is not merged again.

    Only the buckets that hold a changed term are read and written.
    """
    spark = deltas.sparkSession
    store = Store(spark, path)
    last, folders = store.manifest()
    if batch <= last:
        return
    marked = cut_lineage(deltas.withColumn("bucket", bucket(F.col("term"), buckets)))
    touched = [str(r["bucket"]) for r in marked.select("bucket").distinct().collect()]  # at most `buckets` numbers
    old = sorted({folders[b] for b in touched if b in folders})
    state = spark.read.schema(STATE).parquet(*[f"{store.path}/{f}" for f in old]).withColumn("bucket", bucket(F.col("term"), buckets)) if old else None
    merged = merge_counts(state, marked, "bucket")
    data = f"data/{batch}-{uuid.uuid4().hex}"
    merged.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{store.path}/{data}")
    kept = {b: f for b, f in folders.items() if b not in touched}
    new = {b: f"{data}/bucket={b}" for b in touched if store.files.exists(store.at(f"{data}/bucket={b}"))}
    store.commit(batch, kept | new)


def saved_deltas(saves: DataFrame, seen_until=None) -> DataFrame:
    """``(word, batch_no, cn, saved_at, vocab_id)`` saves to ``(term, occurrences, records)`` deltas.

    A word saved again for a batch replaces its older save: the delta is the new count less the replaced one, whatever order
    the rows are stored in. Rows with a null word or count are left out; of two saves at one time the higher vocab_id holds.
    With ``seen_until`` (a timestamp) only later saves count, and the save in force at that time is taken back.
    """
    rows = saves.filter(F.col("word").isNotNull() & F.col("cn").isNotNull())
    save = F.struct("saved_at", "vocab_id", "cn")
    before = F.col("saved_at") <= F.lit(seen_until) if seen_until is not None else F.lit(False)
    last = rows.groupBy("word", "batch_no").agg(F.max(save).alias("now"), F.max(F.when(before, save)).alias("then"))
    new = F.coalesce(F.col("then").isNull().cast("int"), F.lit(0))
    delta = F.col("now.cn") - F.coalesce(F.col("then.cn"), F.lit(0))
    return last.groupBy(F.col("word").alias("term")).agg(F.sum(delta).alias("occurrences"), F.sum(new).alias("records"))


def mark_terms(counts: DataFrame, rare_below: int, is_common: Column) -> DataFrame:
    """One row for each term and mark; a term may be both."""
    marks = F.array_compact(F.array(F.when(F.col("occurrences") < rare_below, F.lit("rare")), F.when(is_common, F.lit("common"))))
    return counts.select("*", F.explode(marks).alias("mark"))
