"""Sessions, table access and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomtext")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and the master is local (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        atexit.register(shutil.rmtree, configured, True)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder and reads them from there; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is removed by ``remove_written``, at exit at the latest."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as compressed columns: for larger tables of which parts are read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session has ended before: nothing can be removed through it
            return


def parallelism(spark: SparkSession) -> int:
    """Number of partitions to spread a CPU-heavy Python stage over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """More partitions for CPU-heavy work over a table in few files; only where the scan has fewer than there are cores."""
    spark = df.sparkSession
    return df.repartition(parallelism(spark)) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def one_record(df: DataFrame, *key: str) -> DataFrame:
    """Exact copies of a row (same key, all columns equal) are one record; unlike rows with one key all stay."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(list(key))
    return df.withColumn("__row", F.xxhash64(*rest)).dropDuplicates([*key, "__row"]).drop("__row")


FEW = 1 << 20  # keys of repeated rows that are sent to all executors; more of them are joined


def sole_record(df: DataFrame, key: str) -> DataFrame:
    """``one_record`` of a table in which few keys stand twice: only their rows are moved and compared; those without a key all stay."""
    spark = df.sparkSession
    repeated = df.select(key).filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    first = repeated.limit(FEW + 1).toArrow()
    few = first.num_rows <= FEW
    if not first.num_rows:
        return df
    keys = F.broadcast(spark.createDataFrame(first, repeated.schema)) if few else cut_lineage(repeated)
    again = cut_lineage(one_record(df.join(keys, key, "left_semi"), key))
    return df.join(keys, key, "left_anti").unionByName(again.coalesce(1) if few else again)
