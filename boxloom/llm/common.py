"""What the operators of this subpackage share: tables in the shared folder, words, and hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the controls 9 to 13 (a fixed value of the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch of whole texts: with texts of some MB a batch stays in a worker's memory.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Unset in a local run or test: a new temporary folder;
    on a cluster there is no folder to guess, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables of one computation: Parquet in the shared folder, which cuts lineage and survives lost executors.

    `drop` deletes what nothing reads any more, so the folder holds a computation's live tables only.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, {}, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The rows written once and read back."""
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def parted(self, df: DataFrame, name: str) -> DataFrame:
        """The rows written once, in a folder for each value of the column kind, so that a reader of one kind leaves the others be."""
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """The rows written once in buckets of key, so that later joins on it move the other side only."""
        path, n = new_path(self.spark, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = path.rpartition("/")[2].replace("-", "_")
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        self.paths[path] = out = self.spark.table(table)
        self.names[path] = table
        return out

    def drop(self, *frames: DataFrame, but: tuple = ()) -> None:
        """Deletes these tables; without any named, all of them but those in `but`. Shuffle files that no plan holds go too."""
        gone = [p for p, df in self.paths.items() if (any(df is f for f in frames) if frames else not any(df is f for f in but))]
        for path in gone:
            del self.paths[path]
            if path in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self.names.pop(path)}`")
            removed(self.spark, path)
        self.swept()

    def swept(self) -> None:
        """Spark clears the shuffles of plans that neither Python nor the JVM refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def grown(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the corpus: it is sorted and merged at every size, never broadcast."""
    return df.hint("merge")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table of its own in the shared folder, for results that outlive the call."""
    return Tables(df.sparkSession).stored(df, name)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get; the plan made next takes the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bounds the Arrow batches of what runs inside; the session's own setting is put back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def handed_back(batches):
    """The batches; after the last one, memory that the worker holds free goes back to the system, as other tasks and operators follow."""
    import ctypes

    import pyarrow as pa

    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU library has it
        pass


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered; bytes.split() cuts at exactly the six ASCII blanks of WORD_PATTERN."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes by word. Emptied by `trim` when it holds too many, so memory is bounded whatever the vocabulary."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        self.trim()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 on an unsigned 64-bit array (its two multipliers and shifts are fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; with fewer words one hash of them all; none without words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = hashes.of(words)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc = mixed(acc + h[j : n - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1)))
    return np.unique(acc)


def binary(column):
    """Bytes of an Arrow string column as a list; null stays None."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def as_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_text(name: str):
    return F.col(name).cast("string")
