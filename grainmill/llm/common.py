"""What several operators share: checkpoints, word splitting and hashing inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII blanks: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def local_checkpoints(sc) -> str:
    """A folder on this machine, which only holds what every task sees if driver and tasks are one process."""
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one of our own where there is no cluster; on a cluster without one this is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_checkpoints(sc))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, with the lineage cut in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, as a table in the checkpoint folder. For loops: a checkpoint keeps the size that Spark guesses from the plan
    behind it, which joins multiply from round to round until the guess itself fills the driver; a table's size is that of its files."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids of at most so many bytes may go to every task; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def checked_broadcast(ids: DataFrame, most_bytes: int = BROADCAST_BYTES, row_bytes: int = 16) -> DataFrame:
    """A table of ids, marked for broadcast if its counted rows are few enough; cut, since it is counted and then used."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() * row_bytes <= most_bytes else ids


#: A key with more than a HEAVY-th of all rows is hot, so there are fewer than HEAVY such keys whatever the input; its rows are dealt to SALTS parts.
HEAVY, SALTS, LEAST_HOT = 1000, 64, 1000


def hot_keys(counted: DataFrame, on: list[str], total: int, rows: str = "n") -> DataFrame:
    """The keys of `counted` that have more than a HEAVY-th of `total` rows; fewer than HEAVY of them."""
    return counted.filter(F.col(rows) > max(total // HEAVY, LEAST_HOT)).select(*on)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how), with the left rows of the `hot` keys dealt to SALTS parts by a hash of `by`, and their right rows copied to each part."""
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("__hot")))
    own = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marked, on, "left").withColumn("__salt", own).drop("__hot")
    b = right.join(marked, on, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values: every input bit moves every output bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class WordHashes(dict):
    """64-bit hash of a word, remembered; the memory is bounded by forgetting."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct sorted hashes of the runs of `width` words; all the words as one run if there are fewer, none if there are none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * U64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    return np.unique(h)


def in_slices(make, rows: int = 256):
    """For mapInArrow: `make()` gives a function of frames, called on few rows at a time, so that a batch of whole texts isn't copied at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pandas(f(batch.slice(at, rows).to_pandas()), preserve_index=False)
        pa.default_memory_pool().release_unused()

    return run


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on fewer rows go to Python at once; for sessions that pass whole texts through several stages in little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: The unsigned CRC-32 of a short ASCII string.
CRC32_SQL = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(%(s)s) + 1), lambda i: ascii(%(s)s[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
