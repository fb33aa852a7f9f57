"""What the corpus operators share: tables, the shared folder, folds and batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder


#: Spark's setting that deletes the shuffle files of a query when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and
    the shuffles of the write are deleted with it, as nothing reads them again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(column: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod modulus is remainder; false for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % modulus == remainder, F.lit(False))


#: 64-bit words of a bitmap: 2**24 bits, so what is broadcast has at most this many rows whatever the data
BITMAP_WORDS = 1 << 18


def _place(key: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftright(key, 6), F.lit(BITMAP_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(63)).cast("int"))


def flagged(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`, true wherever key (a 64-bit hash) is among keys(key), and by
    chance for others: a broadcast bitmap of bounded size, so that rows which have no part
    in a later exact join need not be shuffled for it."""
    word, bit = _place(F.col("key"))
    bits = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    at, held = fresh(rows, f"{name}_word"), fresh(rows, f"{name}_bits")
    bits = F.broadcast(bits.withColumnsRenamed({"w": at, "b": held}))
    own, mine = _place(key)
    found = rows.join(bits, own == bits[at], "left")
    return found.withColumn(name, F.coalesce(F.col(held).bitwiseAND(mine) != 0, F.lit(False))).drop(at, held)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


#: what a worker keeps from task to task, by the function that does
kept: dict[str, dict] = {}


def give_back(keep: str | None = None) -> None:
    """Returns freed memory of this worker to the system, and what functions other than
    `keep` have kept: workers outlive stages, and what one stage has left would stand beside
    what the next one needs."""
    for name in [n for n in kept if n != keep]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def giving(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory back before it begins and after its last batch."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return given


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about `most`; a larger row stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
