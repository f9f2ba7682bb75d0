"""Helpers shared by the operators: materialised stages, words, hashes, batching."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partner_analytics.operators.joins import REDUCER_BITS, ROW_BITS
from partner_analytics.session import shared_folder

#: characters of text that a Python worker handles at once
CHUNK_CHARS = 4_000_000


def staged(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage.

    Every executor sees the files, so a lost executor costs a task at most, and row order and ids
    given before the write stay as they are. What ``df`` shuffled is freed after the write if it runs ``once``.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(key, None)
    if once:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if once:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        if not re.search("-[0-9a-f]{32}$", path):
            raise ValueError(f"{path} is no staged table")
        folder = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(path))  # the paths are encoded
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[str] = set()
#: bytes of rows in one Arrow batch; Spark's own 64 MB of texts stand several times in a JVM and its workers
BATCH_BYTES = CHUNK_CHARS


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the Python workers of the session, once for each application, and bounds their batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "partner_analytics.zip")
        with zipfile.ZipFile(archive, "w") as file:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        file.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(archive)  # Spark serves it to the executors
        _SHIPPED.add(context.applicationId)
    return spark


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def split(docs: DataFrame, code: Column, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose 64-bit ``code`` may be among those of ``few`` (code), and rows whose code is not.

    Only the first have to be joined with what ``few`` stands for; texts of the others are not shuffled.
    The codes set bits of a bitmap of 2 MB at any size, so the more codes, the more rows are in the first.
    """
    bit, part, bits = free(docs, "_bit"), free(docs, "_part"), free(docs, "_bits")
    place = F.pmod(F.col("code"), F.lit(REDUCER_BITS))
    bitmap = few.select(place.alias(bit)).groupBy(F.expr(f"{bit} div {ROW_BITS}").alias(part)).agg(
        F.bitmap_construct_agg(F.col(bit) % ROW_BITS).alias(bits))  # REDUCER_BITS / ROW_BITS rows at most
    bitmap = staged(bitmap, "bitmap")
    marked = docs.withColumn(bit, F.pmod(code, F.lit(REDUCER_BITS))).withColumn(part, F.expr(f"{bit} div {ROW_BITS}")).join(
        F.broadcast(bitmap), part, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(bit) % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(hit).select(*names), marked.where(~hit).select(*names)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8 bytes."""
    return text.encode().lower().split() if text else []


def id_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


class HashOf(dict):
    """64-bit hash of each word, kept for the words seen so far in this worker."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


HASHES = HashOf()


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * GOLDEN + values[i:i + count])
    return out


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of a text column, or items of a list column; one row at least."""
    column = batch.column(text)
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    ends, start, total = [], 0, 0
    for i, size in enumerate(length(column).fill_null(0).to_numpy(zero_copy_only=False)):
        total += int(size)
        if total >= most:
            ends.append(i + 1)
            total = 0
    for end in [*ends, batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def by_chunk(function: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", most: int = CHUNK_CHARS):
    """A ``mapInArrow`` function that applies ``function`` to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, most):
                yield function(part)
        give_back()

    return run


def give_back() -> None:
    """Free memory of this worker goes to the system; Spark keeps workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
