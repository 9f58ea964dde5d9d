"""What the corpus operators share: tables, shared storage, vectorised text hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a default where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``drop`` frees a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, *keys, tasks: int | None = None) -> DataFrame:
    """Rows dealt out by key and sorted by it within each task, for streaming over whole groups."""
    parts = [tasks] if tasks else []
    return df.repartition(*parts, *keys).sortWithinPartitions(*keys)




# --- vectorised hashing -------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    if n > 1:
        out[1:] = U64(base % (1 << 64))
        np.multiply.accumulate(out, out=out)
    return out[:n]


class Powers:
    """Grown on demand and kept for the life of a worker."""

    def __init__(self, base: int):
        self.base, self.have = base, powers(base, 1 << 12)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.have):
            self.have = powers(self.base, max(n, 2 * len(self.have)))
        return self.have[:n]


POW, INV = Powers(_P), Powers(_PINV)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[t] * P**t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * POW(len(codes)), out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same value for equal code ranges wherever they stand."""
    return mix((h[end] - h[start]) * INV(len(h))[start])


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the maximal runs of bytes other than blank, tab, LF, VT, FF and CR; A-Z count as a-z."""
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=U64)
    upper = (buf >= 65) & (buf <= 90)
    return range_hash(prefix_hash(BYTE[buf + (upper * np.uint8(32))]), start, end)


_LANES = mix(np.arange(11, 75, dtype=U64)) | U64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle, no words none."""
    if not text:
        return np.empty(0, dtype=U64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    out = np.full(n - k + 1, U64(k), dtype=U64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _LANES[i]
    return np.unique(mix(out))


# --- Arrow helpers ----------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about so many bytes; a longer text comes alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > at and total + n > chars:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """From batches sorted by key: tables of whole groups, of about so many rows or one larger group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
            rest = t.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
