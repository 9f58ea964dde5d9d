"""Document fingerprints from improbable features in chained Bloom filters.

A feature is a window of ``WIDTH`` bytes.  Its entropy gives its rarity: how seldom windows of that
entropy occur in the corpus, counted over all windows of all texts.  Of every ``SPAN`` neighbouring
windows the rarest, leftmost, gets a vote, and a window with ``VOTES`` votes is selected.  Selected
features go, in order, into a chain of Bloom filters of ``BITS`` bits, ``PER_FILTER`` features each, with
``HASHES`` bits a feature.

Two fingerprints are compared filter by filter: the bits in common, less those expected by chance,
over the most that could be; the mean, over the filters of the shorter chain, of the best match.

Neighbours are found by dealing the documents out by ranges of doc_id, whose border rows, one a range,
are dealt twice; no task sees more than its range, and no order of all rows is made in one place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, U64, mix, pieces, prefix_hash, range_hash, table, whole_groups

WIDTH, SPAN, VOTES, BITS, PER_FILTER, HASHES, LEVELS = 64, 64, 16, 2048, 160, 5, 1001

_C = np.arange(WIDTH + 1, dtype=np.float64)
#: c * log2(c) in fixed point, so that sums are exact however they are made.
_TERM = np.round(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * (1 << 32)).astype(np.int64)
_GAIN = np.diff(_TERM)


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """For each window of WIDTH bytes, its entropy from 0 to LEVELS - 1 (6 bits); shorter texts have none."""
    n = len(buf)
    if n < WIDTH:
        return np.empty(0, dtype=np.int16)
    back, ahead = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, WIDTH):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    first = _TERM[np.bincount(buf[:WIDTH], minlength=256)].sum()
    step = _GAIN[back[WIDTH:]] - _GAIN[ahead[: n - WIDTH]]
    sums = first + np.concatenate(([0], np.cumsum(step)))
    bits = np.log2(WIDTH) - sums / float(WIDTH * (1 << 32))
    return np.clip(np.floor(bits / np.log2(WIDTH) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int16)


def select(levels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the selected windows: rarest (least rank) of SPAN neighbours often enough."""
    n = len(levels)
    if not n:
        return np.empty(0, dtype=np.int64)
    span = min(SPAN, n)
    key = rank[levels].astype(np.int64) * (1 << 32) + np.arange(n)
    low, width = key, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    votes = np.bincount((low & 0xFFFFFFFF).astype(np.int64), minlength=n)
    return np.flatnonzero(votes >= min(VOTES, len(low)))


def digest(text: str, rank: np.ndarray) -> np.ndarray:
    """The chain of filters, one row of BITS / 8 bytes each; a text shorter than a window is one feature."""
    raw = text.encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, dtype=np.uint8)
    if not len(buf):
        return np.zeros((0, BITS // 8), dtype=np.uint8)
    h = prefix_hash(BYTE[buf])
    at = select(entropy_levels(buf), rank)
    if len(buf) < WIDTH:
        features = range_hash(h, np.array([0]), np.array([len(buf)]))
    else:
        features = range_hash(h, at, at + WIDTH)
    # a feature counts once, where it first stands
    _, first = np.unique(features, return_index=True)
    features = features[np.sort(first)]
    chain = -(-len(features) // PER_FILTER)
    bits = np.zeros((chain, BITS), dtype=np.uint8)
    which = np.arange(len(features)) // PER_FILTER
    shift = int(np.log2(BITS))
    for k in range(HASHES):
        bits[which, ((features >> U64(shift * k)) % U64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1; equal chains are 1, an empty one is unlike any other."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = _ONES[a].sum(axis=1), _ONES[b].sum(axis=1)
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = _ONES[a[i] & b].sum(axis=1)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        best[i] = np.max((both - chance) / np.maximum(most - chance, 1e-9))
    return float(np.clip(best, 0, 1).mean())


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, other: str) -> str:
    """The text with its last half of code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS, dtype=np.int64)
    for batch in pieces(batches, "text"):
        for text in batch.column(0).to_pylist():
            total += np.bincount(entropy_levels(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)), minlength=LEVELS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, rarest first, over all windows of all texts (LEVELS rows to the driver)."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_histogram, "level int, n long")
    n = np.zeros(LEVELS, dtype=np.int64)
    for r in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r[0]] = r[1]
    rank = np.empty(LEVELS, dtype=np.int32)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return rank


def _ranges(docs: DataFrame, count: int) -> list[int]:
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    return sorted({int(c) for c in cuts})


def fingerprints(docs: DataFrame, *, rows_a_range: int = 2000) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row for each input row.  The next document is the one with the next lower doc_id (rows that repeat
    a doc_id follow in the order of their texts, null ids come last), and after the last the first; a
    lone document is its own next.  Null texts are empty; an empty text has an empty fingerprint.  Long texts are read
    whole, with as many filters as their features need.  Equally rare windows of a neighbourhood go to the leftmost, equally
    rare levels to the lower one.  An empty table gives an empty result; other columns of any name are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = rarity(docs)
    n = docs.count()
    cuts = _ranges(docs.select("doc_id"), max(1, min(4096, n // rows_a_range)))
    # range 0 holds the highest ids; nulls come last
    part = F.lit(len(cuts))
    if cuts:
        part = F.expr(f"cast({len(cuts)} - size(filter(array({','.join(map(str, cuts))}L), c -> doc_id > c)) as int)".replace(",", "L,").replace("L, c ->", ", c ->"))
        part = F.coalesce(part, F.lit(len(cuts)))
    ids = docs.select("doc_id", F.length("text").alias("k"), F.md5(F.col("text").cast("binary")).alias("h")).withColumn("part", part)
    head = ids.groupBy("part").agg(F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", F.expr("translate(h, '0123456789abcdef', 'fedcba9876543210')"))).alias("top"), F.count("*").alias("n")).orderBy("part").collect()
    if not head:
        return docs.select("doc_id", F.lit(None).cast("long").alias("n_chars"), *(F.lit(None).cast("string").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(F.lit(None).cast("double").alias(c) for c in ("near_edited", "near_next")))
    used = [r["part"] for r in head]
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the range before a range also needs its first row
    spark = docs.sparkSession
    tops = spark.createDataFrame([(r["top"]["doc_id"], r["top"]["h"], r["part"], before[r["part"]]) for r in head], "top_id long, top_h string, top_part int, also int")
    rows = docs.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("part", part).select("part", "doc_id", "h", F.lit(0).alias("extra"), "text")
    first = rows.join(F.broadcast(tops), (F.col("part") == F.col("top_part")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")))
    first = first.select(F.col("also").alias("part"), "doc_id", "h", F.lit(1).alias("extra"), "text").dropDuplicates(["part"])
    dealt = rows.union(first).repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, waiting for its next
        for batch in pieces(batches, "text"):
            out = []
            for p, i, x, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                now = (p, i, x, text, digest(text, rank))
                if held is not None and held[0] == p and not held[2]:
                    out.append(_row(held, now, rank))
                held = now
            yield _rows(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(own: tuple, following: tuple, rank: np.ndarray) -> tuple:
    _, i, _, text, chain = own
    new = edited(text, following[3])
    other = digest(new, rank)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), sha, encode(chain), encode(other), likeness(chain, other), likeness(chain, following[4])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op3_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
