"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark are the patterns, words are the symbols.  For the patterns of one
length m, blocks of B = 2 words (1 where m = 1) index a shift table: how far the search may jump,
looking only at the last block of the current window, without passing an occurrence.  Where the
shift is 0, the suffix-hash bucket of that block gives the patterns to compare word by word.

Documents are searched where they lie, with no shuffle.  The patterns go to every task, in batches
of at most ``PATTERN_WORDS`` words, which bounds what a task holds; a larger benchmark is searched
batch after batch, and the hits of a document are merged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, table

WINDOW, BLOCK, PATTERN_WORDS, MIN_ITEMS = 8, 2, 4_000_000, 2

#: Bytes of words stay, A-Z become a-z, all others become blanks.  Bytes of code points from 128 on belong to words.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        k = min(width, len(words))
        for i in range(len(words) - k + 1):
            yield tuple(words[i : i + k])


class WuManber:
    """Patterns of one length over any hashable symbols."""

    def __init__(self, patterns: Iterable[tuple], block: int = BLOCK):
        self.patterns = list(dict.fromkeys(patterns))
        self.m = len(self.patterns[0])
        self.b = min(block, self.m)
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple]] = defaultdict(list)
        for p in self.patterns:
            for end in range(self.b, self.m + 1):
                key = p[end - self.b : end]
                self.shift[key] = min(self.shift.get(key, self.m), self.m - end)
            self.bucket[p[self.m - self.b :]].append(p)

    def search(self, words: list) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        m, b, n = self.m, self.b, len(words)
        jump, shift, bucket = m - b + 1, self.shift.get, self.bucket
        if b == 2:
            i = m - 1
            while i < n:
                key = (words[i - 1], words[i])
                s = shift(key, jump)
                if s:
                    i += s
                    continue
                here = tuple(words[i - m + 1 : i + 1])
                for p in bucket[key]:
                    if p == here:
                        yield i - m + 1, p
                i += 1
            return
        i = m
        while i <= n:
            key = tuple(words[i - b : i])
            s = shift(key, jump)
            if s:
                i += s
                continue
            here = tuple(words[i - m : i])
            for p in bucket[key]:
                if p == here:
                    yield i - m, p
            i += 1


class Matcher:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        owners: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), width):
                owners[w].add(item)
        self.owners = dict(owners)
        lengths = defaultdict(list)
        for w in owners:
            lengths[len(w)].append(w)
        self.searches = [WuManber(x) for x in lengths.values()]

    def hits(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Starts and ends, in turn, of the runs of hit words; the items that occur."""
        marks, items = [], set()
        for search in self.searches:
            for at, p in search.search(words):
                marks.append((at, at + search.m))
                items |= self.owners[p]
        runs: list[int] = []
        for a, b in sorted(marks):
            if runs and a <= runs[-1]:
                runs[-1] = max(runs[-1], b)
            else:
                runs += [a, b]
        return runs, items


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_OUT = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, hit_runs array<int>, items array<string>"


def _search(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n, hit, count, sha, runs, items = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                r, found = matcher.hits(words)
                n.append(len(words))
                hit.append(sum(r[1::2]) - sum(r[::2]))
                count.append(len(found))
                sha.append(_digest(found))
                runs.append(r)
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, hit, count)), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "hit_runs", "items"],
            )

    return run


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        rows = batch.to_pydict()
        hit, count, sha, runs, items = [], [], [], [], []
        for many, names in zip(rows["runs"], rows["names"], strict=True):
            r: list[int] = []
            for a, b in sorted((a, b) for x in many for a, b in zip(x[::2], x[1::2], strict=True)):
                if r and a <= r[-1]:
                    r[-1] = max(r[-1], b)
                else:
                    r += [a, b]
            found = {i for x in names for i in x}
            hit.append(sum(r[1::2]) - sum(r[::2]))
            count.append(len(found))
            sha.append(_digest(found))
            runs.append(r)
            items.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["text_hash"], pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "hit_runs", "items"],
        )


def _batches(benchmark: DataFrame, pattern_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in batches whose windows have at most so many words (one item at least)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # each character is in at most WINDOW windows; slices by hash keep each collected part small
    slices = max(1, int(-(-size * WINDOW // (4 * pattern_words))))
    for k in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield [(r[0], r[1]) for r in part.where("item_id is not null and text is not null").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, pattern_words: int = PATTERN_WORDS, min_items: int = MIN_ITEMS) -> DataFrame:
    """documents (doc_id, text) and benchmark (item_id, text) -> one row for each document row.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, then hit_runs (starts and
    ends of the runs of hit words, in turn) and items.  Null and empty texts have no words; an item
    with no words or a null id is no pattern; equal item_ids are one item.  Repeated documents give
    repeated rows; other columns of any name are not read.  With an empty benchmark nothing is hit, and empty
    documents give an empty result.  Long texts are searched whole; windows of several items at one place all count.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = [docs.mapInArrow(_search(Matcher(items)), _OUT) for items in _batches(benchmark, pattern_words)]
    if len(found) == 1:
        out = found[0]
    else:
        scratch = Scratch(spark, "decontaminate")
        # rows of one doc_id and text are alike, so that any numbering of them agrees between batches
        alike = Window.partitionBy("doc_id", "text_hash").orderBy("n_words")
        parts = [scratch.keep(df.withColumn("copy", F.row_number().over(alike))) for df in found]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        every = every.groupBy("doc_id", "text_hash", "copy", "n_words").agg(F.collect_list("hit_runs").alias("runs"), F.collect_list("items").alias("names"))
        out = every.select("doc_id", "text_hash", "n_words", "runs", "names").mapInArrow(_merged, _OUT)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= min_items).alias("contaminated"), "hit_runs", "items"
    )


def op6_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_runs", "items")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS s
  FROM bw, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0
), occ AS (
  SELECT doc_id, item_id, i, p.k FROM (SELECT DISTINCT k FROM pat) ks, dw, unnest(range(1, len(w) - ks.k + 2)) AS r(i)
  JOIN pat p ON p.k = ks.k AND p.s = array_to_string(w[i : i + ks.k - 1], ' ')
), hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, unnest(range(0, k)) AS q(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""
