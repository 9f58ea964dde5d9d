"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the ``PROFILE`` most frequent 1- to 3-grams of letters within words (a word has
a blank before and after it).  The profiles of the languages are counted over all labelled
documents; a document goes to the language with the least out-of-place distance: the sum, over the
document's own most frequent n-grams, of how far each stands from its place in the profile, or
``PROFILE`` where it is not in it.  Equal counts rank by code, equal distances by language name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table

PROFILE, SHARPNESS, MAX_LANGUAGES = 300, 40.0, 20_000
#: Out-of-place distance (0 to 1) from which a text is in none of the learned languages: prose is below 0.6, another script at 1.
FARTHEST = 0.75
#: Distinct n-grams below which the distance says too little to turn a text away.
TELLING = 50
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text, 21 bits a letter; empty if it has no letter."""
    if not text:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c = np.where(letters()[c], c, 0)
    gap = c == 0
    c = np.concatenate(([0], c[~(gap & np.concatenate(([True], gap[:-1])))], [0]))
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 0]
    return np.concatenate((c[c != 0], two | (1 << 62), three))


def ranked(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first."""
    u, n = np.unique(codes, return_counts=True)
    if len(u) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        u, n = u[n >= least], n[n >= least]
    return u[np.argsort(-n, kind="stable")][:k]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 22):
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, codes in by.items():
            u, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n)], names=["lang", "gram", "n"])


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], k: int):
        self.k, self.langs = k, sorted(ranks)
        self.codes = np.unique(np.concatenate([np.asarray(v, dtype=np.int64) for v in ranks.values()])) if ranks else np.empty(0, dtype=np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, ranks[lang]), j] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score, _ = self.closest(text)
        return lang, score

    def closest(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share among the languages (sharpened by distance), its distance (0 where there are too few n-grams to tell)."""
        own = ranked(grams(text), self.k)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0, 1.0
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        place = self.rank[np.where(known, at, len(self.codes))]
        far = np.where(place < 0, self.k, np.abs(place - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0) / (self.k * len(own))
        best = int(np.argmin(far))
        return self.langs[best], float(1 / np.exp((far[best] - far) * SHARPNESS).sum()), float(far[best]) if len(own) >= TELLING else 0.0


def learn_profiles(labelled: DataFrame, *, k: int = PROFILE) -> Profiles:
    """(text, lang) -> profiles; counts over all rows, k n-grams a language to the driver.  Null langs are left out."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", first).where(F.col("rank") <= k).select("lang", "rank", "gram").limit(MAX_LANGUAGES * k + 1).collect()
    if len(top) > MAX_LANGUAGES * k:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; group them first")
    ranks: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r[0], r[1])):
        ranks.setdefault(r[0], []).append(r[2])
    return Profiles(ranks, k)


def _predict(model: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, *, k: int = PROFILE) -> DataFrame:
    """(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score; one row for each input row.

    Learns from the rows that are not held out.  A null text, or one without a letter, is ``und`` with
    score 0, as is everything if no row is labelled.  Repeated rows repeat (and count as often).  Equal distances go to the
    language first by name.  Long texts are read whole.  An empty table gives an empty result; other columns of any name are not read.
    """
    model = learn_profiles(docs.where(~held_out()), k=k)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, *, k: int = PROFILE, farthest: float = FARTHEST) -> DataFrame:
    """The documents, all columns, whose language could be told, with ``lang`` set to it.

    A text without letters goes, as does one of ``TELLING`` n-grams and more that is farther than ``farthest`` from every
    profile (another language or script), and everything if no row is labelled.  Otherwise as in ``identify``.
    """
    model = learn_profiles(docs.where(~held_out()), k=k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [model.closest(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            at = batch.schema.get_field_index("lang")
            told = batch.set_column(at, batch.schema.field(at), pa.array([f[0] for f in found], batch.schema.field(at).type))
            yield told.filter(pa.array([f[0] != UNKNOWN and f[2] <= farthest for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
