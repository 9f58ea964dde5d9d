"""The operators as stages over a documents table: each takes and returns its columns (the last, the places).

All of them take nulls in any column, empty and very long texts (read whole), repeated rows, extra columns of any name
and empty tables, which stay empty; what each does with them is stated where it differs from its operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, near_dedup, reshard
from .common import Scratch, pieces, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, and their ``lang`` is the predicted one, which the later stages see.

    Without text or letters, or far from every profile, they go.  Repeated rows are decided alike, and each stays.
    """
    return language.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Texts are told apart, not ids: of different texts under one doc_id the first by hash goes by that id, the
    others, and every text without an id, by a hash of id and text above 2**62.  Null or blank texts of one such key stay once.
    """
    scratch = Scratch(spark, "near-stage")
    doc, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    ids = docs.select(doc.alias("near_doc"), text.alias("near_text")).where("near_doc is not null")
    odd = ids.groupBy("near_doc").agg(F.min("near_text").alias("near_first"), F.max("near_text").alias("near_last")).where("near_first <> near_last")
    keyed = docs.join(scratch.keep(odd).drop("near_last"), doc == F.col("near_doc"), "left")
    own = F.xxhash64(doc, text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = scratch.keep(keyed.withColumn("near_key", F.when(doc.isNull() | (text != F.col("near_first")), own).otherwise(doc)))
    kept = near_dedup.near_duplicates(keyed.select(F.col("near_key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("near_key")).distinct()
    return keyed.join(kept, "near_key", "left_semi").dropDuplicates(["near_key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go; a passage of one item is a leak already.

    Documents without words, and all of them if the benchmark is empty, stay.  Repeated rows are decided alike.
    A batch of the benchmark is searched for in what the batches before it left, which was written first, so that a
    task holds the patterns of one batch; two copies of the documents lie in scratch at most.
    """
    scratch, out, held = Scratch(spark, "decontamination"), docs, []
    for k, items in enumerate(decontaminate._batches(table(spark, sf_dir, "benchmark"), decontaminate.PATTERN_WORDS)):
        if k:
            out = scratch.keep(out)
            scratch.drop(*held)
            held = [out]
        matcher = decontaminate.Matcher(items)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not matcher.hits(decontaminate.words_of(t))[1] for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their raked probabilities; rows of one doc_id are decided alike, a null one counts as an id, those without tokens go."""
    return mixing.mixed(docs).where("mix_kept").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every document that is left."""
    return reshard.reshard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "old_shard")
