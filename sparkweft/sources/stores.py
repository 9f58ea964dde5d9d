"""Persistent tables: event logs as JSON lines, content-addressed payloads, signed snapshots."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, request_id string, path string, kind string, ts long, dwell_seconds double"
CASES = "case_id string, repo_key string, seed_files array<string>, query string, expected_top_files array<string>, tier int, token_budget int, max_depth int, min_weight int, category string"


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    events.write.mode(mode).json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are no event are skipped."""
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(folder)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    for name, value in (("tier", 1), ("token_budget", 50_000), ("max_depth", 2), ("min_weight", 2)):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    return rows


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Stream-JSON transcripts: (file, type, tools, input_tokens, output_tokens, num_turns, total_cost_usd) for each line, the tools it uses in an array."""
    schema = "type string, message struct<content:array<struct<type:string,name:string>>,usage:struct<input_tokens:long,output_tokens:long>>, num_turns int, total_cost_usd double"
    lines = spark.read.text(folder).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("r")).where("r.type is not null")
    tools = F.filter("r.message.content", lambda c: c["type"] == "tool_use")
    return lines.select("file", "r.type", F.transform(tools, lambda c: c["name"]).alias("tools"), "r.message.usage.input_tokens", "r.message.usage.output_tokens", "r.num_turns", "r.total_cost_usd")


def read_source_files(spark: SparkSession, root: str, suffixes: list[str], max_bytes: int = 1 << 20) -> DataFrame:
    """(path, text, signature) of files under a root with one of the suffixes, up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    return files.where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("signature"))


def store_payloads(payloads: DataFrame, folder: str) -> None:
    """Write-once rows (key, payload), keyed by the hash of the payload; keys that are there stay as they are."""
    spark = payloads.sparkSession
    rows = payloads.select(F.sha2(F.col("payload"), 256).alias("key"), "payload").dropDuplicates(["key"])
    try:
        old = spark.read.parquet(folder).select("key")
        old.schema
    except Exception as error:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows.write.parquet(folder)
        return
    rows.join(old, "key", "left_anti").write.mode("append").parquet(folder)


def retrieve_payloads(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    return spark.read.parquet(folder).join(keys, "key")


def export_snapshot(tables: dict[str, DataFrame], folder: str, key: bytes) -> str:
    """Writes each table and a manifest of counts and content hashes; returns the manifest's signature."""
    manifest = {}
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        manifest[name] = _summary(df.sparkSession, f"{folder}/{name}")
    return hmac.new(key, json.dumps(manifest, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def import_snapshot(spark: SparkSession, folder: str, names: list[str], key: bytes, signature: str) -> dict[str, DataFrame]:
    manifest = {n: _summary(spark, f"{folder}/{n}") for n in sorted(names)}
    if not hmac.compare_digest(signature, hmac.new(key, json.dumps(manifest, sort_keys=True).encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the snapshot is not what was signed")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def _summary(spark: SparkSession, path: str) -> list:
    df = spark.read.parquet(path)
    return list(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())
