"""A stored search index: postings, lengths and signatures by path, brought up to date in bounded, resumable steps.

The folder holds ``postings`` (bucket, path, term, tf), ``files`` (bucket, path, dl, signature) and ``symbols`` (bucket, path,
symbol, kind, line), each partitioned by a hash bucket of the path, so that a path is rewritten within its bucket alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as K
from ..operators import retrieval as R
from ..operators import structure as X
from ..session import checkpointed

BUCKETS = 64
SCHEMAS = {
    "postings": "path string, term string, tf long, bucket int",
    "files": "path string, dl int, signature string, bucket int",
    "symbols": "path string, symbol string, kind string, line int, bucket int",
}


def bucket(path: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def signature(text: F.Column) -> F.Column:
    return F.md5(text.cast("binary"))


def read_index(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A part of the index; empty where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def _put(rows: DataFrame, folder: str, name: str) -> None:
    # only the buckets that are in the rows are replaced
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{name}")


def _replace(spark: SparkSession, folder: str, name: str, gone: DataFrame, new: DataFrame) -> None:
    """The buckets that hold a path of ``gone`` (path, bucket) are written anew, with the new rows of those paths."""
    cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    touched = F.broadcast(gone.select("bucket").distinct())  # BUCKETS at most
    kept = read_index(spark, folder, name).join(touched, "bucket", "left_semi").join(gone.select("path"), "path", "left_anti").select(*cols)
    out = kept.union(new.select(*cols))
    rows = checkpointed(out)  # read in full before its source is replaced
    _put(rows, folder, name)
    empty = gone.select("bucket").distinct().join(rows.select("bucket").distinct(), "bucket", "left_anti")
    for r in empty.collect():  # buckets left without rows, BUCKETS at most
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={r[0]}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def index_paths(docs: DataFrame, folder: str) -> None:
    """(path, text): these paths are indexed, in place of what the index had of them."""
    spark = docs.sparkSession
    posts = R.postings(docs, "path").select(F.col("doc").alias("path"), "term", F.col("tf").cast("long").alias("tf"), bucket(F.col("doc")).alias("bucket"))
    files = docs.select("path", F.regexp_count(F.lower("text"), F.lit(R.TERM)).cast("int").alias("dl"), signature(F.col("text")).alias("signature"), bucket(F.col("path")).alias("bucket"))
    symbols = K.symbols(docs).select("path", "symbol", "kind", "line", bucket(F.col("path")).alias("bucket"))
    gone = checkpointed(docs.select("path", bucket(F.col("path")).alias("bucket")))
    for name, rows in (("postings", posts), ("symbols", symbols), ("files", files)):  # files last: they say what is done
        _replace(spark, folder, name, gone, rows)


def delete_paths(spark: SparkSession, folder: str, paths: DataFrame) -> None:
    gone = checkpointed(paths.select("path", bucket(F.col("path")).alias("bucket")))  # may come from the index itself
    for name in SCHEMAS:
        _replace(spark, folder, name, gone, read_index(spark, folder, name).limit(0))


def clear(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    for name in names or list(SCHEMAS):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pending(docs: DataFrame, folder: str) -> DataFrame:
    """(path, text) -> paths that are new or changed since they were indexed."""
    state = read_index(docs.sparkSession, folder, "files").select("path", "signature")
    return X.changed_since(state, docs.select("path", signature(F.col("text")).alias("signature"))).select("path")


def catch_up(docs: DataFrame, folder: str, *, step: int = 100, most: int | None = None) -> dict[str, int]:
    """Indexes what is pending, ``step`` paths at a time, ``most`` in all; what a lost run had done stays done. Paths that are gone leave the index."""
    spark = docs.sparkSession
    gone = read_index(spark, folder, "files").select("path").join(docs.select("path"), "path", "left_anti")
    if gone.take(1):
        delete_paths(spark, folder, gone)
    before = pending(docs, folder).count()
    left, done = before if most is None else min(before, most), 0
    while done < left:
        part = pending(docs, folder).orderBy("path").limit(min(step, left - done))
        part = checkpointed(part)
        index_paths(docs.join(part, "path", "left_semi"), folder)
        done += part.count()
    return {"pending_before": before, "synced": done, "pending_after": before - done}


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """BM25 over the stored index: (query_id, query) -> (query_id, doc, score, rank)."""
    files = read_index(spark, folder, "files")
    posts = read_index(spark, folder, "postings").select("path", "term", "tf").join(files.select("path", "dl"), "path").withColumnRenamed("path", "doc")
    return R.bm25(posts, files.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")), queries, k=k)
