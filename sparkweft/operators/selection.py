"""Rank-phase fusion, boosts, snippets, signatures, plans of retrieval, and savings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..session import sorted_side
from . import retrieval as R

#: Weights of the retrievers by the shape of a query.
PLANS = {
    "default": {"path": 1.0, "symbol": 1.2, "bm25": 1.5, "embed": 0.6, "co_change": 1.0},
    "seed_only": {"path": 0.5, "symbol": 0.5, "bm25": 0.5, "embed": 0.3, "co_change": 2.0},
    "symbol_like": {"path": 0.6, "symbol": 2.5, "bm25": 1.0, "embed": 0.4, "co_change": 0.8},
    "concept": {"path": 0.8, "symbol": 1.0, "bm25": 2.0, "embed": 1.0, "co_change": 0.5},
}


def rank_rrf(rows: DataFrame, signals: dict[str, bool], by: str = "request_id", tie: str = "path", k: int = CONFIG.rrf_k) -> DataFrame:
    """Fuses per-row signals (name -> higher is better) into one score of reciprocal ranks."""
    parts = []
    for name, high in signals.items():
        order = F.desc(name) if high else F.asc(name)
        parts.append(1 / (k + F.row_number().over(Window.partitionBy(by).orderBy(order, tie))))
    return rows.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 9))


def community_boost(rows: DataFrame, membership: DataFrame, seeds: DataFrame, boost: float = 3.0) -> DataFrame:
    """Adds a boost to candidates in the community of any seed of their request."""
    home = seeds.join(membership, "item_id").select("request_id", "component").distinct().withColumn("near", F.lit(True))
    return rows.join(sorted_side(membership), "item_id", "left").join(home, ["request_id", "component"], "left").withColumn("boost", F.when(F.col("near"), boost).otherwise(0.0)).drop("near", "component")


def snippets(docs: DataFrame, queries: DataFrame, *, lines: int = 4, most: int = 480, terms: int = 6) -> DataFrame:
    """For (query_id, doc_id, query): the lines from the one with most query terms on; the first of equals wins."""
    rows = queries.join(docs.select("doc_id", F.split("text", "\n").alias("l")), "doc_id")
    want = F.slice(F.array_distinct(R.query_terms(F.col("query"))), 1, terms)
    each = rows.select("query_id", "doc_id", "l", want.alias("t"), F.posexplode("l").alias("pos", "line"))
    hits = F.size(F.filter("t", lambda t: F.contains(F.lower("line"), t)))
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("hits"), "pos"))
    best = each.withColumn("hits", hits).withColumn("nth", first).where("nth = 1")
    return best.select("query_id", "doc_id", "hits", F.substring(F.array_join(F.slice("l", F.col("pos") + 1, lines), "\n"), 1, most).alias("snippet"))


def spec_title(text: Column, fallback: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^#+\s*(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def collapsed_signatures(rows: DataFrame, per_name: int = 2, cap: int = 20) -> DataFrame:
    """(path, name, line, signature): equal signatures once, at most ``per_name`` of a name (the rest counted), ``cap`` a path."""
    once = rows.groupBy("path", "name", "signature").agg(F.min("line").alias("line"))
    w = Window.partitionBy("path", "name")
    kept = once.withColumn("nth", F.row_number().over(w.orderBy("line", "signature"))).withColumn("more", F.count("*").over(w) - per_name)
    kept = kept.where(F.col("nth") <= per_name).withColumn("more", F.when((F.col("nth") == per_name) & (F.col("more") > 0), F.col("more")).otherwise(0))
    top = F.row_number().over(Window.partitionBy("path").orderBy("line", "signature"))
    return kept.withColumn("place", top).where(F.col("place") <= cap).select("path", "name", "line", "signature", "more")


def hash_embeddings(docs: DataFrame, key: str, text: str, dims: int = 32) -> DataFrame:
    """(key, embedding): a deterministic unit vector from the bytes of each text's SHA-256."""
    rows = docs.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("h"))
    byte = lambda i: F.conv(F.substr("h", (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), byte)
    # lambda variables hold the vector and its norm, so that neither is computed again for each element
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    scaled = lambda v: F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda e: e / F.when(n == 0, 1.0).otherwise(n))), 0)
    return rows.select(key, F.get(F.transform(F.array(raw), scaled), 0).alias("embedding"))


def query_first(lists: dict[str, DataFrame], shape: DataFrame, limit: int = 30, k: int = CONFIG.rrf_k) -> DataFrame:
    """Fuses named (query_id, doc, rank) lists under the plan of each query's shape (query_id, plan)."""
    table = F.create_map(*[x for p, ws in PLANS.items() for s, w in ws.items() for x in (F.lit(f"{p}/{s}"), F.lit(w))])
    rows = reduce(DataFrame.union, [df.select("query_id", "doc", "rank", F.lit(name).alias("source")) for name, df in lists.items()])
    rows = rows.join(shape, "query_id").withColumn("s", F.try_element_at(table, F.concat_ws("/", "plan", "source")) / (k + F.col("rank")))
    fused = rows.groupBy("query_id", "doc").agg(F.round(F.sum("s"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("reason"))
    return R.ranked(fused, "query_id", [F.desc("score"), F.col("doc")], limit)


def ablation(cases: dict[str, DataFrame], full: DataFrame, metric: str = "recall") -> DataFrame:
    """Mean loss of a metric when each signal is left out."""
    base = full.agg(F.avg(metric).alias("full"))
    parts = [df.agg(F.avg(metric).alias("without")).crossJoin(base).select(F.lit(name).alias("signal"), F.round("without", 6).alias("without"), F.round(F.col("full") - F.col("without"), 6).alias("loss")) for name, df in cases.items()]
    return reduce(DataFrame.union, parts)


def path_hits(paths: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, path) x (query_id, query): paths by how many of the query's terms they hold.

    Queries of one text are one search, and of the paths that hold the same wanted terms, which score alike, only the first k are compared.
    """

    def search(texts: DataFrame) -> DataFrame:
        terms = F.array_distinct(F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))
        q = texts.select("query_id", F.explode(F.array_distinct(R.query_terms(F.col("query")))).alias("term"))
        index = paths.select(F.col("item_id").alias("doc"), "path", F.explode(terms).alias("term"))
        index = index.join(R.sized_broadcast(q.select("term").distinct()), "term", "left_semi")
        held = index.groupBy("doc", "path").agg(F.sort_array(F.collect_set("term")).alias("held"))
        first = R.ranked(held, "held", [F.col("path"), F.col("doc")], k)
        hit = first.select("doc", "path", F.explode("held").alias("term")).join(q, "term").groupBy("query_id", "doc", "path").agg(F.count("*").alias("score"))
        return R.ranked(hit, "query_id", [F.desc("score"), F.col("path")], k)

    return R.by_text(queries, search)


def savings(subset: Column, full: Column) -> Column:
    return F.round(F.when(full > 0, 100.0 * (full - subset) / full).otherwise(0.0), 1)
