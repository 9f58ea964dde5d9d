"""Identifier search, symbol search, retriever lists and how a search is dispatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import paths as P
from ..session import checkpointed
from . import retrieval as R
from . import scan

# Words that are no search terms, the word and split patterns of identifiers.
STOP_WORDS = (
    "the and for not but are was were been have has had does did will would could should may might shall can this that these those with from into "
    "each all any both self return true false none null undefined import export class def function var let const new end begin else elif elsif then "
    "while until string int integer float bool boolean void private public protected static require include"
).split()
SPLIT = r"[_\-./\\]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
LARGE_TOP, DEFAULT_TOP = 10, 15


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(R.TERM), F.lit(1))


def _useful(parts: Column) -> Column:
    return F.filter(F.transform(parts, F.lower), lambda p: (F.length(p) >= 3) & ~p.isin(STOP_WORDS))


def identifiers(text: Column) -> Column:
    """Search terms of a text: the useful parts of its words, and every word whole, so that a plain word counts twice."""
    words = _words(text)
    return F.concat(_useful(F.flatten(F.transform(words, lambda w: F.split(w, SPLIT)))), F.transform(words, F.lower))


def expanded(query: Column) -> Column:
    """Distinct terms of a query: its words in lower case, and their useful parts."""
    words = F.transform(_words(query), F.lower)
    return F.array_distinct(F.concat(_useful(F.flatten(F.transform(words, lambda w: F.split(w, SPLIT)))), words))


def identifier_postings(docs: DataFrame, key: str, text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf) of the identifier index, of the ``wanted`` terms only if given."""
    terms = docs.select(F.col(key).alias("doc"), identifiers(F.col(text)).alias("t"))
    if wanted is None and scan.unique_key(terms, "doc"):
        return scan.term_counts(terms).select("term", "doc", "tf")
    rows = terms.select("doc", F.explode("t").alias("term"))
    if wanted is not None:
        rows = rows.join(R.sized_broadcast(wanted.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def identifier_search(docs: DataFrame, queries: DataFrame, *, key: str = "doc_id", k: int = 20) -> DataFrame:
    """(query_id, query) -> (query_id, doc, score, rank): tf * ln(N / df) over the terms of the query, N counting documents with terms."""
    q = queries.select("query_id", F.explode(expanded(F.col("query"))).alias("term"))
    rows = docs.select(F.col(key).alias("doc"), _words(F.col("text")).alias("t"))
    if R.is_small(q) and scan.unique_key(rows, "doc"):
        # each distinct word is taken apart once
        words = rows.select(F.explode("t").alias("word")).distinct().select("word", F.explode(identifiers(F.col("word"))).alias("term"))
        words = words.join(R.sized_broadcast(q.select("term").distinct()), "term", "left_semi").groupBy("word", "term").agg(F.count("*").alias("times"))
        words = checkpointed(words)
        if R.is_small(words, 4 * CONFIG.broadcast_rows):
            return R.tfidf_of(rows, q, "filled", k, [tuple(r) for r in words.select("word", "term", "times").collect()])
    index = identifier_postings(docs, key, wanted=q)
    n = docs.agg(F.count(F.when(F.regexp_count("text", F.lit(R.TERM)) > 0, 1)).alias("n"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    part = F.col("tf") * F.log(F.col("n") / F.col("df"))
    scored = index.join(df, "term").join(R.sized_broadcast(q), "term").groupBy("query_id", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return R.ranked(scored.where("score > 0"), "query_id", [F.desc("score"), F.col("doc")], k)


def capped_tfidf(docs: DataFrame, candidates: DataFrame, queries: DataFrame, *, key: str = "path", k: int = 15) -> DataFrame:
    """The same search among the candidates (query_id, doc, place) of each query, its first 4 * k; frequencies are theirs alone."""
    near = R.ranked(candidates, "query_id", [F.col("place"), F.col("doc")], 4 * k).select("query_id", "doc")
    terms = docs.select(F.col(key).alias("doc"), identifiers(F.col("text")).alias("t")).where(F.size("t") > 0)
    q = queries.select("query_id", expanded(F.col("query")).alias("q"))
    rows = near.join(terms, "doc").join(q, "query_id")
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    tf = rows.select("query_id", "doc", F.explode(F.filter("t", lambda t: F.array_contains("q", t))).alias("term")).groupBy("query_id", "doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = F.col("tf") * F.log(F.col("n") / F.col("df"))
    scored = tf.join(df, ["query_id", "term"]).join(n, "query_id").groupBy("query_id", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return R.ranked(scored.where("score > 0"), "query_id", [F.desc("score"), F.col("doc")], k)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def symbol_bm25(symbols: DataFrame, queries: DataFrame, *, k: int = 20, k1: float = CONFIG.bm25_k1, b: float = CONFIG.bm25_b) -> DataFrame:
    """(path, symbol, kind, line) x (query_id, query) -> (query_id, path, symbol, line, score, rank).

    BM25 over the words of symbol and kind, a query term being a phrase of such words.  Queries that find nothing fall back to
    names that hold one of their first four terms: 10 for a whole name, 5 for a part, the shortest first.
    """
    phrase = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    words = F.concat(_tokens(F.col("symbol")), _tokens(F.col("kind")))
    rows = symbols.select("path", "symbol", "line", words.alias("w")).withColumn("said", phrase(F.col("w"))).withColumn("dl", F.size("w"))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    terms = queries.select("query_id", F.explode(R.query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    t = _tokens(F.col("term"))
    phrases = R.sized_broadcast(terms.select("term").distinct()).select("term", F.get(t, 0).alias("first"), phrase(t).alias("want"))
    hit = rows.select("path", "symbol", "line", "said", "dl", F.explode(F.array_distinct("w")).alias("first")).join(phrases, "first").where(F.expr("contains(said, want)"))
    tf = (F.length("said") - F.length(F.replace(F.col("said"), F.col("want"), F.lit(" ")))) / (F.length("want") - 1)
    hit = hit.select("path", "symbol", "line", "dl", "term", tf.alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("times") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    found = hit.join(df, "term").join(terms, "term").groupBy("query_id", "path", "symbol", "line").agg(F.round(F.sum(part), 6).alias("score"))
    missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    few = missed.select("query_id", F.explode(F.slice(_words(F.col("query")), 1, 4)).alias("term")).withColumn("low", F.lower("term"))
    held = R.term_runs(symbols.select(F.lower("symbol").alias("run")).where(F.length("run") >= 3).distinct(), few.select(F.col("low").alias("term")).distinct())
    held = checkpointed(held.select(F.col("term").alias("low"), "run"))
    # of a symbol that a term is part of, the first k paths will do, as they score alike
    named = symbols.withColumn("run", F.lower("symbol")).join(R.sized_broadcast(held.select("run").distinct()), "run", "left_semi")
    named = R.ranked(named.groupBy("run", "symbol", "path").agg(F.min("line").alias("line")), "symbol", [F.col("path"), F.col("line")], k).drop("rank")
    part_of = few.join(held, "low").join(named, "run")
    part_of = part_of.groupBy("query_id", "path", "symbol").agg(F.max(F.when(F.col("symbol") == F.col("term"), 10.0).otherwise(5.0)).alias("score"), F.min("line").alias("line"))
    every = found.select("query_id", "path", "symbol", "line", "score").union(part_of.select("query_id", "path", "symbol", "line", "score"))
    return R.ranked(every, "query_id", [F.desc("score"), F.length("symbol"), F.col("symbol"), F.col("path"), F.col("line")], k)


def max_merged(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, doc, score) with repeats -> the best score of each, ranked."""
    return R.ranked(rows.groupBy(*key).agg(F.max("score").alias("score")), key[0], [F.desc("score"), F.col(key[1])], k)


def without_noise(ranked: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, doc, score, rank) less the noise paths, unless a query has nothing else; ranked anew."""
    noise = P.is_noise(F.col("doc"))
    clean = F.max(~noise).over(Window.partitionBy("query_id"))
    kept = ranked.withColumn("clean", clean).where(~F.col("clean") | ~noise)
    return kept.select("query_id", "doc", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank")).where(F.col("rank") <= k)


def dispatched(queries: DataFrame, bm25: DataFrame, capped: DataFrame, full: DataFrame) -> DataFrame:
    """(query_id, prefer_bm25, large_graph) and three (query_id, doc, score, rank) lists -> (query_id, backend, bm25_empty_fallback, doc, score, rank).

    BM25 where it is preferred and finds anything, else the capped search on large graphs, else the full one.
    """
    has = bm25.select("query_id").distinct().withColumn("has", F.lit(True))
    use = queries.join(has, "query_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    backend = F.when(F.col("prefer_bm25") & F.col("has"), "bm25").when(F.col("large_graph"), "tfidf_capped").otherwise("tfidf_full")
    use = use.select("query_id", backend.alias("backend"), (F.col("prefer_bm25") & ~F.col("has")).alias("bm25_empty_fallback"))
    parts = [df.select("query_id", "doc", "score", "rank", F.lit(n).alias("backend")) for n, df in (("bm25", bm25), ("tfidf_capped", capped), ("tfidf_full", full))]
    return use.join(parts[0].union(parts[1]).union(parts[2]), ["query_id", "backend"])


def search_policy(query: Column, high_fanout: Column, large_graph: Column, query_only: Column) -> dict[str, Column]:
    """Whether content search may run, how many rows it gives, whether BM25 is preferred."""
    asked = (F.trim(query) != "") & ~high_fanout
    lone = large_graph & query_only
    return {"seed_hybrid": ~high_fanout & ~large_graph, "semantic": asked & (~large_graph | query_only), "top_n": F.when(lone, LARGE_TOP).otherwise(DEFAULT_TOP), "prefer_bm25": lone}
