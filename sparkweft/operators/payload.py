"""Compression of context payloads by query: bodies, chunks, summaries and signatures, with what it saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import sized_broadcast

# Words that are no query terms, lines worth keeping, what opens a comment, the mark of a cut.
STOP_WORDS = (
    "a an the and or in on at to for of is are was were be with from by as it this that how what when where why do does did can should would fix add get "
    "set use file files code function class"
).split()
KEEP_LINE = r"(?i)(?:^\s*(?:def|class|async def|import|from|raise|assert|return|except|try|if __name__)\b|(?:Error|Exception|TODO|FIXME|NotImplemented))"
COMMENT = r"""^\s*(#|//|/\*|\*|\"\"\"|''')"""
CUT = "# ... pruned (use retrieve with content_hash for full text)"
METHOD = "prune_v1"


def query_terms(query: Column) -> Column:
    """Distinct words of more than two letters that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS)))


def _held(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def line_score(line: Column, terms: Column, bias: Column) -> Column:
    """Two for each term, three for a line worth keeping, one for a comment, and what was learned of the path."""
    learned = F.when(bias > 0, F.bround(bias * 2)).when(bias < 0, -F.bround(F.abs(bias))).otherwise(0.0)
    return 2 * _held(terms, F.lower(line)) + F.when(line.rlike(KEEP_LINE), 3).otherwise(0) + F.when(line.rlike(COMMENT), 1).otherwise(0) + learned.cast("int")


def pruned_body(body: Column, terms: Column, *, aggressive: bool = False, bias: Column | None = None) -> Column:
    """A body's opening and its best lines in order, with a mark where lines went; short bodies stay.

    One expression over arrays, so that it runs in the engine and no line becomes a row.
    """
    bias = F.lit(0.0) if bias is None else bias
    lines = F.split(body, "\n")
    n = F.size(lines)
    hard = F.lit(aggressive) | (bias < -0.5)
    ratio = F.least(F.lit(0.9), F.greatest(F.lit(0.2), F.when(hard, 0.35).otherwise(0.55) + bias * 0.12))
    most = F.least(F.greatest(F.lit(4), F.floor(n * ratio).cast("int")), F.lit(30 if aggressive else 50))
    scored = F.transform(lines, lambda line, i: F.struct((-line_score(line, terms, bias)).alias("s"), i.alias("i")))
    best = F.sort_array(F.filter(scored, lambda x: x["s"] < 0))
    head = F.when(F.trim(F.get(lines, 1)) != "", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    chosen = F.concat(head, F.transform(F.slice(best, 1, most), lambda x: x["i"]))
    if aggressive:
        chosen = F.concat(chosen, F.transform(F.filter(best, lambda x: x["s"] <= -5), lambda x: x["i"]))
    chosen = F.sort_array(F.array_distinct(chosen))
    kept = F.concat(F.transform(chosen, lambda i: F.get(lines, i)), F.array(F.lit(CUT)))
    first = F.floor((25 if aggressive else 40) * (1 + F.greatest(F.lit(0.0), bias) * 0.25)).cast("int")
    plain = F.array_join(F.slice(lines, 1, first), "\n")
    out = F.when((F.size(best) == 0) & (F.size(terms) == 0), plain).when(F.size(chosen) >= n, body).otherwise(F.array_join(kept, "\n"))
    return F.when(body.isNull() | (F.trim(body) == "") | (n <= 3), body).otherwise(out)


def pruned_chunks(chunks: DataFrame, *, aggressive: bool = False) -> DataFrame:
    """(path, query, bias, position, name, body) -> the best chunks of each path, ``place`` from 1, their bodies pruned.

    Three for each term in name or body, two for a class or function; those without a score only if there is no other.
    """
    terms = query_terms(F.col("query"))
    hard = F.lit(aggressive) | (F.col("bias") < -0.5)
    text = F.lower(F.concat_ws(" ", "name", "body"))
    opens = F.contains(F.lower("name"), F.lit("class")) | F.contains(F.lower(F.substring("body", 1, 80)), F.lit("def "))
    rows = chunks.withColumn("score", 3 * _held(terms, text) + F.when(opens, 2).otherwise(0))
    w = Window.partitionBy("path", "query")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "position"))).withColumn("best", F.max("score").over(w))
    most = F.when(hard, 2).otherwise(4) + F.when(F.col("bias") > 0.5, 1).otherwise(0)
    kept = rows.where((F.col("place") <= most) & ((F.col("score") > 0) | (F.col("best") == 0)))
    soft, harsh = pruned_body(F.col("body"), terms, bias=F.col("bias")), pruned_body(F.col("body"), terms, aggressive=True, bias=F.col("bias"))
    return kept.select("path", "query", "name", "place", "score", F.when(hard, harsh).otherwise(soft).alias("body"))


def pruned_summary(summary: Column, terms: Column, *, aggressive: bool = False) -> Column:
    """The first sentence and those that hold a term; two at most if aggressive, else a mark where some went."""
    parts = F.split(F.trim(summary), r"(?<=[.!?])\s+")
    kept = F.concat(F.slice(parts, 1, 1), F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: _held(terms, F.lower(s)) > 0))
    if aggressive:
        return F.array_join(F.slice(kept, 1, 2), " ")
    return F.array_join(F.when(F.size(kept) < F.size(parts), F.concat(kept, F.array(F.lit("…")))).otherwise(kept), " ")


def pruned_signatures(signatures: Column, terms: Column, most: int = 10) -> Column:
    """The signatures with most terms, in their order where they have as many."""
    scored = F.transform(signatures, lambda s, i: F.struct((-_held(terms, F.lower(s))).alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.sort_array(scored), 1, most), lambda x: x["s"])


def json_tokens(entry: Column) -> Column:
    """Tokens of a JSON text: a quarter of its bytes."""
    return F.floor(F.octet_length(entry) / 4).cast("long")


def compressed(entries: DataFrame, *, aggressive: bool = False) -> DataFrame:
    """(request_id, path, query, content, bias) -> the entries of each request pruned, if that takes fewer tokens.

    Gives request_id, path, content, content_hash (of the payload before), tokens_before, tokens_after, saved (the ratio), applied.
    """
    terms = query_terms(F.col("query"))
    body = pruned_body(F.col("content"), terms, bias=F.col("bias"), aggressive=aggressive)
    as_json = lambda c: F.to_json(F.struct(F.col("path"), c.alias("content")))
    rows = entries.withColumn("short", body).withColumn("was", as_json(F.col("content")))
    rows = rows.withColumn("before", json_tokens(F.col("was"))).withColumn("after", json_tokens(as_json(F.col("short"))))
    per = rows.groupBy("request_id").agg(
        F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "was"))), lambda x: x["was"]), ","), 256).alias("content_hash"),
    )
    per = per.withColumn("applied", F.col("tokens_after") < F.col("tokens_before"))
    out = rows.select("request_id", "path", "content", "short").join(per, "request_id")
    saved = F.when(F.col("applied"), F.round(1 - F.col("tokens_after") / F.col("tokens_before"), 4)).otherwise(0.0)
    return out.select("request_id", "path", F.when(F.col("applied"), F.col("short")).otherwise(F.col("content")).alias("content"), "content_hash", "tokens_before", "tokens_after", saved.alias("saved"), "applied")


def stack_row(graph: Column, compressed_: Column, corpus: Column) -> dict[str, Column]:
    """What compression saves against the graph's answer and against the corpus."""
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 2)).otherwise(0.0)
    return {"savings_ratio": F.when(graph > 0, F.round(1 - compressed_ / graph, 4)).otherwise(0.0), "vs_graph": ratio(graph, compressed_), "vs_corpus": F.when(corpus > 0, ratio(corpus, compressed_)).otherwise(0.0)}


def stack_means(rows: DataFrame) -> DataFrame:
    """(graph_tokens, compressed_tokens, or legacy_tokens where that is null, vs_graph, savings_ratio) -> one row of means over the rows that were compressed."""
    tokens = F.coalesce("compressed_tokens", "legacy_tokens")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return rows.where(tokens.isNotNull()).agg(F.count("*").alias("cases"), mean("graph_tokens").alias("graph_tokens"), mean(tokens).alias("compressed_tokens"), mean("vs_graph").alias("vs_graph"), mean("savings_ratio").alias("savings_ratio"))


def token_honesty(used: Column, budget: Column) -> Column:
    """1 within the budget, less by the share it is overshot by."""
    over = F.when(budget == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - (used - budget) / budget), 4))
    return F.when(used <= budget, 1.0).otherwise(over)


def token_efficiency(used: Column, expected: Column) -> Column:
    return F.when(expected == 0, 1.0).when(used == 0, 0.0).otherwise(F.round(expected / used, 4))


def relevant_chunks(chunks: DataFrame, imports: DataFrame, *, most: int = 5) -> DataFrame:
    """(path, query, position, name, signature, body) and imported names (query, name) -> the best chunks of each path.

    Ten for each word of the query in name or body, fifteen for an imported name, three for a class; those without a
    score only if there is no other.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != ""))
    named = imports.select("query", "name").distinct().withColumn("imported", F.lit(15))
    rows = chunks.join(sized_broadcast(named), ["query", "name"], "left")
    score = 10 * _held(words, F.lower(F.concat_ws(" ", "name", "body"))) + F.coalesce("imported", F.lit(0)) + F.when(F.contains(F.lower("signature"), F.lit("class")), 3).otherwise(0)
    w = Window.partitionBy("path", "query")
    rows = rows.withColumn("score", score).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "position"))).withColumn("best", F.max("score").over(w))
    return rows.where((F.col("place") <= most) & ((F.col("score") > 0) | (F.col("best") == 0))).select("path", "query", "name", "score", "place")

