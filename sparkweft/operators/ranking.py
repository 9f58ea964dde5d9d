"""Candidates of a request: generated, filtered, given features, fused, explained and cut to a tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, EngineConfig
from ..functions import paths as P
from ..session import checkpointed
from . import graph as G
from . import retrieval as R

# Features of a candidate, signals that keep a row, caps of the first tier.
FEATURES = ["co_change", "bm25", "symbol", "embed", "locality", "hub_penalty", "learned_boost", "rank_score", "was_in_already_have", "dwell_seconds", "rejected"]
KEEP_SIGNALS = ["query_first", "semantic", "orchestrator", "rwr"]
TIER1_CAP, TIER1_HUB_CAP, DROP_BIAS = 12, 25, -0.3


def stage1(edges: DataFrame, seeds: DataFrame, *, expansion: str = "bfs", cap: int = 100, min_weight: float = CONFIG.min_weight, max_depth: int = CONFIG.max_depth) -> DataFrame:
    """(request_id, item_id) -> (request_id, item_id, depth, weight, signal) without the seeds, the best ``cap``.

    ``bfs``: what lies within some hops; ``rwr``: the shares of a walk with restart in thousandths, one at least.
    """
    if expansion == "rwr":
        found = G.walk_scores(edges, seeds, steps=max_depth + 4).withColumn("order", F.col("score"))
        found = found.select("request_id", "item_id", F.lit(1).alias("depth"), F.greatest(F.lit(1), F.floor(F.round(F.col("score") * 1000, 6))).cast("double").alias("weight"), "order")
    elif expansion == "bfs":
        found = G.blast_radius(edges, seeds, min_weight=min_weight, max_depth=max_depth, max_results=cap)
        found = found.select("request_id", "item_id", "depth", "weight", (-F.col("rank")).cast("double").alias("order"))
    else:
        raise ValueError(f"unknown expansion {expansion!r}")
    found = found.join(seeds.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
    best = R.ranked(found, "request_id", [F.desc(F.round("order", 9)), F.col("item_id")], cap)
    return best.select("request_id", "item_id", "depth", "weight", F.lit(expansion).alias("signal"), "rank")


def iterative(edges: DataFrame, seeds: DataFrame, *, rounds: int = 2, again: int = 25, **how) -> DataFrame:
    """Stage one in rounds: each starts from the first ``again`` additions of the one before; an item keeps its first round."""
    edges = checkpointed(edges.select("src", "dst", "weight"))  # read in every round
    pool, parts = seeds.select("request_id", "item_id"), []
    for turn in range(rounds):
        found = stage1(edges, pool, **how).withColumn("round", F.lit(turn))
        for before in parts:
            found = found.join(before.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
        found = checkpointed(found)
        parts.append(found)
        pool = R.ranked(found.drop("rank").withColumnRenamed("weight", "w"), "request_id", [F.desc("w"), F.col("item_id")], again).select("request_id", "item_id")
    return reduce(DataFrame.union, [p.select("request_id", "item_id", "depth", "weight", "signal", "round") for p in parts])


def filtered(candidates: DataFrame, files: DataFrame, have: DataFrame) -> DataFrame:
    """Candidates (request_id, path, depth, signal, ...) that exist, are no seed unless the query found them, and that the request has not yet."""
    known = candidates.join(files.select("path"), "path", "left_semi")
    kept = known.where((F.col("depth") > 0) | (F.col("signal") == "query_first"))
    return kept.join(have.select("request_id", "path"), ["request_id", "path"], "left_anti")


def merged(candidates: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions that are new to their request behind the candidates, columns as the candidates have them."""
    new = additions.join(candidates.select("request_id", "path"), ["request_id", "path"], "left_anti").dropDuplicates(["request_id", "path"])
    return candidates.unionByName(new.select(*candidates.columns))


def with_features(candidates: DataFrame, degrees: DataFrame, learned: DataFrame, scores: DataFrame, feedback: DataFrame, have: DataFrame, seeds: DataFrame, *, off: list[str] | None = None) -> DataFrame:
    """The eleven features of each candidate (request_id, path, weight, relevance), zero where nothing is known; those in ``off`` are zero for all.

    degrees (path, degree), learned (path, learned), scores (request_id, path, bm25, symbol, embed), feedback (path, dwell_seconds,
    rejected), have (request_id, path), seeds (request_id, seed paths: the nearest counts).
    """
    near = candidates.select("request_id", "path").join(seeds, "request_id").groupBy("request_id", "path").agg(F.max(P.locality(F.col("seed"), F.col("path"))).alias("locality"))
    key = ["request_id", "path"]
    rows = candidates.join(near, key, "left").join(degrees, "path", "left").join(learned, "path", "left").join(scores, key, "left").join(feedback, "path", "left")
    rows = rows.join(have.select(*key).distinct().withColumn("had", F.lit(1.0)), key, "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    value = {
        "co_change": zero("weight"), "bm25": zero("bm25"), "symbol": zero("symbol"), "embed": zero("embed"), "locality": F.round(F.coalesce("locality", F.lit(1.0)), 4),
        "hub_penalty": F.round(F.log2(2 + zero("degree")), 4), "learned_boost": F.round(zero("learned"), 4), "rank_score": F.round(zero("relevance"), 4),
        "was_in_already_have": zero("had"), "dwell_seconds": zero("dwell_seconds"), "rejected": zero("rejected"),
    }
    return rows.select(*key, *[(F.lit(0.0) if n in (off or []) else value[n]).alias(n) for n in FEATURES])


def term_hits(query: Column, path: Column) -> Column:
    """How many distinct words of the query the path holds."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""))
    low = F.lower(path)
    return F.size(F.filter(words, lambda t: F.contains(low, t))).cast("double")


def five_signals(rows: DataFrame, k: int = CONFIG.rrf_k) -> DataFrame:
    """(request_id, path, co_change, locality, term, embed, degree) -> score: reciprocal ranks of the five, degree from the low end; ties by path."""
    from . import selection as S

    low = rows.withColumn("specificity", -F.col("degree"))
    return S.rank_rrf(low, {s: True for s in ("co_change", "locality", "term", "embed", "specificity")}, k=k)


def gap_reasons(score: Column, level: Column, query_only: Column, hits: Column, files: Column, seeds: Column) -> Column:
    """Why an answer is too weak to build on, in order; empty if it is not."""
    tests = [
        ((level == "low") | (score < 0.45), "low_retrieval_confidence"), (query_only & (hits == 0), "query_first_no_hits"),
        ((seeds == 0) & (files < 2), "thin_result_set"), (hits == 0, "no_orchestrator_hits"),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))


def next_step(tier: Column, files: Column, compression: Column, truncated: Column) -> Column:
    """What to ask next: retry what was cut, a tier deeper, a smaller payload, or say what was of use; null without files."""
    plain = compression.isNull() | compression.isin("none", "")
    out = F.when(tier <= 1, "escalate_to_signatures").when(tier == 2, "escalate_to_chunks").when((tier >= 3) & plain, "shrink_payload").otherwise("mark_used_or_reject")
    return F.when(truncated, "truncated_or_timeout").when(files == 0, F.lit(None)).otherwise(out)


def pick_reason(signal: Column, weight: Column, scores: dict[str, Column], fused: Column, rank_score: Column) -> Column:
    """Why a row was picked, in one line."""
    number = lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")
    parts = [signal, F.when(F.floor(weight) > 1, F.concat(F.lit("co-change w="), F.floor(weight).cast("string")))]
    parts += [F.when(c > 0, F.concat(F.lit(f"{n}="), number(c))) for n, c in scores.items()]
    parts.append(F.when(fused.isNotNull(), F.concat(F.lit("orc="), number(fused))))
    line = F.concat_ws(" + ", *parts)
    return F.when(line == "", F.concat(F.lit("score="), number(rank_score))).otherwise(line)


def tier1_cap(high_fanout: Column) -> Column:
    return F.when(high_fanout, TIER1_HUB_CAP).otherwise(TIER1_CAP)


def learned_prune(rows: DataFrame, bias: DataFrame, *, protect: int = 10, least: int = 3, drop: float = DROP_BIAS) -> DataFrame:
    """Ranked rows (request_id, path, rank, signal, seed): later ones of a strongly negative bias (path, bias) go; seeds and search hits stay."""
    rows = rows.join(bias, "path", "left")
    keep = F.col("seed") | F.coalesce(F.col("signal").isin(KEEP_SIGNALS), F.lit(False)) | (F.coalesce("bias", F.lit(0.0)) >= drop)
    return R.summary_prune(rows, keep, protect=protect, least=least).drop("bias")


def with_policy(requests: DataFrame, policy: dict) -> DataFrame:
    """Requests (token_budget, tier, profile; null where not given) with an organisation's defaults and its cap on the budget."""
    default = lambda c, v, kind: F.coalesce(c, F.lit(v).cast(kind))
    budget = default("token_budget", policy.get("token_budget_default", 50_000), "int")
    if policy.get("max_token_budget") is not None:
        budget = F.least(budget, F.lit(policy["max_token_budget"]))
    return requests.withColumn("token_budget", budget).withColumn("tier", default("tier", policy.get("default_tier", 1), "int")).withColumn("profile", default("profile", policy.get("profile_default"), "string"))


def merged_policy(*layers: dict) -> dict:
    """Settings of several layers, the later ones first; tables merge, lists of allowed hooks add up, anything else is replaced."""

    def both(old, new, name: str):
        if isinstance(old, dict) and isinstance(new, dict):
            return {k: both(old[k], new[k], k) if k in old and k in new else new.get(k, old.get(k)) for k in old.keys() | new.keys()}
        if name in ("allowed_hook_sha256", "allowed_sha256") and isinstance(old, list) and isinstance(new, list):
            return list(dict.fromkeys([*old, *new]))
        return new

    return reduce(lambda a, b: both(a, b, ""), layers, {})


def engine_config(values: dict) -> EngineConfig:
    """Settings by name over the defaults; unknown names are refused."""
    unknown = sorted(set(values) - set(EngineConfig.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return EngineConfig(**values)
