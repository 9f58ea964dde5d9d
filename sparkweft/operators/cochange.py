"""Weighted co-occurrence: pairs within baskets, their upkeep, and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..session import dealt, sorted_side
from .retrieval import is_small

NOISY = r"(?i)^(merge|bump|format|lint|rubocop|prettier|reformat|chore\(deps\))"


def basket_weight(n: F.Column, subject: F.Column, noisy: float = CONFIG.noisy_factor, floor: float = CONFIG.weight_floor) -> F.Column:
    """What one basket of n items adds to each of its pairs."""
    return F.greatest(1 / F.log(n + 1) * F.when(F.trim(subject).rlike(NOISY), noisy).otherwise(1.0), F.lit(floor))


#: Weights add up in whole units of 1 / UNIT, so that no sum depends on the order of its rows.
UNIT = 1e12


def units(weight: F.Column, unit: float = UNIT) -> F.Column:
    return F.round(weight * F.lit(unit)).cast("long")


def cochange_edges(baskets: DataFrame, basket_items: DataFrame, max_basket: int = CONFIG.max_basket, *, size: int = 0) -> DataFrame:
    """(basket_id, ts, subject), (basket_id, item_id) -> edges (src < dst, weight, last_seen, n).

    The items of a basket (at most ``max_basket``, repeats counting once) meet in one array, so pairing needs no self-join: one
    shuffle gathers baskets, one adds up pairs.  With ``size``, about how many basket items there are, no task has more of
    them as the input grows.
    """
    grouped = dealt(basket_items, size, "basket_id").groupBy("basket_id").agg(F.sort_array(F.collect_set("item_id")).alias("files"))
    grouped = grouped.where(F.size("files").between(2, max_basket)).join(sorted_side(baskets), "basket_id")
    w = basket_weight(F.size("files"), F.col("subject"))
    pairs = F.expr(
        "flatten(transform(sequence(1, size(files) - 1), i -> transform(slice(files, i + 1, size(files)), b -> struct(files[i - 1] as src, b as dst))))"
    )
    rows = grouped.select("ts", units(w).alias("w"), F.explode(pairs).alias("p")).select("p.src", "p.dst", "w", "ts")
    return dealt(rows, 2 * size, "src", "dst").groupBy("src", "dst").agg((F.sum("w") / F.lit(UNIT)).alias("weight"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def top_neighbours(edges: DataFrame, k: int = CONFIG.top_k) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return symmetric(edges.where("weight > 0")).withColumn("rank", best).where(F.col("rank") <= k)


def merge_edges(old: DataFrame, new: DataFrame, *, size: int = 0) -> DataFrame:
    """Upsert: weights add up, the last time seen is the later one; ``size`` as in cochange_edges."""
    cols = ["src", "dst", "weight", "last_seen"]
    both = old.select(*cols).union(new.select(*cols))
    return dealt(both, 2 * size, "src", "dst").groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight"), F.max(F.coalesce("last_seen", F.lit(0))).alias("last_seen"))


def decayed(edges: DataFrame, now: int | F.Column, days: float = CONFIG.time_constant_days, prune: float = CONFIG.prune_below) -> DataFrame:
    """Weights times exp(-age / days); those that fall under ``prune`` go.  A function of the base weight, so it does not compound."""
    now = F.lit(now) if isinstance(now, int) else now
    age = F.greatest(F.lit(0.0), (now - F.coalesce("last_seen", now)) / F.lit(86400.0))
    return edges.withColumn("weight", F.col("weight") * F.exp(-age / F.lit(days))).where(F.col("weight") >= prune)


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("item_id")).agg(F.count("*").alias("degree"), (F.sum(units(F.col("weight"), 1e9)) / F.lit(1e9)).alias("total_weight"))


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    rounded = degrees(edges).withColumn("total_weight", F.round("total_weight", 6))
    return rounded.orderBy(F.desc("total_weight"), "item_id").limit(n)


def lower_percentile(rows: DataFrame, column: str, p: float) -> DataFrame:
    """The value at index int(p * (n - 1)) of the sorted column, from its histogram rather than from all values in one place."""
    hist = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    cum = hist.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    total = hist.agg(F.sum("c").alias("n"))
    hit = cum.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)))
    return hit.agg(F.min("v").alias("value"))


def graph_stats(items: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    counts = items.agg(F.count("*").alias("items")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return counts.crossJoin(lower_percentile(d, "degree", 0.95).withColumnRenamed("value", "p95_degree")).crossJoin(d.agg(F.max("degree").alias("max_degree")))


def neighbours(edges: DataFrame, seeds: DataFrame, min_weight: float = CONFIG.min_weight) -> DataFrame:
    """(request_id, item_id) seeds -> (request_id, seed, item_id, weight); few seeds go out to the edges, never the edges to the seeds."""
    seeds = seeds.withColumnRenamed("item_id", "src")
    seeds = F.broadcast(seeds) if is_small(seeds) else sorted_side(seeds)
    return symmetric(edges).where(F.col("weight") >= min_weight).join(seeds, "src").select("request_id", F.col("src").alias("seed"), F.col("dst").alias("item_id"), "weight")


def coverage(items: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Share of items that occur in any edge: the larger of structural and co-change endpoints."""
    ends = lambda df: df.select("src").union(df.select("dst")).distinct().agg(F.count("*").alias("c"))
    a, b = ends(edges).withColumnRenamed("c", "cochange"), ends(links).withColumnRenamed("c", "structural")
    out = items.agg(F.count("*").alias("items")).crossJoin(a).crossJoin(b)
    most = F.greatest("cochange", "structural")
    return out.select("items", "cochange", "structural", F.round(100.0 * F.least(most, F.col("items")) / F.greatest("items", F.lit(1)), 1).alias("pct"))
