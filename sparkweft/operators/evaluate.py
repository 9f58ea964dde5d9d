"""Retrieval metrics, rollups, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(ranked: DataFrame, expected: DataFrame, k_recall: int = 5, k_ndcg: int = 10) -> DataFrame:
    """ranked (case_id, doc, rank) x expected (case_id, doc, position from 1) -> recall, mrr, ndcg of each case.

    Gains fall linearly with the expected position; the ideal is the expected order itself.  A case that
    expects nothing has recall 1.
    """
    n = expected.groupBy("case_id").agg(F.count("*").alias("n"))
    hits = expected.join(ranked, ["case_id", "doc"])
    gain = (F.col("n") - F.col("position") + 1) / F.log2(F.col("rank") + 1)
    got = hits.join(n, "case_id").groupBy("case_id").agg(
        F.sum(F.when(F.col("rank") <= k_recall, 1).otherwise(0)).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k_ndcg, gain).otherwise(0.0)).alias("dcg")
    )
    ideal = expected.join(n, "case_id").where(F.col("position") <= k_ndcg).groupBy("case_id").agg(F.sum((F.col("n") - F.col("position") + 1) / F.log2(F.col("position") + 1)).alias("ideal"))
    out = n.join(got, "case_id", "left").join(ideal, "case_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "case_id",
        F.round(F.coalesce(F.col("found") / F.col("n"), zero), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("ideal"), zero), 6).alias("ndcg"),
    )


def rollup(cases: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Means of each category and of all (category null)."""
    return cases.rollup(category).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def calibration(rows: DataFrame, confidence: str, outcome: str) -> DataFrame:
    r = F.corr(confidence, outcome)
    return rows.agg(F.round(F.when(F.isnan(r), 0.0).otherwise(F.coalesce(r, F.lit(0.0))), 6).alias("pearson"), F.round(F.avg(F.abs(F.col(confidence) - F.col(outcome))), 6).alias("mae"), F.count("*").alias("n"))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.max(value).alias("max"))


def ab_medians(rows: DataFrame, arm: str, metrics: list[str], base: str, new: str) -> DataFrame:
    """Medians of both arms and the reduction in per cent, one row for each metric."""
    stacked = rows.select(arm, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select(arm, "s.*")
    wide = stacked.groupBy("metric").agg(F.median(F.when(F.col(arm) == base, F.col("v"))).alias("base"), F.median(F.when(F.col(arm) == new, F.col("v"))).alias("new"))
    return wide.select("metric", "base", "new", F.round(F.when(F.col("base") != 0, 100 * (F.col("base") - F.col("new")) / F.col("base")).otherwise(0.0), 2).alias("reduction_pct"))


def compare_shared(baseline: DataFrame, current: DataFrame, metric: str, slack: float = 0.02) -> DataFrame:
    """Means over the cases both have, and whether the current one holds up."""
    both = baseline.select("case_id", F.col(metric).alias("b")).join(current.select("case_id", F.col(metric).alias("c")), "case_id")
    return both.agg(F.count("*").alias("shared"), F.round(F.avg("b"), 6).alias("baseline"), F.round(F.avg("c"), 6).alias("current")).withColumn("passed", F.col("current") >= F.col("baseline") - slack)


def histogram_points(rows: DataFrame, value: str, by: str, last: int = 2048) -> DataFrame:
    """p50, p95, p99 at index int((n - 1) * p) of the last samples of each series."""
    recent = rows.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("back") <= last)
    got = recent.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda p: F.get("v", F.floor((F.size("v") - 1) * p).cast("int"))
    return got.select(by, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
