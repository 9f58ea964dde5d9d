"""Feedback events folded into signals, weights and a learned ranker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG

POSITIVE, NEGATIVE = ["cite", "accept", "mark_used"], ["reject", "view"]


def deduplicated(events: DataFrame) -> DataFrame:
    """The first event of each (request, kind, path)."""
    first = F.row_number().over(Window.partitionBy("request_id", "kind", "path").orderBy("ts", "event_id"))
    return events.withColumn("nth", first).where("nth = 1").drop("nth")


def labelled(events: DataFrame, dwell: float = CONFIG.dwell_positive) -> DataFrame:
    """Adds used: true, false, or null where the event says neither (a short dwell)."""
    k = F.col("kind")
    used = F.when(k.isin(POSITIVE) | ((k == "dwell") & (F.col("dwell_seconds") >= dwell)), True).when(k.isin(NEGATIVE), False)
    return events.withColumn("used", used)


def fold(events: DataFrame) -> DataFrame:
    rows = labelled(events).where(F.col("used").isNotNull())
    return rows.groupBy("path").agg(F.sum(F.col("used").cast("int")).alias("used"), F.count("*").alias("total"))


def rate(used: Column, total: Column) -> Column:
    return F.least(F.greatest(used / F.greatest(total, F.lit(1)), F.lit(0.01)), F.lit(0.99))


def learned_weights(folded: DataFrame) -> DataFrame:
    r = rate(F.col("used"), F.col("total"))
    return folded.select("path", F.round(F.log(r / (1 - r)), 6).alias("weight"))


def prune_bias(folded: DataFrame, least: float = 0.05) -> DataFrame:
    bias = F.least(F.greatest((F.col("used") / F.greatest("total", F.lit(1)) - 0.5) * 2, F.lit(-1.0)), F.lit(1.0))
    return folded.select("path", F.round(bias, 4).alias("bias")).where(F.abs("bias") >= least)


def path_signals(events: DataFrame) -> DataFrame:
    dwell = F.max(F.when(F.col("kind") == "dwell", F.col("dwell_seconds")))
    return events.groupBy("path").agg(F.coalesce(dwell, F.lit(0.0)).alias("dwell"), F.max((F.col("kind") == "reject").cast("int")).alias("rejected"))


def reject_counts(events: DataFrame, now: int, days: int = 7, least: int = 3) -> DataFrame:
    recent = events.where((F.col("kind") == "reject") & (F.col("ts") >= now - days * 86400))
    return recent.groupBy("path").agg(F.count("*").alias("rejects")).where(F.col("rejects") >= least)


def training_pairs(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(request_id, path, features) with a label: positive wins over negative, unlabelled go."""
    y = labelled(events).where(F.col("used").isNotNull()).groupBy("request_id", "path").agg(F.max(F.col("used").cast("int")).alias("label"))
    return candidates.join(y, ["request_id", "path"])


def sgd_ranker(samples: DataFrame, features: list[str], *, epochs: int = 120, rate_: float = 0.05, order: list[str] = ("request_id", "path")) -> DataFrame:
    """Logistic regression by stochastic gradient in sample order, one model a group (column ``model``).

    A model's samples meet in one task, as the order of its steps is part of the result: for groups of
    bounded size; ``ml_ranker`` is the way for any size.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(order))
        x, y = g[features].to_numpy(float), g["label"].to_numpy(float)
        w, b = np.zeros(len(features)), 0.0
        for _ in range(epochs if len(g) >= 4 else 0):
            for xi, yi in zip(x, y, strict=True):
                err = yi - 1 / (1 + np.exp(-np.clip(xi @ w + b, -30, 30)))
                w += rate_ * err * xi
                b += rate_ * err
        return pd.DataFrame({"model": g["model"].iloc[:1], "bias": [b], "weights": [w.tolist()], "n": [len(g)]})

    return samples.groupBy("model").applyInPandas(fit, "model string, bias double, weights array<double>, n long")


def ml_ranker(samples: DataFrame, features: list[str]):
    """The same model fitted by distributed L-BFGS."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="x").transform(samples)
    return LogisticRegression(featuresCol="x", labelCol="label", maxIter=50).fit(rows)


def blend(base: Column, model: Column, n_events: Column) -> Column:
    """Learned scores weigh in as events accumulate, up to three quarters."""
    alpha = F.least(F.lit(0.75), n_events / (n_events + 40))
    return alpha * 10 * model + (1 - alpha) * base


def session_memory(events: DataFrame, keep: int = 100) -> DataFrame:
    """The last ``keep`` distinct paths of each request, by when they were first seen."""
    first = events.groupBy("request_id", "path").agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    back = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("seen")))
    return first.withColumn("back", back).where(F.col("back") <= keep).select("request_id", "path", "back")
