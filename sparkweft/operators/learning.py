"""Rankers by request, their choice, and learning that is kept only if it helps on cases held out."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from . import feedback as B
from . import retrieval as R


class Ranker(Protocol):
    """Anything that turns feature columns into a score column."""

    def score(self, features: list[str]) -> Column: ...


@dataclass
class Linear:
    """The logistic ranker: a bias and a weight a feature; its score is linear."""

    bias: float
    weights: dict[str, float]

    def score(self, features: list[str]) -> Column:
        out = F.lit(self.bias)
        for f in features:
            out = out + F.lit(self.weights.get(f, 0.0)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return out

    def to_json(self) -> str:
        return json.dumps({"model": "logistic_v1", "bias": self.bias, "weights": self.weights}, sort_keys=True)


@dataclass
class Trees:
    """Boosted regression trees as nested (feature, threshold, left, right) or a leaf's value."""

    trees: list
    rate: float

    def score(self, features: list[str]) -> Column:
        def column(node) -> Column:
            if not isinstance(node, (list, tuple)):
                return F.lit(float(node))
            f, cut, left, right = node
            return F.when(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) <= F.lit(cut), column(left)).otherwise(column(right))

        out = F.lit(0.0)
        for t in self.trees:
            out = out + F.lit(self.rate) * column(t)
        return out

    def to_json(self) -> str:
        return json.dumps({"model": "lambdamart_v1", "rate": self.rate, "trees": self.trees})


def from_json(text: str) -> Linear | Trees:
    d = json.loads(text)
    return Trees(d["trees"], d["rate"]) if d["model"] == "lambdamart_v1" else Linear(d["bias"], d["weights"])


def save_ranker(spark, ranker: Linear | Trees, folder: str) -> None:
    spark.createDataFrame([(ranker.to_json(),)], "model string").coalesce(1).write.mode("overwrite").json(folder)


def load_ranker(spark, folder: str) -> Linear | Trees:
    return from_json(spark.read.schema("model string").json(folder).first()[0])


def _histograms(rows: DataFrame, cuts: dict[str, list[float]]) -> pd.DataFrame:
    """Sums of gradient and weight by node, feature and bin: as many rows as nodes, features and bins, added up before they move."""
    def above(f: str):
        return lambda c: c < F.col(f)

    bins = [F.struct(F.lit(f).alias("f"), F.size(F.filter(F.array(*[F.lit(c) for c in cs]), above(f))).alias("b")) for f, cs in cuts.items() if cs]
    each = rows.select("node", "g", "h", F.explode(F.array(*bins)).alias("x"))
    return each.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).toPandas()


def train_lambdamart(samples: DataFrame, features: list[str], *, trees: int = 64, leaves: int = 12, rate: float = 0.08, bins: int = 16, least: int = 2, l2: float = 1e-3) -> Trees | None:
    """(request_id, path, label, features) -> boosted trees on the pairwise gradients of nDCG, or None below two requests and six rows.

    Each round ranks the rows of a request by score, weighs each pair of unlike labels by what swapping them changes
    in nDCG, and grows a tree level by level from histograms that come to the driver; rows never do.  A request's
    candidates are bounded by its candidate cap, so its pairs are, too.
    """
    counted = samples.groupBy("request_id").count()
    if counted.limit(2).count() < 2 or samples.limit(6).count() < 6:
        return None
    from ..session import checkpointed

    base = checkpointed(samples.select("request_id", "path", F.col("label").cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]))
    points = base.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 1000).alias(f) for f in features]).first()
    low = base.agg(*[F.max(f).alias(f) for f in features]).first()
    cuts = {f: sorted({float(c) for c in points[f] if c < low[f]}) for f in features}
    if not any(cuts.values()):
        return Trees([], rate)
    grown: list = []
    score = F.lit(0.0)
    now = base.withColumn("s", score)
    for t in range(trees):
        order = Window.partitionBy("request_id").orderBy(F.desc("s"), "path")
        ranked = now.withColumn("disc", 1 / F.log2(F.row_number().over(order) + 1))
        a = ranked.where("label > 0").select("request_id", F.col("path").alias("pa"), F.col("s").alias("sa"), F.col("disc").alias("da"))
        b = ranked.where("label = 0").select("request_id", F.col("path").alias("pb"), F.col("s").alias("sb"), F.col("disc").alias("db"))
        pairs = a.join(b, "request_id").withColumn("r", 1 / (1 + F.exp(F.col("sa") - F.col("sb"))))
        pairs = pairs.withColumn("w", F.abs(F.col("da") - F.col("db"))).select("request_id", "pa", "pb", (F.col("r") * F.col("w")).alias("g"), (F.col("r") * (1 - F.col("r")) * F.col("w")).alias("h"))
        force = pairs.select("request_id", F.col("pa").alias("path"), "g", "h").union(pairs.select("request_id", F.col("pb").alias("path"), -F.col("g"), "h"))
        force = force.groupBy("request_id", "path").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        rows = checkpointed(now.join(force, ["request_id", "path"], "left").fillna(0.0, ["g", "h"]).withColumn("node", F.lit(0)))
        tree = _grow(rows, cuts, leaves, least, l2)
        if tree is None:
            break
        grown.append(tree)
        now = checkpointed(now.withColumn("s", F.col("s") + Trees([tree], rate).score(features)))
    return Trees(grown, rate)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], leaves: int, least: int, l2: float):
    """A tree by levels from histograms; the best splits first until there are as many leaves as wanted."""
    nodes: dict[int, list] = {}
    hist = _histograms(rows, cuts)
    open_, count, nxt = [0], 1, 1
    values: dict[int, float] = {}
    while open_:
        found = []
        for node in open_:
            h = hist[hist["node"] == node]
            if h.empty:
                values[node] = 0.0
                continue
            one = h[h["f"] == h["f"].iloc[0]]
            g, w, n = one["g"].sum(), one["h"].sum(), one["n"].sum()
            values[node] = float(g / (w + l2))
            for f, part in h.groupby("f"):
                part = part.sort_values("b")
                gl, wl, nl = part["g"].cumsum().to_numpy(), part["h"].cumsum().to_numpy(), part["n"].cumsum().to_numpy()
                at = part["b"].to_numpy()
                for i in range(len(at) - 1):
                    if min(nl[i], n - nl[i]) >= least:
                        gain = gl[i] ** 2 / (wl[i] + l2) + (g - gl[i]) ** 2 / (w - wl[i] + l2) - g * g / (w + l2)
                        found.append((-round(float(gain), 12), node, f, cuts[f][int(at[i])]))
        best, open_ = {}, []
        for gain, node, f, cut in sorted(found):
            if gain < -1e-9 and node not in best and count < leaves:
                best[node] = (f, cut)
                count += 1
        if not best:
            break
        step = F.col("node")
        for node, (f, cut) in best.items():
            nodes[node] = [f, cut, nxt, nxt + 1]
            step = F.when(F.col("node") == node, F.when(F.col(f) <= F.lit(cut), nxt).otherwise(nxt + 1)).otherwise(step)
            open_ += [nxt, nxt + 1]
            nxt += 2
        rows = rows.withColumn("node", step)
        hist = _histograms(rows.where(F.col("node").isin(open_)), cuts)

    def tree(node: int):
        if node in nodes:
            f, cut, left, right = nodes[node]
            return [f, cut, tree(left), tree(right)]
        return values.get(node, 0.0)

    return tree(0) if nodes else None


def train_logistic(samples: DataFrame, features: list[str], **how) -> Linear | None:
    """The logistic ranker over all samples, by distributed L-BFGS; None where there is one label only."""
    if samples.select("label").distinct().count() < 2:
        return None
    model = B.ml_ranker(samples.withColumn("label", F.col("label").cast("double")).fillna(0.0, features), features)
    return Linear(float(model.intercept), {f: float(w) for f, w in zip(features, np.asarray(model.coefficients), strict=True)})


def train_best(samples: DataFrame, features: list[str], *, prefer: str = "auto", **how) -> Linear | Trees | None:
    """Boosted trees where there are enough requests, else the logistic ranker; ``prefer`` names one of them."""
    if prefer in ("auto", "lambdamart"):
        trees = train_lambdamart(samples, features, **how)
        if trees is not None or prefer == "lambdamart":
            return trees
    return train_logistic(samples, features)


def ranked_by(ranker: Ranker, rows: DataFrame, features: list[str]) -> DataFrame:
    """(request_id, path, features) -> (request_id, path, score, rank), ties by path."""
    scored = rows.select("request_id", "path", F.round(ranker.score(features), 9).alias("score"))
    return R.ranked(scored, "request_id", [F.desc("score"), F.col("path")], 1 << 30)


def mean_mrr(ranked: DataFrame, expected: DataFrame) -> float:
    """ranked (request_id, path, rank) against expected (request_id, path): the mean reciprocal rank of the first hit."""
    first = expected.join(ranked, ["request_id", "path"], "left").groupBy("request_id").agg(F.min("rank").alias("first"))
    return float(first.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).first()[0] or 0.0)


def split_cases(cases: DataFrame, held: str = "concept") -> DataFrame:
    """(case_id, category, seeds) with held_out: cases of the held category without seeds, or the first fifth if either side would be empty."""
    own = (F.col("category") == held) & (F.col("seeds") == 0)
    n = cases.agg(F.count("*").alias("n"), F.sum(own.cast("int")).alias("h"))
    nth = F.row_number().over(Window.orderBy("case_id"))
    rows = cases.withColumn("nth", nth).crossJoin(F.broadcast(n))  # one row; cases are an evaluation set
    usual = (F.col("h") > 0) & (F.col("h") < F.col("n"))
    return rows.select(*cases.columns, F.when(usual, own).otherwise(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).alias("held_out"))


def synthesized(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Events as a user would leave them: an accept for each expected path, a reject for every other that was shown."""
    hit = expected.select("request_id", "path").distinct().withColumn("hit", F.lit(True))
    rows = ranked.select("request_id", "path").join(hit, ["request_id", "path"], "left")
    return rows.select("request_id", "path", F.when(F.col("hit"), "accept").otherwise("reject").alias("kind"))


def replay(rows: DataFrame, expected: DataFrame, held: DataFrame, features: list[str], base: str, *, least: float = 0.03, prefer: str = "auto", **how) -> dict:
    """Learns from synthesized feedback on the cases that are not held out and compares the held-out MRR with that of the base score.

    rows (request_id, path, features), expected (request_id, path), held (request_id).  The learned ranker is to be saved if it is
    no worse there, and passes if it is better by ``least``.
    """
    from ..session import checkpointed

    rows = checkpointed(rows.drop("label"))  # read several times below
    out = rows.join(held, "request_id", "left_semi")
    train = rows.join(held, "request_id", "left_anti")
    first = R.ranked(out.select("request_id", "path", F.col(base).alias("score")), "request_id", [F.desc("score"), F.col("path")], 1 << 30)
    want = expected.join(held, "request_id", "left_semi")
    before = mean_mrr(first, want)
    events = synthesized(train, expected).withColumn("label", (F.col("kind") == "accept").cast("double"))
    model = train_best(train.join(events.select("request_id", "path", "label"), ["request_id", "path"]), features, prefer=prefer, **how)
    after = before if model is None else mean_mrr(ranked_by(model, out, features), want)
    return {"baseline_mrr": round(before, 6), "after_mrr": round(after, 6), "delta": round(after - before, 6), "saved": model is not None and after >= before, "passed": after - before >= least, "ranker": model}


def apply_learn(events: DataFrame, rows: DataFrame, expected: DataFrame | None, held: DataFrame | None, features: list[str], base: str, **how) -> dict:
    """Folds events into weights and biases and fits a ranker on labelled rows; with held-out cases the ranker is kept only if their MRR does not fall."""
    folded = B.fold(B.deduplicated(events))
    out = {"weights": B.learned_weights(folded), "prune": B.prune_bias(folded), "ranker": None}
    samples = B.training_pairs(rows, events)
    model = train_best(samples, features, **how)
    if model is None or held is None or expected is None:
        return out | {"ranker": model}
    mine = rows.join(held, "request_id", "left_semi")
    first = R.ranked(mine.select("request_id", "path", F.col(base).alias("score")), "request_id", [F.desc("score"), F.col("path")], 1 << 30)
    want = expected.join(held, "request_id", "left_semi")
    return out | {"ranker": model if mean_mrr(ranked_by(model, mine, features), want) >= mean_mrr(first, want) else None}


def pool_recall(pool: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, doc) candidates against (case_id, doc) expected -> (case_id, recall)."""
    hit = expected.select("case_id", "doc").distinct().join(pool.select("case_id", "doc").distinct().withColumn("hit", F.lit(1)), ["case_id", "doc"], "left")
    return hit.groupBy("case_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def payload_honesty(entries: DataFrame, reported: DataFrame) -> DataFrame:
    """(case_id, tokens_actual) entries and (case_id, tokens_used) -> (case_id, honest): 1 where they add up, or where no entry is counted."""
    per = entries.groupBy("case_id").agg(F.sum(F.coalesce("tokens_actual", F.lit(0))).alias("sum"), F.count("tokens_actual").alias("counted"))
    ok = F.when(F.col("sum").isNull(), F.col("tokens_used") == 0).when(F.col("counted") == 0, True).otherwise(F.col("sum") == F.col("tokens_used"))
    return reported.join(per, "case_id", "left").select("case_id", F.when(ok, 1.0).otherwise(0.0).alias("honest"))


def counterfactual_gate(rows: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(case_id, recall, tokens, base_recall, base_tokens) -> one row: it fails only where the baseline has better recall for fewer tokens."""
    compared = F.col("base_tokens") > 0
    lost = compared & (F.col("base_recall") > F.col("recall") + eps) & (F.col("tokens") > F.col("base_tokens"))
    ratio = F.when(compared & (F.col("tokens") > 0), F.round(F.col("base_tokens") / F.col("tokens"), 2))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    out = rows.agg(n(compared).alias("compared"), n(~compared).alias("skipped"), n(lost).alias("failures"), F.round(F.coalesce(F.median(F.when(ratio > 0, ratio)), F.lit(0.0)), 2).alias("median_reduction"))
    return out.withColumn("passed", F.col("failures") == 0)


def lift_gate(rows: DataFrame, category: str, metric: str, floor: float, lift: float) -> DataFrame:
    """One row: whether the mean of a metric over a category is above a floor by some lift."""
    out = rows.where(F.col("category") == category).agg(F.count("*").alias("cases"), F.round(F.avg(metric), 6).alias("mean"))
    return out.withColumn("passed", F.coalesce(F.col("mean") >= floor + lift, F.lit(False)))


def compression_gate(rows: DataFrame, *, least: float = 0.0, loss: float = 0.02) -> DataFrame:
    """(recall, recall_after, savings_ratio) -> one row: savings of some size at a recall that holds up."""
    out = rows.agg(F.count("*").alias("cases"), F.round(F.avg("savings_ratio"), 6).alias("savings"), F.round(F.avg("recall") - F.avg("recall_after"), 6).alias("loss"))
    return out.withColumn("passed", (F.col("savings") >= least) & (F.col("loss") <= loss))


def merged_results(old: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """Result rows by key, the latest of each."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when)))
    return old.unionByName(new).withColumn("nth", last).where("nth = 1").drop("nth")


def per_case_delta(base: DataFrame, new: DataFrame, metric: str) -> DataFrame:
    both = base.select("case_id", F.col(metric).alias("before")).join(new.select("case_id", F.col(metric).alias("after")), "case_id")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


__all__ = ["E", "Linear", "Ranker", "Trees", "apply_learn", "compression_gate", "counterfactual_gate", "from_json", "lift_gate", "load_ranker", "mean_mrr", "merged_results", "payload_honesty", "per_case_delta", "pool_recall", "ranked_by", "replay", "save_ranker", "split_cases", "synthesized", "train_best", "train_lambdamart", "train_logistic"]
