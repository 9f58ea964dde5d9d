"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so words are labelled at a distance: a word of a toxic training document is
toxic if its type is far more common in toxic than in clean training documents.  Those document
frequencies are counted over all labelled training rows, and every type of enough evidence has a weight
of its own; the field (these weights, one for all other words, and the two-state transitions) and the calibration
are fitted on at most ``FIT_ROWS`` labelled rows, the ones with the least hash.

Forward and backward passes give the marginal of each word exactly.  Words outside the table of types
share one transfer matrix, so a run of them is a matrix power, and a text costs as many steps as it
has words in the table.  A document's score is calibrated from its marginals; words above 0.5 are its
offending spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

FIT_ROWS, CONTEXT, SEED_ODDS, BROADCAST_ROWS = 5_000, 6, 2.5, 2_000_000
#: More types of enough evidence than this are refused, not cut: the thresholds below are to be raised then.
MOST_TYPES = 1_000_000
#: Log-likelihood ratios, of a type's documents being toxic more often than others, from which it is in the table and seeds labels.
TABLE_G2, SEED_G2 = 15.0, 26.0
WORD = re.compile(r"[^\W\d_]+")


def _logsumexp(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=-1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=-1, keepdims=True)))[..., 0]


class Field:
    """Two states (clean 0, toxic 1); ``emit[type]`` is the toxic score of a word, ``move`` the transition scores."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, rest: float, move: np.ndarray):
        self.index, self.emit, self.rest, self.move = index, emit, rest, move
        step = np.exp(move) * np.exp([0.0, rest])[None, :]
        self.values, self.vectors = np.linalg.eig(step)
        self.values, self.vectors = self.values.real, self.vectors.real
        self.inverse = np.linalg.inv(self.vectors)
        self.scale = self.values.max()

    def run(self, gap: int) -> np.ndarray:
        """The normalised transfer of so many words outside the table."""
        return (self.vectors * (self.values / self.scale) ** gap) @ self.inverse

    def marginals(self, at: list[int], types: list[int], n: int) -> np.ndarray:
        """Toxic marginals of the words of the table at positions ``at`` of n words."""
        k = len(at)
        move = np.exp(self.move)
        start = np.array([1.0, 1.0])
        emits = np.exp(np.stack([np.zeros(k), self.emit[types]], axis=1))
        before, prev = np.empty((k, 2)), -1
        vec = start
        for i in range(k):
            gap = at[i] - prev - 1
            if prev < 0 and gap:
                vec = (start * np.array([1.0, np.exp(self.rest)])) @ self.run(gap - 1) @ move
            elif prev >= 0:
                vec = vec @ self.run(gap) @ move
            vec = np.maximum(vec, 1e-300) * emits[i]
            vec = vec / vec.sum()
            before[i], prev = vec, at[i]
        after, nxt, vec = np.empty((k, 2)), n, np.ones(2)
        for i in range(k - 1, -1, -1):
            gap = nxt - at[i] - 1
            if nxt == n:
                vec = self.run(gap) @ np.ones(2)
            else:
                vec = self.run(gap) @ (move @ (emits[i + 1] * vec))
            vec = np.maximum(vec, 1e-300)
            vec = vec / vec.sum()
            after[i], nxt = vec, at[i]
        both = before * after
        return both[:, 1] / both.sum(axis=1)

    def tag(self, text: str | None) -> tuple[int, list[tuple[int, int]], np.ndarray]:
        """Words, code point spans of the words of the table, their toxic marginals."""
        if not text:
            return 0, [], np.empty(0)
        low = text.lower()
        words = WORD.findall(low)
        if self.index.keys().isdisjoint(words):
            return len(words), [], np.empty(0)
        at = [i for i, w in enumerate(words) if w in self.index]
        p = self.marginals(at, [self.index[words[i]] for i in at], len(words))
        if len(low) == len(text):
            spans = [m.span() for m in WORD.finditer(low)]
        else:  # lower-casing changed the length: back to the characters that the lower-cased ones came from
            of = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
            spans = [(int(of[m.start()]), int(of[m.end() - 1]) + 1) for m in WORD.finditer(low)]
        return len(words), [spans[i] for i in at], p


def fit_field(rows: list[tuple[int, list[list[int]]]], types: list[str], seeds: set[int], rounds: int = 80, width: int = 64, rate: float = 0.5, l2: float = 0.01) -> Field:
    """rows: (label, segments of type numbers, -1 outside the table).  Adam on the mean log-likelihood."""
    segs, labels = [], []
    for label, parts in rows:
        for part in parts:
            for s in (part[i : i + width] for i in range(0, len(part), width)):
                segs.append(s)
                labels.append([int(label == 1 and t in seeds) for t in s])
    size = len(types) + 1
    emit, move = np.zeros(size), np.zeros((2, 2))
    emit[-1] = -2.0
    if segs:
        width = max(map(len, segs))
        x = np.full((len(segs), width), -1)
        y = np.zeros((len(segs), width), dtype=int)
        real = np.zeros((len(segs), width), dtype=bool)
        for i, (s, lab) in enumerate(zip(segs, labels, strict=True)):
            x[i, : len(s)], y[i, : len(s)], real[i, : len(s)] = s, lab, True
        x = np.where(x < 0, size - 1, x)
        theta, m, v = np.concatenate((emit, move.ravel())), 0.0, 0.0
        for t in range(1, rounds + 1):
            emit, move = theta[:size], theta[size:].reshape(2, 2)
            e = np.stack([np.zeros(x.shape), emit[x]], axis=-1)
            fwd, bwd = np.zeros(e.shape), np.zeros(e.shape)
            fwd[:, 0] = e[:, 0]
            for j in range(1, width):
                step = _logsumexp((fwd[:, j - 1, :, None] + move[None]).transpose(0, 2, 1)) + e[:, j]
                fwd[:, j] = np.where(real[:, j, None], step, fwd[:, j - 1])
            z = _logsumexp(fwd[:, -1])
            for j in range(width - 2, -1, -1):
                step = _logsumexp(move[None] + (e[:, j + 1] + bwd[:, j + 1])[:, None, :])
                bwd[:, j] = np.where(real[:, j + 1, None], step, 0.0)
            p = np.exp(fwd + bwd - z[:, None, None])
            g = np.zeros(size + 4)
            np.add.at(g, x[real], (y - p[:, :, 1])[real])
            pair = np.exp(fwd[:, :-1, :, None] + move[None, None] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None])
            on = real[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    g[size + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & on).sum() - pair[:, :, a, b][on].sum()
            g = g / len(segs) - l2 * theta / len(segs)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / (1 + t / 50)
        emit, move = theta[:size], theta[size:].reshape(2, 2)
    return Field({w: i for i, w in enumerate(types)}, emit[:-1].copy(), float(emit[-1]), move.copy())


def features(n: int, p: np.ndarray) -> list[float]:
    none = -np.log1p(-np.minimum(p, 1 - 1e-9)).sum() if len(p) else 0.0
    return [1.0, float(np.log1p(none)), float(p.max()) if len(p) else 0.0, float(none / np.sqrt(n + 1.0))]


def calibrate(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by damped Newton steps; the bias is not shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * l2
    ridge[0, 0] = 1e-6
    for _ in range(rounds if len(y) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - q) - ridge @ w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
    return w


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 22):
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count[y].update(set(WORD.findall((text or "").lower())))
        words = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([count[1][w] for w in words], pa.int64()), pa.array([count[0][w] for w in words], pa.int64())],
            names=["word", "toxic", "clean"],
        )


def segments(text: str | None, index: dict[str, int], context: int = CONTEXT) -> list[list[int]]:
    """Type numbers of the stretches around words of the table."""
    words = [index.get(w, -1) for w in WORD.findall((text or "").lower())]
    out, end = [], 0
    for i, w in enumerate(words):
        if w < 0:
            continue
        a, b = max(0, i - context), min(len(words), i + context + 1)
        if out and a <= end:
            out[-1] += words[end:b]
        else:
            out.append(words[a:b])
        end = b
    return out


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Scorer:
    def __init__(self, field: Field, weights: np.ndarray):
        self.field, self.weights = field, weights

    def score(self, text: str | None) -> tuple[float, str]:
        n, spans, p = self.field.tag(text)
        x = float(np.dot(self.weights, features(n, p)))
        bad = ",".join(f"{a}:{b}" for (a, b), q in zip(spans, p.tolist(), strict=True) if q > 0.5)
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))), bad


def learn(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Scorer:
    """Fits on the labelled rows that are not held out; a doc_id with several labels has the highest."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    if sum(n.values()) <= BROADCAST_ROWS:
        y = F.broadcast(y)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out()).join(y, "doc_id").select("text", "y", "doc_id")
    counts = rows.select("text", "y").mapInArrow(_types, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("t") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n0 + 1.0))
    base, own = n1 / max(1, n1 + n0), F.col("t") / (F.col("t") + F.col("c"))
    term = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    g2 = 2 * (term(F.col("t"), own, F.lit(max(base, 1e-9))) + term(F.col("c"), 1 - own, F.lit(max(1 - base, 1e-9))))
    top = counts.withColumn("odds", odds).withColumn("g2", g2).where((F.col("g2") >= TABLE_G2) & (F.col("odds") > 0.7)).limit(MOST_TYPES + 1).collect()
    if len(top) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} words of enough evidence; raise TABLE_G2")
    top.sort(key=lambda r: r["word"])
    index = {r["word"]: i for i, r in enumerate(top)}
    seeds = {i for i, r in enumerate(top) if r["odds"] >= SEED_ODDS and r["g2"] >= SEED_G2}
    if not seeds:  # too few rows for sure seeds: the words of the table that are as far more common
        seeds = {i for i, r in enumerate(top) if r["odds"] >= SEED_ODDS}
    if not index:
        field = Field({}, np.zeros(0), -2.0, np.zeros((2, 2)))
        return Scorer(field, np.array([np.log((n1 + 0.5) / (n0 + 1.0)), 0, 0, 0]))
    # the rows with the least hash, so that the sample does not depend on how rows are dealt
    share = min(1.0, 1.2 * fit_rows / max(1, sum(n.values())))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            seg = [segments(t, index) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(seg, pa.list_(pa.list_(pa.int32()))), batch.column(2)], names=["y", "seg", "doc_id"])

    segs = sample.select("text", "y", "doc_id").mapInArrow(cut, "y int, seg array<array<int>>, doc_id long").where("size(seg) > 0")
    least = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    fit = [(r[0], r[1]) for r in segs.orderBy(*least, F.xxhash64("seg")).limit(fit_rows).collect()]
    field = fit_field(fit, [r["word"] for r in top], seeds)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = [features(a, p) for a, _, p in map(field.tag, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["y", "x", "doc_id"])

    xy = sample.select("text", "y", "doc_id").mapInArrow(mark, "y int, x array<double>, doc_id long").orderBy(*least, "x").limit(fit_rows).collect()
    return Scorer(field, calibrate(np.array([r[1] for r in xy]).reshape(-1, 4), np.array([r[0] for r in xy], dtype=float)))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents (doc_id, text, ...) and labels (doc_id, toxic) -> doc_id, held_out, score, predicted, spans.

    One row for each document row; spans are start:end code points of the offending words, comma-joined.
    Null and empty texts have no words and get the score of a text without toxic words.  With no labels
    at all every score is 1/3 and nothing is predicted toxic.  Repeated rows repeat with the same score, and count as often in
    training.  A score of exactly 0.5 is predicted toxic.  Long texts are tagged whole, and spans count the code points of the text
    as it is.  Empty documents give an empty result; other columns of any name are not read.
    """
    scorer = learn(docs, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            score = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([f[1] for f in found], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans string")


def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
