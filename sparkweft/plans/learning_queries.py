"""Feedback, evaluation, transcript and streaming queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import feedback as B
from ..operators import retrieval as R
from ..sources import inputs as I
from ..streaming import events as S
from . import retrieval_queries as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = I.SQL_EVENTS
USED = "CASE WHEN kind IN ('cite', 'accept', 'mark_used') OR (kind = 'dwell' AND dwell_seconds >= 30) THEN 1 WHEN kind IN ('reject', 'view') THEN 0 END"
FOLD = f"{EV}, lab AS (SELECT *, {USED} AS u FROM fb), fold AS (SELECT path, CAST(sum(u) AS BIGINT) AS used, count(*) AS total FROM lab WHERE u IS NOT NULL GROUP BY path)"


@query(f"WITH {EV} SELECT event_id, request_id, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY request_id, kind, path ORDER BY ts, event_id) AS k FROM fb) WHERE k = 1")
def events_dedup(spark, d):
    return B.deduplicated(I.feedback_events(spark, d)).select("event_id", "request_id", "kind", "path")


@query(f"WITH {FOLD} SELECT * FROM fold")
def feedback_fold(spark, d):
    return B.fold(I.feedback_events(spark, d))


@query(f"WITH {FOLD}, r AS (SELECT path, least(greatest(used / greatest(total, 1), 0.01), 0.99) AS r FROM fold) SELECT path, round(ln(r / (1 - r)), 6) AS weight FROM r")
def learned_weights(spark, d):
    return B.learned_weights(B.fold(I.feedback_events(spark, d)))


@query(f"WITH {FOLD}, r AS (SELECT path, round(least(greatest((used / greatest(total, 1) - 0.5) * 2, -1), 1), 4) AS bias FROM fold) SELECT * FROM r WHERE abs(bias) >= 0.05")
def prune_bias(spark, d):
    return B.prune_bias(B.fold(I.feedback_events(spark, d)))


@query(f"WITH {EV} SELECT path, coalesce(max(CASE WHEN kind = 'dwell' THEN dwell_seconds END), 0) AS dwell, max(CASE WHEN kind = 'reject' THEN 1 ELSE 0 END) AS rejected FROM fb GROUP BY path")
def path_signals(spark, d):
    return B.path_signals(I.feedback_events(spark, d))


@query(f"WITH {EV} SELECT path, count(*) AS rejects FROM fb WHERE kind = 'reject' AND ts >= (SELECT max(ts) FROM fb) - 7 * 86400 GROUP BY path HAVING count(*) >= 3")
def reject_counts(spark, d):
    ev = I.feedback_events(spark, d)
    return B.reject_counts(ev, ev.agg(F.max("ts")).first()[0])


@query(f"WITH {EV} SELECT kind, count(*) AS events, CAST(sum({USED}) AS BIGINT) AS positive, count({USED}) - CAST(sum({USED}) AS BIGINT) AS negative FROM fb GROUP BY kind")
def event_counters(spark, d):
    rows = B.labelled(I.feedback_events(spark, d)).groupBy("kind")
    pos = F.sum(F.col("used").cast("int"))
    return rows.agg(F.count("*").alias("events"), pos.alias("positive"), (F.count("used") - pos).alias("negative"))


@query(f"WITH {FOLD}, y AS (SELECT request_id, path, max(u) AS label FROM lab WHERE u IS NOT NULL GROUP BY ALL), f AS (SELECT request_id, path, count(*) AS n_events, round(avg(dwell_seconds), 6) AS mean_value FROM fb GROUP BY ALL) SELECT request_id, path, n_events, mean_value, label FROM f JOIN y USING (request_id, path)")
def training_pairs(spark, d):
    ev = I.feedback_events(spark, d)
    cand = ev.groupBy("request_id", "path").agg(F.count("*").alias("n_events"), F.round(F.avg("dwell_seconds"), 6).alias("mean_value"))
    return B.training_pairs(cand, ev)


@query()
def logistic_ranker(spark, d):
    """One small model for each request, steps in sample order."""
    rows = training_pairs(spark, d).withColumn("model", F.col("request_id")).withColumn("x1", F.col("n_events") / 10).withColumn("x2", F.col("mean_value") / 100)
    return B.sgd_ranker(rows, ["x1", "x2"], epochs=20).select("model", F.round("bias", 4).alias("bias"), F.transform("weights", lambda w: F.round(w, 4)).alias("weights"), "n")


@query(f"WITH {EV}, f AS (SELECT request_id, path, min(ts * 1000000000 + event_id) AS seen FROM fb GROUP BY ALL) SELECT request_id, path, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seen DESC) AS back FROM f) WHERE back <= 100")
def session_memory(spark, d):
    return B.session_memory(I.feedback_events(spark, d))


# --- evaluation -------------------------------------------------------------------------------------
# a case expects the two documents with the lowest ids that hold its query
EXP = f"{T.QS}, ex AS (SELECT query_id AS case_id, doc_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS position FROM q JOIN documents ON contains(lower(text), lower(query))), expected AS (SELECT * FROM ex WHERE position <= 2)"


def expected_of(spark, d):
    rows = R.holding(I.read(spark, d, "documents"), T.queries_of(spark, d)).withColumnRenamed("query_id", "case_id")
    return R.ranked(rows, "case_id", [F.col("doc")], 2).withColumnRenamed("rank", "position")


CASES = (
    f"{EXP}, rnk AS (SELECT query_id AS case_id, doc, rank FROM ({T.SQL['bm25_search']})), n AS (SELECT case_id, count(*) AS n FROM expected GROUP BY case_id), got AS (SELECT case_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS found, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (n - position + 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM expected JOIN rnk USING (case_id, doc) JOIN n USING (case_id) GROUP BY case_id), "
    "ideal AS (SELECT case_id, sum((n - position + 1) / log2(position + 1)) AS ideal FROM expected JOIN n USING (case_id) GROUP BY case_id), cases AS (SELECT case_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM n LEFT JOIN got USING (case_id) LEFT JOIN ideal USING (case_id))"
)


def cases_of(spark, d):
    return E.case_metrics(T.bm25_search(spark, d).withColumnRenamed("query_id", "case_id"), expected_of(spark, d))


@query(f"WITH {CASES} SELECT * FROM cases")
def retrieval_metrics(spark, d):
    return cases_of(spark, d)


@query(f"WITH {CASES}, c AS (SELECT *, CASE case_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS category FROM cases) SELECT category, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM c GROUP BY ROLLUP (category)")
def eval_rollup(spark, d):
    rows = cases_of(spark, d).withColumn("category", F.expr("CASE case_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"))
    return E.rollup(rows, "category", ["recall", "mrr", "ndcg"])


@query("WITH r AS (SELECT quality::DOUBLE AS c, toxic::DOUBLE AS t FROM labels) SELECT round(CASE WHEN isnan(corr(c, t)) THEN 0 ELSE coalesce(corr(c, t), 0) END, 6) AS pearson, round(avg(abs(c - t)), 6) AS mae, count(*) AS n FROM r")
def calibration(spark, d):
    rows = I.read(spark, d, "labels").select(F.col("quality").cast("double").alias("c"), F.col("toxic").cast("double").alias("t"))
    return E.calibration(rows, "c", "t")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return E.latency(I.read(spark, d, "events"), "value", ["event_type"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events), g AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE back <= 2048 GROUP BY event_type) SELECT event_type, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor((len(v) - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM g")
def histogram_points(spark, d):
    return E.histogram_points(I.read(spark, d, "events"), "value", "event_type")


TURNS = "turns AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)"


def transcripts(spark, d):
    size = F.octet_length("text")
    return I.read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") == "assistant", 1)).alias("answers"), F.sum(size).alias("bytes"), F.sum(F.floor(size / 4)).alias("tokens"))


@query(f"WITH {TURNS} SELECT * FROM turns")
def transcript_metrics(spark, d):
    return transcripts(spark, d)


@query(f"WITH {TURNS}, m AS (SELECT conv_id % 2 AS arm, unnest(['turns', 'tokens', 'bytes']) AS metric, unnest([turns::DOUBLE, tokens::DOUBLE, bytes::DOUBLE]) AS v FROM turns), w AS (SELECT metric, median(v) FILTER (arm = 0) AS base, median(v) FILTER (arm = 1) AS new FROM m GROUP BY metric) SELECT metric, base, new, round(CASE WHEN base <> 0 THEN 100 * (base - new) / base ELSE 0 END, 2) AS reduction_pct FROM w")
def ab_medians(spark, d):
    rows = transcripts(spark, d).withColumn("arm", F.when(F.col("conv_id") % 2 == 0, "base").otherwise("new"))
    return E.ab_medians(rows, "arm", ["turns", "tokens", "bytes"], "base", "new")


@query(f"WITH {CASES}, g AS (SELECT query_id AS case_id, doc, rank FROM ({T.SQL['grep_baseline']})), gr AS (SELECT case_id, round(coalesce(sum(CASE WHEN g.rank <= 5 THEN 1 ELSE 0 END) / any_value(n), 0), 6) AS recall FROM n LEFT JOIN expected USING (case_id) LEFT JOIN g USING (case_id, doc) GROUP BY case_id), s AS (SELECT count(*) AS shared, round(avg(gr.recall), 6) AS baseline, round(avg(c.recall), 6) AS current FROM gr JOIN cases c USING (case_id)) SELECT *, current >= baseline - 0.02 AS passed FROM s")
def grep_gate(spark, d):
    grep = E.case_metrics(T.grep_baseline(spark, d).withColumnRenamed("query_id", "case_id"), expected_of(spark, d))
    return E.compare_shared(grep, cases_of(spark, d), "recall")


@query("SELECT doc_id, sha256('doc:' || doc_id || ':' || text) AS payload_key FROM documents")
def payload_hash(spark, d):
    return I.read(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), 256).alias("payload_key"))


# --- streams ----------------------------------------------------------------------------------------
@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL")
def stream_dedup(spark, d):
    return S.once(S.deduplicated(S.event_stream(spark, d)).select("user_id", "event_type", "value")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.once(S.windows(S.event_stream(spark, d), "1 day"), "complete")


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) - k * 86400 AS start, event_type, value FROM events, range(0, 7) r(k)) GROUP BY 1, 2")
def events_sliding(spark, d):
    return S.once(S.windows(S.event_stream(spark, d), "7 days", "1 day"), "complete")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL '30 minutes')) AS BIGINT) AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, sid")
def events_session(spark, d):
    return S.sessions(I.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
