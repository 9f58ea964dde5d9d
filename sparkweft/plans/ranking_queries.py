"""Candidates, features, fusion, explanations, gates and records, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import cochange as C
from ..operators import evaluate as E
from ..operators import learning as Z
from ..operators import ranking as Q
from ..session import checkpointed
from ..sources import index as X
from ..sources import inputs as I
from ..sources import records as O
from . import code_queries as N
from . import graph_queries as G
from . import learning_queries as L
from . import retrieval_queries as T
from . import semantic_queries as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IT = I.SQL_ITEMS
H1 = """h1 AS (SELECT request_id, dst AS item_id, max(weight) AS w FROM seeds JOIN sym ON src = item_id WHERE weight >= 0.8 GROUP BY ALL), f1 AS (SELECT request_id, item_id FROM h1 ANTI JOIN seeds USING (request_id, item_id)),
h2 AS (SELECT request_id, dst AS item_id, max(weight) AS w FROM f1 JOIN sym ON src = item_id WHERE weight >= 0.8 GROUP BY ALL), f2 AS (SELECT request_id, item_id FROM h2 ANTI JOIN seeds USING (request_id, item_id) ANTI JOIN f1 USING (request_id, item_id)),
sn AS (SELECT *, 0 AS depth FROM seeds UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2), mo AS (SELECT request_id, item_id, max(w) AS w FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
bl AS (SELECT request_id, item_id, depth, coalesce(w, 0) AS weight, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, coalesce(w, 0) DESC, item_id) AS rank FROM sn LEFT JOIN mo USING (request_id, item_id)),
st AS (SELECT request_id, item_id, depth, weight, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS rank FROM bl ANTI JOIN seeds USING (request_id, item_id) WHERE rank <= 100)"""


@query(f"WITH {I.SQL_EDGES}, {G.SEEDS}, {H1} SELECT request_id, item_id, depth, round(weight, 6) AS weight, 'bfs' AS signal, CAST(rank AS INT) AS rank FROM st")
def stage_one(spark, d):
    return Q.stage1(G.edges_of(spark, d), G.seeds_of(spark, d), min_weight=0.8).withColumn("weight", F.round("weight", 6))


def _walk() -> str:
    core = G.SQL["rwr_expected"]
    return core[: core.index(", v AS (")]


@query(f"{G._walk_sql(6)[: G._walk_sql(6).rindex(' SELECT request_id, item_id, round(')]}, s AS (SELECT request_id, item_id, v / sum(v) OVER (PARTITION BY request_id) AS score FROM v), r AS (SELECT request_id, item_id, greatest(1, floor(round(score * 1000, 6)))::DOUBLE AS weight, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s ANTI JOIN seeds USING (request_id, item_id)) SELECT request_id, item_id, 1 AS depth, weight, 'rwr' AS signal, CAST(rank AS INT) AS rank FROM r WHERE rank <= 40")
def stage_one_walk(spark, d):
    return Q.stage1(G.edges_of(spark, d), G.seeds_of(spark, d), expansion="rwr", cap=40)


@query(
    f"WITH {I.SQL_EDGES}, seeds AS (SELECT r AS request_id, r * 7 + 1 AS item_id FROM range(6) a(r)), good AS (SELECT * FROM sym WHERE weight >= 0.8), a1 AS (SELECT request_id, dst AS item_id, max(weight) AS weight FROM seeds JOIN good ON src = item_id GROUP BY ALL), "
    "r1 AS (SELECT * FROM (SELECT request_id, item_id, weight, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, item_id) AS rank FROM a1 ANTI JOIN seeds USING (request_id, item_id)) WHERE rank <= 99), "
    "p1 AS (SELECT request_id, item_id FROM r1 WHERE rank <= 25), a2 AS (SELECT request_id, dst AS item_id, max(weight) AS weight FROM p1 JOIN good ON src = item_id GROUP BY ALL), np AS (SELECT request_id, count(*) AS np FROM p1 GROUP BY ALL), "
    "r2 AS (SELECT * FROM (SELECT request_id, item_id, weight, np, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, item_id) AS rank FROM a2 JOIN np USING (request_id) ANTI JOIN p1 USING (request_id, item_id)) WHERE rank <= 100 - np) "
    "SELECT request_id, item_id, 1 AS depth, round(weight, 6) AS weight, 0 AS round FROM r1 UNION ALL SELECT request_id, item_id, 1, round(weight, 6), 1 FROM r2 ANTI JOIN r1 USING (request_id, item_id)"
)
def iterative_retrieval(spark, d):
    """Two rounds of one hop, the second from the best additions of the first."""
    seeds = spark.range(6).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    rows = Q.iterative(G.edges_of(spark, d), seeds, rounds=2, min_weight=0.8, max_depth=1)
    return rows.select("request_id", "item_id", "depth", F.round("weight", 6).alias("weight"), "round")


CANDS = f"cf AS (SELECT request_id, path, weight, item_id % 3 AS depth, CASE WHEN item_id % 4 = 0 THEN 'query_first' ELSE 'bfs' END AS signal, item_id FROM (SELECT r AS request_id, r * 7 + 1 AS seed FROM range(10) a(r)) r JOIN sym ON src = seed JOIN items ON item_id = dst)"


def cands(spark, d):
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    rows = C.neighbours(G.edges_of(spark, d), seeds, 0.0).join(I.items(spark, d), "item_id")
    return rows.select("request_id", "path", "weight", (F.col("item_id") % 3).alias("depth"), F.when(F.col("item_id") % 4 == 0, "query_first").otherwise("bfs").alias("signal"), "item_id")


@query(f"WITH {I.SQL_EDGES}, {IT}, {CANDS} SELECT request_id, path, signal FROM cf WHERE item_id % 5 <> 0 AND (depth > 0 OR signal = 'query_first') AND NOT (item_id % 6 = 0 AND request_id % 2 = 0)")
def filter_phase(spark, d):
    """Candidates that exist (here four of five do), are no seed and are not had already."""
    it, rows = I.items(spark, d), cands(spark, d)
    have = rows.where("item_id % 6 = 0 and request_id % 2 = 0").select("request_id", "path")
    return Q.filtered(rows, it.where("item_id % 5 <> 0"), have).select("request_id", "path", "signal")


@query(f"WITH {I.SQL_EDGES}, {IT}, {CANDS} SELECT request_id, path, signal FROM cf WHERE item_id % 2 = 0 UNION ALL SELECT request_id, path, 'naming' FROM cf WHERE item_id % 2 = 1 AND item_id % 3 = 0")
def hybrid_merge(spark, d):
    """Additions of another signal that are new to their request, behind its candidates."""
    rows = cands(spark, d)
    more = rows.where("item_id % 3 = 0").withColumn("signal", F.lit("naming"))
    return Q.merged(rows.where("item_id % 2 = 0"), more.union(more)).select("request_id", "path", "signal")


FEAT = f"""{I.SQL_EDGES}, {IT}, {T.DEG}, {L.FOLD}, {CANDS}, sd AS (SELECT r AS request_id, path AS seed FROM range(10) a(r) JOIN items ON item_id = r * 7 + 1),
lc AS (SELECT request_id, cf.path, CASE WHEN sh = 0 THEN 1.0 WHEN ds - sh <= 0 THEN 3.0 WHEN ds - sh = 1 THEN 1.8 ELSE 1.3 END::DOUBLE AS locality FROM (SELECT cf.*, seed, {T._shared('seed', 'cf.path')} AS sh, len(string_split(seed, '/')) - 1 AS ds FROM cf JOIN sd USING (request_id)) cf),
lw AS (SELECT path, ln(least(greatest(used / greatest(total, 1), 0.01), 0.99) / (1 - least(greatest(used / greatest(total, 1), 0.01), 0.99))) AS learned FROM fold),
fs AS (SELECT path, coalesce(max(CASE WHEN kind = 'dwell' THEN dwell_seconds END), 0) AS dwell_seconds, max(CASE WHEN kind = 'reject' THEN 1 ELSE 0 END) AS rejected FROM fb GROUP BY path),
x AS (SELECT cf.request_id, cf.path, cf.weight, cf.item_id, 'item_' || (cf.item_id % 200) AS key FROM cf),
ft AS (SELECT x.request_id, x.path, round(x.weight, 6) AS co_change, CASE WHEN x.item_id % 2 = 0 THEN (x.item_id % 7)::DOUBLE ELSE 0 END AS bm25, CASE WHEN x.item_id % 2 = 0 THEN (x.item_id % 5)::DOUBLE ELSE 0 END AS symbol, CASE WHEN x.item_id % 2 = 0 THEN (x.item_id % 3)::DOUBLE ELSE 0 END AS embed, locality, round(log2(2 + coalesce(degree, 0)), 4) AS hub_penalty, round(coalesce(learned, 0), 4) AS learned_boost, round(x.weight * 2, 4) AS rank_score, CASE WHEN x.item_id % 6 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS was_in_already_have, coalesce(dwell_seconds, 0) AS dwell_seconds, coalesce(rejected, 0)::DOUBLE AS rejected
 FROM x JOIN lc USING (request_id, path) LEFT JOIN deg USING (item_id) LEFT JOIN lw ON lw.path = x.key LEFT JOIN fs ON fs.path = x.key)"""


def feature_rows(spark, d, off=None):
    """Features of the neighbours of one seed a request; feedback is that of every two-hundredth item."""
    from ..operators import feedback as B

    rows = cands(spark, d).withColumn("relevance", F.col("weight") * 2)
    it, ev = I.items(spark, d), I.feedback_events(spark, d)
    key = it.select("path", F.expr("'item_' || (item_id % 200)").alias("key"))
    folded = B.fold(ev)
    r = B.rate(F.col("used"), F.col("total"))
    learned = key.join(folded.select(F.col("path").alias("key"), F.log(r / (1 - r)).alias("learned")), "key").select("path", "learned")
    feedback = key.join(B.path_signals(ev).select(F.col("path").alias("key"), F.col("dwell").alias("dwell_seconds"), "rejected"), "key").select("path", "dwell_seconds", "rejected")
    degrees = C.degrees(G.edges_of(spark, d)).join(it, "item_id").select("path", "degree")
    i = F.col("item_id")
    scores = rows.where(i % 2 == 0).select("request_id", "path", (i % 7).alias("bm25"), (i % 5).alias("symbol"), (i % 3).alias("embed"))
    have = rows.where(i % 6 == 0).select("request_id", "path")
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id")).join(it, "item_id").select("request_id", F.col("path").alias("seed"))
    return Q.with_features(rows, degrees, learned, scores, feedback, have, seeds, off=off)


@query(f"WITH {FEAT} SELECT * FROM ft")
def candidate_features(spark, d):
    return feature_rows(spark, d).withColumn("co_change", F.round("co_change", 6))


@query(f"WITH {FEAT} SELECT * REPLACE (0.0::DOUBLE AS locality, 0.0::DOUBLE AS bm25, 0.0::DOUBLE AS rejected) FROM ft")
def ablated_features(spark, d):
    """The same with three signals switched off."""
    return feature_rows(spark, d, ["locality", "bm25", "rejected"]).withColumn("co_change", F.round("co_change", 6))


QTERM = "len(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(q.query), '\\s+'), lambda t: t <> '')), lambda t: contains(lower(ft.path), t)))"
RQ = "rq AS (SELECT r AS request_id, CASE WHEN r % 2 = 0 THEN 'src brass tests' ELSE 'docs Copper  brass' END AS query FROM range(10) a(r))"


@query(
    f"WITH {FEAT}, {RQ}, g AS (SELECT ft.request_id, ft.path, ft.co_change, ft.locality, ft.embed, -degree AS specificity, {QTERM} AS term FROM ft JOIN rq q USING (request_id) JOIN items USING (path) JOIN deg USING (item_id)) "
    "SELECT request_id, path, round(" + " + ".join(f"1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY request_id ORDER BY {s} DESC, path))" for s in ("co_change", "locality", "term", "embed", "specificity")) + ", 9) AS score FROM g"
)
def five_signal_fusion(spark, d):
    """Reciprocal ranks of co-change, locality, terms, embedding and the low degree."""
    it = I.items(spark, d)
    degrees = C.degrees(G.edges_of(spark, d)).join(it, "item_id").select("path", "degree")
    rows = candidate_features(spark, d).select("request_id", "path", "co_change", "locality", "embed").join(degrees, "path")
    query_ = F.when(F.col("request_id") % 2 == 0, "src brass tests").otherwise("docs Copper  brass")
    return Q.five_signals(rows.withColumn("term", Q.term_hits(query_, F.col("path")))).select("request_id", "path", "score")


@query("WITH r AS (SELECT v, (v % 21) / 20.0::DOUBLE AS score, CASE WHEN v % 21 >= 15 THEN 'high' WHEN v % 21 >= 9 THEN 'medium' ELSE 'low' END AS level, v % 2 = 0 AS qo, v % 3 AS hits, v % 4 AS files, v % 5 AS seeds FROM (SELECT unnest(range(300)) AS v)) SELECT v, list_filter([CASE WHEN level = 'low' OR score < 0.45 THEN 'low_retrieval_confidence' END, CASE WHEN qo AND hits = 0 THEN 'query_first_no_hits' END, CASE WHEN seeds = 0 AND files < 2 THEN 'thin_result_set' END, CASE WHEN hits = 0 THEN 'no_orchestrator_hits' END], lambda x: x IS NOT NULL) AS reasons FROM r")
def knowledge_gaps(spark, d):
    v = F.col("id")
    level = F.when(v % 21 >= 15, "high").when(v % 21 >= 9, "medium").otherwise("low")
    return spark.range(300).select(v.alias("v"), Q.gap_reasons((v % 21) / 20, level, v % 2 == 0, v % 3, v % 4, v % 5).alias("reasons"))


@query("SELECT v, CASE WHEN v % 11 = 0 THEN 'truncated_or_timeout' WHEN v % 7 = 0 THEN NULL WHEN v % 5 <= 1 THEN 'escalate_to_signatures' WHEN v % 5 = 2 THEN 'escalate_to_chunks' WHEN v % 3 < 2 THEN 'shrink_payload' ELSE 'mark_used_or_reject' END AS step FROM (SELECT unnest(range(200)) AS v)")
def next_steps(spark, d):
    v = F.col("id")
    compression = F.when(v % 3 == 0, F.lit(None)).when(v % 3 == 1, "none").otherwise("prune")
    return spark.range(200).select(v.alias("v"), Q.next_step(v % 5, v % 7, compression, v % 11 == 0).alias("step"))


def _num(c: str) -> str:
    return f"regexp_replace(printf('%.4f', {c}), '\\.?0+$', '')"


@query(
    f"WITH {FEAT}, g AS (SELECT ft.*, cf.signal, cf.item_id FROM ft JOIN cf USING (request_id, path)) SELECT request_id, path, array_to_string(list_filter([signal, CASE WHEN floor(co_change * 3) > 1 THEN 'co-change w=' || CAST(floor(co_change * 3) AS BIGINT) END, CASE WHEN bm25 > 0 THEN 'bm25=' || {_num('bm25 / 4')} END, CASE WHEN symbol > 0 THEN 'symbol=' || {_num('symbol')} END, CASE WHEN embed > 0 THEN 'embed=' || {_num('embed * 0.15::DOUBLE')} END, CASE WHEN item_id % 9 = 0 THEN 'orc=' || {_num('item_id / 8')} END], lambda x: x IS NOT NULL), ' + ') AS reason FROM g"
)
def pick_lines(spark, d):
    """Why each candidate was picked, with its signals' scores."""
    rows = candidate_features(spark, d).join(cands(spark, d).select("request_id", "path", "signal", "item_id"), ["request_id", "path"])
    scores = {"bm25": F.col("bm25") / 4, "symbol": F.col("symbol"), "embed": F.col("embed") * 0.15}
    fused = F.when(F.col("item_id") % 9 == 0, F.col("item_id") / 8)
    return rows.select("request_id", "path", Q.pick_reason(F.col("signal"), F.col("co_change") * 3, scores, fused, F.col("rank_score")).alias("reason"))


PR = f"WITH {T.RANKED}, b AS (SELECT rk.*, ((item_id % 21) - 10) / 10.0::DOUBLE AS bias, item_id % 13 = 0 AS seed, CASE WHEN item_id % 8 = 0 THEN 'semantic' END AS signal FROM rk)"


@query(f"{PR}, k AS (SELECT *, rank <= 10 OR seed OR coalesce(signal = 'semantic', false) OR bias >= -0.3 AS keep FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY keep DESC, rank) AS place FROM k) SELECT request_id, item_id, path, CAST(rank AS INT) AS rank FROM p WHERE keep OR place <= 3")
def learned_prune(spark, d):
    i = F.col("item_id")
    rows = T.ranked_candidates(spark, d).withColumn("seed", i % 13 == 0).withColumn("signal", F.when(i % 8 == 0, "semantic"))
    bias = I.items(spark, d).select("path", (((i % 21) - 10) / 10.0).alias("bias"))
    return Q.learned_prune(rows, bias).select("request_id", "item_id", "path", "rank")


@query(f"WITH {T.RANKED}, t AS (SELECT rk.*, CASE WHEN request_id % 2 = 0 THEN 25 ELSE 12 END AS cap FROM rk) SELECT request_id, item_id, CAST(rank AS INT) AS rank FROM t WHERE rank <= cap")
def tier_one_map(spark, d):
    """The first tier's rows: twelve, or twenty-five where the seed is a hub (here every other request)."""
    return T.ranked_candidates(spark, d).where(F.col("rank") <= Q.tier1_cap(F.col("request_id") % 2 == 0)).select("request_id", "item_id", "rank")


@query(f"WITH {IT}, q AS (SELECT unnest(['default', 'endpoint', 'schema', 'docs', 'openapi', 'test']) AS intent), p AS (SELECT path FROM items UNION ALL SELECT unnest(['fastapi/routing.py', 'fastapi/_compat/x.py', 'fastapi/openapi/models.py', 'a/openapi/b.py', 'openapi/models.py', 'fastapi/a/b.py', 'x/routing.py'])), k AS (SELECT path, intent, {T.CLASS} AS kind FROM p, q) SELECT path, intent, round(CASE WHEN kind = 'generated' THEN 0.01 WHEN kind = 'fixture' THEN 0.1 WHEN intent = 'endpoint' AND kind = 'route' THEN 2.5 WHEN intent = 'endpoint' AND kind = 'source' AND regexp_matches(lower(path), 'controller|model|service|serializer|patient') THEN 1.4 WHEN intent = 'endpoint' AND kind = 'doc' THEN 0.2 WHEN intent = 'schema' AND kind = 'migration' THEN 2.0 WHEN intent = 'schema' AND kind = 'route' THEN 0.5 WHEN intent = 'docs' AND kind = 'doc' THEN 2.0 WHEN intent = 'openapi' AND contains(lower(path), '/openapi/') AND lower(path) LIKE '%openapi/models.py' THEN 4.5 WHEN intent = 'openapi' AND contains(lower(path), '/openapi/') THEN 3.5 WHEN intent = 'openapi' AND regexp_matches(lower(path), '^fastapi/([^/]+|_compat/[^/]+)$') THEN 0.35 WHEN intent = 'openapi' AND (lower(path) LIKE '%routing.py' OR kind = 'route') THEN 0.5 WHEN intent = 'test' AND kind = 'test' THEN 2.0 WHEN kind = 'doc' THEN 0.5 ELSE 1.0 END::DOUBLE, 6) AS weight FROM k")
def class_weights(spark, d):
    """What a path's class counts for under each intent."""
    more = ["fastapi/routing.py", "fastapi/_compat/x.py", "fastapi/openapi/models.py", "a/openapi/b.py", "openapi/models.py", "fastapi/a/b.py", "x/routing.py"]
    paths = I.items(spark, d).select("path").union(spark.createDataFrame([(m,) for m in more], "path string"))
    rows = paths.select("path", F.explode(F.array(*[F.lit(i) for i in ("default", "endpoint", "schema", "docs", "openapi", "test")])).alias("intent"))
    p = F.col("path")
    return rows.select("path", "intent", F.round(P.file_class_weight(P.file_class(p), F.col("intent"), p), 6).alias("weight"))


@query("SELECT conv_id, turn, least(CASE WHEN turn % 3 = 0 THEN 30000 ELSE turn * 9000 + 1000 END, 20000) AS token_budget, CASE WHEN turn % 2 = 0 THEN 2 ELSE turn END AS tier, CASE WHEN turn % 5 = 0 THEN 'large' ELSE 'own' END AS profile FROM conversations")
def policy_caps(spark, d):
    """Requests under a policy of defaults and a cap, merged from two layers."""
    policy = Q.merged_policy({"token_budget_default": 10, "default_tier": 2, "profile_default": "large"}, {"token_budget_default": 30_000, "max_token_budget": 20_000})
    t = F.col("turn")
    rows = I.read(spark, d, "conversations").select("conv_id", "turn", F.when(t % 3 != 0, t * 9000 + 1000).cast("int").alias("token_budget"), F.when(t % 2 != 0, t).cast("int").alias("tier"), F.when(t % 5 != 0, "own").alias("profile"))
    return Q.with_policy(rows, policy)


# --- evaluation ---------------------------------------------------------------------------------
@query(f"WITH {L.CASES}, pool AS (SELECT DISTINCT query_id AS case_id, doc FROM ({T.SQL['tfidf_search']})) SELECT case_id, round(count(pool.doc)::DOUBLE / count(*), 6) AS recall FROM (SELECT DISTINCT case_id, doc FROM expected) e LEFT JOIN pool USING (case_id, doc) GROUP BY case_id")
def pool_recall(spark, d):
    return Z.pool_recall(T.tfidf_search(spark, d).withColumnRenamed("query_id", "case_id"), L.expected_of(spark, d))


@query("WITH r AS (SELECT v, v * 37 % 900 AS used, v % 6 AS expected, CASE WHEN v % 10 = 0 THEN 0 ELSE 400 END AS budget FROM (SELECT unnest(range(150)) AS v)) SELECT v, CASE WHEN expected = 0 THEN 1.0 WHEN used = 0 THEN 0.0 ELSE round(expected / used, 4) END::DOUBLE AS efficiency, CASE WHEN used <= budget THEN 1.0 WHEN budget = 0 THEN 0.0 ELSE round(greatest(0, 1 - (used - budget) / budget), 4) END::DOUBLE AS honesty FROM r")
def token_honesty(spark, d):
    from ..operators import payload as Y

    v = F.col("id")
    used, expected, budget = v * 37 % 900, v % 6, F.when(v % 10 == 0, 0).otherwise(400)
    return spark.range(150).select(v.alias("v"), Y.token_efficiency(used, expected).cast("double").alias("efficiency"), Y.token_honesty(used, budget).cast("double").alias("honesty"))


@query("WITH e AS (SELECT conv_id AS case_id, CASE WHEN conv_id % 4 <> 1 THEN strlen(text) // 4 END AS t FROM conversations WHERE conv_id % 7 <> 3), p AS (SELECT case_id, sum(coalesce(t, 0)) AS s, count(t) AS c FROM e GROUP BY ALL), r AS (SELECT conv_id AS case_id, CAST(sum(strlen(text) // 4) AS BIGINT) + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS used FROM conversations GROUP BY conv_id) SELECT case_id, CASE WHEN CASE WHEN s IS NULL THEN used = 0 WHEN c = 0 THEN true ELSE s = used END THEN 1.0 ELSE 0.0 END::DOUBLE AS honest FROM r LEFT JOIN p USING (case_id)")
def payload_honesty(spark, d):
    """Whether the tokens of a conversation's entries add up to what it reports."""
    conv, i = I.read(spark, d, "conversations"), F.col("conv_id")
    tokens = F.floor(F.octet_length("text") / 4)
    entries = conv.where(i % 7 != 3).select(i.alias("case_id"), F.when(i % 4 != 1, tokens).alias("tokens_actual"))
    used = conv.groupBy(i.alias("case_id")).agg(F.sum(tokens).alias("s")).select("case_id", (F.col("s") + F.when(F.col("case_id") % 5 == 0, 1).otherwise(0)).alias("tokens_used"))
    return Z.payload_honesty(entries, used)


GATE = "g AS (SELECT case_id, recall, 300 + case_id % 50 * 20 AS tokens, CASE WHEN case_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS base_recall, CASE WHEN case_id % 5 = 0 THEN 0 ELSE 700 END AS base_tokens FROM cases)"


def gate_rows(spark, d):
    i = F.col("case_id")
    return L.cases_of(spark, d).select("case_id", "recall", (300 + i % 50 * 20).alias("tokens"), F.when(i % 3 == 0, 0.5).otherwise(1.0).alias("base_recall"), F.when(i % 5 == 0, 0).otherwise(700).alias("base_tokens"))


@query(f"WITH {L.CASES}, {GATE} SELECT count(*) FILTER (base_tokens > 0) AS compared, count(*) FILTER (base_tokens <= 0) AS skipped, count(*) FILTER (base_tokens > 0 AND base_recall > recall + 1e-9 AND tokens > base_tokens) AS failures, round(coalesce(median(CASE WHEN base_tokens > 0 THEN round(base_tokens / tokens, 2) END), 0), 2) AS median_reduction, count(*) FILTER (base_tokens > 0 AND base_recall > recall + 1e-9 AND tokens > base_tokens) = 0 AS passed FROM g")
def counterfactual_gate(spark, d):
    return Z.counterfactual_gate(gate_rows(spark, d))


@query(f"WITH {L.CASES}, {GATE}, c AS (SELECT *, CASE case_id % 2 WHEN 0 THEN 'concept' ELSE 'seeded' END AS category FROM g) SELECT count(*) AS cases, round(avg(recall), 6) AS mean, coalesce(round(avg(recall), 6) >= 0.5833 + 0.05, false) AS passed FROM c WHERE category = 'concept'")
def concept_gate(spark, d):
    rows = gate_rows(spark, d).withColumn("category", F.when(F.col("case_id") % 2 == 0, "concept").otherwise("seeded"))
    return Z.lift_gate(rows, "concept", "recall", 0.5833, 0.05)


@query(f"WITH {L.CASES}, c AS (SELECT recall, recall * CASE WHEN case_id % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS recall_after, (case_id % 10) / 10.0::DOUBLE AS savings_ratio FROM cases) SELECT count(*) AS cases, round(avg(savings_ratio), 6) AS savings, round(avg(recall) - avg(recall_after), 6) AS loss, round(avg(savings_ratio), 6) >= 0.2 AND round(avg(recall) - avg(recall_after), 6) <= 0.2 AS passed FROM c")
def compression_gate(spark, d):
    i = F.col("case_id")
    rows = L.cases_of(spark, d).select("recall", (F.col("recall") * F.when(i % 4 == 0, 0.5).otherwise(1.0)).alias("recall_after"), (i % 10 / 10.0).alias("savings_ratio"))
    return Z.compression_gate(rows, least=0.2, loss=0.2)


@query(f"WITH {L.CASES} SELECT case_id, mrr AS before, round(mrr * CASE WHEN case_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE, 6) AS after, round(round(mrr * CASE WHEN case_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE, 6) - mrr, 6) AS delta FROM cases WHERE case_id % 2 = 0")
def case_deltas(spark, d):
    """MRR of the cases that two runs share, and the difference."""
    base = L.cases_of(spark, d)
    half = F.when(F.col("case_id") % 3 == 0, 0.5).otherwise(1.0)
    new = base.where("case_id % 2 = 0").select("case_id", F.round(F.col("mrr") * half, 6).alias("mrr"))
    return Z.per_case_delta(base, new, "mrr")


@query("WITH c AS (SELECT conv_id AS case_id, any_value(CASE WHEN conv_id % 3 = 0 THEN 'concept' ELSE 'pr' END) AS category, any_value(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 2 END) AS seeds FROM conversations GROUP BY conv_id) SELECT case_id, category, seeds, category = 'concept' AND seeds = 0 AS held_out FROM c")
def holdout_split(spark, d):
    i = F.col("conv_id")
    cases = I.read(spark, d, "conversations").select(i.alias("case_id"), F.when(i % 3 == 0, "concept").otherwise("pr").alias("category"), F.when(i % 2 == 0, 0).otherwise(2).alias("seeds")).distinct()
    return Z.split_cases(cases)


@query("WITH r AS (SELECT event_type AS repo_key, user_id AS built_at, sum(value) AS v FROM events GROUP BY ALL), u AS (SELECT repo_key, built_at, round(v, 4) AS v FROM r) SELECT repo_key, built_at, v FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY built_at DESC) AS k FROM u) WHERE k = 1")
def merged_results(spark, d):
    """Results of two runs by key: the latest of each."""
    rows = I.read(spark, d, "events").groupBy(F.col("event_type").alias("repo_key"), F.col("user_id").alias("built_at")).agg(F.round(F.sum("value"), 4).alias("v"))
    return Z.merged_results(rows.where("built_at % 2 = 0"), rows.where("built_at % 2 = 1"), "repo_key", "built_at")


TOOLS = ["Read", "Grep", "Bash", "Task", "mcp__context__search", "Write", "Glob", "View"]
CALLS = f"calls AS (SELECT conv_id AS run_id, {S.sql_list(TOOLS)}[turn % 8 + 1] AS tool FROM conversations WHERE turn % 5 <> 4), tb AS (SELECT run_id, CASE WHEN tool LIKE 'mcp__%context%' THEN 'own' WHEN tool IN ('Read', 'View') THEN 'read' WHEN tool IN ('Grep', 'Glob') THEN 'search' WHEN tool = 'Bash' THEN 'exec' WHEN tool = 'Task' THEN 'explore' ELSE 'other' END AS kind FROM calls)"


@query(
    f"WITH {CALLS}, per AS (SELECT run_id, count(*) AS total_calls, " + ", ".join(f"count(*) FILTER (kind = '{b}') AS {b}_calls" for b in ("own", "read", "search", "exec", "explore", "other")) + " FROM tb GROUP BY run_id), us AS (SELECT conv_id AS run_id, CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'new' END AS arm, CAST(sum(strlen(text)) AS BIGINT) AS input_tokens, CAST(sum(strlen(text) // 4) AS BIGINT) AS output_tokens, max(turn) AS num_turns, round(max(turn) / 100.0::DOUBLE, 6) AS cost FROM conversations GROUP BY ALL) "
    "SELECT run_id, arm, input_tokens, output_tokens, num_turns, cost, coalesce(total_calls, 0) AS total_calls, " + ", ".join(f"coalesce({b}_calls, 0) AS {b}_calls" for b in ("own", "read", "search", "exec", "explore", "other")) + ", input_tokens + output_tokens AS total_tokens FROM us LEFT JOIN per USING (run_id)"
)
def run_metrics(spark, d):
    """Tool calls by what they do, tokens, turns and cost of each run."""
    conv, t = I.read(spark, d, "conversations"), F.col("turn")
    tool = F.get(F.array(*[F.lit(x) for x in TOOLS]), (t % 8).cast("int"))
    calls = conv.where(t % 5 != 4).select(F.col("conv_id").alias("run_id"), tool.alias("tool"))
    size = F.octet_length("text")
    usage = conv.select(F.col("conv_id").alias("run_id"), F.when(F.col("conv_id") % 2 == 0, "base").otherwise("new").alias("arm"), size.alias("input_tokens"), F.floor(size / 4).alias("output_tokens"), t.alias("num_turns"), F.round(t / 100.0, 6).alias("cost"))
    return O.run_metrics(calls, usage)


# --- stores -------------------------------------------------------------------------------------
def scratch_folder(spark, name: str) -> str:
    from ..session import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {S.CODE}, {S.NQ}, {S.CODE_BM25.replace('cbm AS', 'cbx AS').replace('FROM code)', 'FROM kept)').replace('FROM code ', 'FROM kept ').replace('FROM code,', 'FROM kept,')} SELECT query_id, doc, score, rank FROM cbx WHERE rank <= 20".replace(", cpost AS", ", kept AS (SELECT * FROM code WHERE p_partkey % 10 <> 3), cpost AS"))
def stored_index(spark, d):
    """BM25 over the stored index: built in two parts, some paths indexed again after a change, some deleted."""
    folder = scratch_folder(spark, "index")
    docs = N.code_files(spark, d)
    old = docs.where("p_partkey % 2 = 0").withColumn("text", F.when(F.col("p_partkey") % 4 == 0, F.lit("class Old: pass")).otherwise(F.col("text")))
    X.index_paths(old.select("path", "text"), folder)
    X.catch_up(docs.select("path", "text"), folder, step=1_000_000)
    X.delete_paths(spark, folder, docs.where("p_partkey % 10 = 3").select("path"))
    return X.search(spark, folder, S.named_queries(spark, d))


@query("WITH s AS (SELECT doc_id, 'a.b.m' || doc_id AS symbol, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'f' || doc_id END AS file, CASE doc_id % 4 WHEN 0 THEN 99 WHEN 1 THEN 3 ELSE 14 END AS line FROM documents) SELECT doc_id, symbol, line, CASE WHEN file = 'none' THEN 'missing file' WHEN line = 99 THEN 'out of range' WHEN line = 14 THEN 'symbol not found' END AS problem FROM s")
def checked_flows(spark, d):
    """Cited steps against files of twenty lines that name their symbol in line six."""
    i = F.col("doc_id")
    docs = I.read(spark, d, "documents").select("doc_id")
    name = F.concat(F.lit("m"), i.cast("string"))
    files = docs.select(F.concat(F.lit("f"), i.cast("string")).alias("path"), F.concat(F.repeat(F.lit("x\n"), F.lit(5)), F.lit("def "), name, F.repeat(F.lit("\ny"), F.lit(14))).alias("text"))
    line = F.when(i % 4 == 0, 99).when(i % 4 == 1, 3).otherwise(14)
    steps = docs.select(i.cast("string").alias("flow_id"), F.lit(0).alias("step"), F.concat(F.lit("a.b."), name).alias("symbol"), F.when(i % 5 == 0, "none").otherwise(F.concat(F.lit("f"), i.cast("string"))).alias("file"), line.alias("line"))
    return O.checked_steps(steps, files).select(F.col("flow_id").cast("long").alias("doc_id"), "symbol", "line", "problem")


@query(f"WITH {L.EV}, u AS (SELECT kind, CASE WHEN path <> '' THEN substr(sha256(path), 1, 16) ELSE '' END AS query_hash FROM fb) SELECT kind, query_hash, count(*) AS n FROM u GROUP BY ALL")
def audit_log(spark, d):
    """Audit lines written as JSON and read again; queries by the start of their hash."""
    folder = scratch_folder(spark, "audit")
    O.write_audit(I.feedback_events(spark, d).select("kind", F.col("path").alias("query")), folder)
    return spark.read.schema("kind string, query_hash string").json(folder).groupBy("kind", "query_hash").agg(F.count("*").alias("n"))


@query()
def lambdamart_ranker(spark, d):
    """Boosted trees on the events of requests, and what they rank first."""
    rows = L.training_pairs(spark, d).select("request_id", "path", "label", F.col("n_events").cast("double").alias("n_events"), F.col("mean_value").alias("mean_value"))
    model = Z.train_lambdamart(rows, ["n_events", "mean_value"], trees=3, leaves=4)
    return Z.ranked_by(model, rows, ["n_events", "mean_value"]).where("rank <= 3").select("request_id", "path", "rank")


@query()
def feedback_replay(spark, d):
    """A ranker learned from synthesized feedback, saved only if it helps the cases held out."""
    rows = checkpointed(candidate_features(spark, d))  # read in every step
    expected = rows.where(F.crc32("path") % 7 == 0).select("request_id", "path")
    held = rows.select("request_id").distinct().where("request_id % 3 = 0")
    out = Z.replay(rows, expected, held, ["co_change", "bm25", "locality", "hub_penalty"], "co_change", prefer="logistic")
    return spark.createDataFrame([tuple(out[k] for k in ("baseline_mrr", "after_mrr", "delta", "saved", "passed"))], "baseline_mrr double, after_mrr double, delta double, saved boolean, passed boolean")


__all__ = ["E", "QUERIES", "SQL"]
