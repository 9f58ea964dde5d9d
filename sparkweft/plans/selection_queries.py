"""Fusion, snippets, signatures, savings, stores and the whole context, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..api import Engine
from ..functions import paths as P
from ..operators import evaluate as E
from ..operators import feedback as B
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators import tree as W
from ..sources import inputs as I
from ..session import shared_dir
from ..sources import stores
from . import graph_queries as G
from . import learning_queries as L
from . import retrieval_queries as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {T.RANKED}, p AS (SELECT rk.request_id, rk.item_id, rk.path, rk.score AS base, degree FROM rk JOIN deg USING (item_id)) SELECT request_id, item_id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY request_id ORDER BY base DESC, path)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY request_id ORDER BY degree, path)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY request_id ORDER BY length(path), path)), 9) AS score FROM p")
def rank_rrf(spark, d):
    deg = G.C.degrees(G.edges_of(spark, d)).select("item_id", "degree")
    rows = T.ranked_candidates(spark, d).withColumnRenamed("score", "base").join(deg, "item_id").withColumn("size", F.length("path"))
    return S.rank_rrf(rows, {"base": True, "degree": False, "size": False}).select("request_id", "item_id", "score")


@query(f"{G.COMP}, mem AS (SELECT p_partkey AS item_id, coalesce(component, p_partkey) AS c FROM part LEFT JOIN comp ON item_id = p_partkey), sd AS (SELECT r AS request_id, r * 7 + 1 AS item_id FROM range(10) a(r)), home AS (SELECT DISTINCT request_id, c FROM sd JOIN mem USING (item_id)), cand AS (SELECT request_id, dst AS item_id FROM sd JOIN sym ON src = item_id) SELECT cand.request_id, cand.item_id, CASE WHEN home.c IS NOT NULL THEN 3.0 ELSE 0.0 END::DOUBLE AS boost FROM cand JOIN mem USING (item_id) LEFT JOIN home ON home.request_id = cand.request_id AND home.c = mem.c")
def community_boost(spark, d):
    edges = G.edges_of(spark, d)
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    rows = G.C.neighbours(edges, seeds, 0.0).select("request_id", "item_id")
    members = G.G.connected_components(edges, I.items(spark, d), min_weight=0.9)
    return S.community_boost(rows, members, seeds).select("request_id", "item_id", "boost")


@query(
    f"WITH {T.QS}, b AS (SELECT query_id, doc AS doc_id FROM ({T.SQL['bm25_search']}) WHERE rank <= 2), r AS (SELECT query_id, doc_id, string_split(text, chr(10)) AS l, list_distinct({T.TERMS.format('query')}[1:16]) AS t0, query FROM b JOIN q USING (query_id) JOIN documents USING (doc_id)), "
    f"o AS (SELECT query_id, doc_id, l, (SELECT list(term ORDER BY i) FROM (SELECT x AS term, min(i) AS i FROM (SELECT unnest({T.TERMS.format('query')}[1:16]) AS x, unnest(range(16)) AS i) WHERE x IS NOT NULL GROUP BY x ORDER BY 2 LIMIT 6)) AS t FROM r), "
    "e AS (SELECT query_id, doc_id, l, pos, len(list_filter(t, lambda x: contains(lower(l[pos]), x))) AS hits FROM o, unnest(range(1, len(l) + 1)) g(pos)) "
    "SELECT query_id, doc_id, CAST(hits AS INT) AS hits, substr(array_to_string(l[pos : pos + 3], chr(10)), 1, 480) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hits DESC, pos) AS k FROM e) WHERE k = 1"
)
def snippet(spark, d):
    top = T.bm25_search(spark, d).where("rank <= 2").select("query_id", F.col("doc").alias("doc_id"))
    return S.snippets(I.read(spark, d, "documents"), top.join(T.queries_of(spark, d), "query_id"))


@query("SELECT conv_id, turn, CASE WHEN regexp_extract(text, '(?m)^#+\\s*(.+)$', 1) <> '' THEN trim(regexp_extract(text, '(?m)^#+\\s*(.+)$', 1)) ELSE role END AS title FROM conversations")
def spec_title(spark, d):
    return I.read(spark, d, "conversations").select("conv_id", "turn", S.spec_title(F.col("text"), F.col("role")).alias("title"))


@query(
    "WITH r AS (SELECT 'f' || (p_partkey % 20) AS path, lower(string_split(p_name, ' ')[1]) AS name, 'def ' || p_name || '()' AS signature, min(CAST(p_partkey AS INT)) AS line FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line, signature) AS nth, count(*) OVER (PARTITION BY path, name) - 2 AS more FROM r), "
    "p AS (SELECT path, name, line, signature, CASE WHEN nth = 2 AND more > 0 THEN more ELSE 0 END AS more, row_number() OVER (PARTITION BY path ORDER BY line, signature) AS place FROM k WHERE nth <= 2) SELECT path, name, line, signature, more FROM p WHERE place <= 20"
)
def signature_collapse(spark, d):
    part = I.read(spark, d, "part")
    rows = part.select(F.expr("'f' || (p_partkey % 20)").alias("path"), F.expr("lower(split(p_name, ' ')[0])").alias("name"), F.col("p_partkey").cast("int").alias("line"), F.concat(F.lit("def "), F.col("p_name"), F.lit("()")).alias("signature"))
    return S.collapsed_signatures(rows)


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT doc_id, list_transform(range(32), lambda i: ('0x' || substr(h, CAST(i * 2 + 1 AS INT), 2))::INT / 255.0::DOUBLE - 0.5) AS v FROM h) SELECT doc_id, CAST(pos - 1 AS INT) AS dim, round(v[pos] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS value FROM r, unnest(range(1, 33)) g(pos)")
def hash_embedding(spark, d):
    rows = S.hash_embeddings(I.read(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    f"WITH {T.QS}, sh AS (SELECT query_id, CASE WHEN len(regexp_split_to_array(trim(query), '\\s+')) >= 4 THEN 'concept' ELSE 'default' END AS plan FROM q), u AS (SELECT query_id, doc, rank, 'bm25' AS source FROM ({T.SQL['bm25_search']}) UNION ALL SELECT query_id, doc, rank, 'embed' FROM ({T.SQL['tfidf_search']})), "
    "f AS (SELECT query_id, doc, round(sum(CASE plan || '/' || source WHEN 'concept/bm25' THEN 2.0 WHEN 'concept/embed' THEN 1.0 WHEN 'default/bm25' THEN 1.5 ELSE 0.6 END::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(source))), '+') AS reason FROM u JOIN sh USING (query_id) GROUP BY ALL) SELECT query_id, doc, score, reason, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 30"
)
def query_first(spark, d):
    q = T.queries_of(spark, d)
    shape = q.select("query_id", F.when(F.size(F.split(F.trim("query"), r"\s+")) >= 4, "concept").otherwise("default").alias("plan"))
    return S.query_first({"bm25": T.bm25_search(spark, d), "embed": T.tfidf_search(spark, d)}, shape)


def _without(name: str, lists: dict[str, float]) -> str:
    """Mean recall of the fusion of some lists, as a CTE of one row."""
    u = " UNION ALL ".join(f"SELECT query_id, doc, {w}::DOUBLE / (60 + rank) AS s FROM l_{n}" for n, w in lists.items())
    return (
        f"fu_{name} AS (SELECT query_id AS case_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (SELECT query_id, doc, round(sum(s), 9) AS score FROM ({u}) GROUP BY ALL)), "
        f"re_{name} AS (SELECT avg(round(coalesce(found / n, 0), 6)) AS v FROM n LEFT JOIN (SELECT case_id, count(*) AS found FROM expected JOIN fu_{name} USING (case_id, doc) WHERE rank <= 5 GROUP BY case_id) USING (case_id))"
    )


_LISTS = {"bm25": 1.5, "tfidf": 1.0, "grep": 0.8}


@query(
    f"WITH {L.CASES}, l_bm25 AS ({T.SQL['bm25_search']}), l_tfidf AS ({T.SQL['tfidf_search']}), l_grep AS ({T.SQL['grep_baseline']}), {_without('all', _LISTS)}, "
    + ", ".join(_without(n, {k: w for k, w in _LISTS.items() if k != n}) for n in _LISTS)
    + " "
    + " UNION ALL ".join(f"SELECT '{n}' AS signal, round((SELECT v FROM re_{n}), 6) AS without, round((SELECT v FROM re_all) - (SELECT v FROM re_{n}), 6) AS loss" for n in _LISTS)
)
def ablation_study(spark, d):
    """Recall of the fusion without each of its lists."""
    lists = {"bm25": (1.5, T.bm25_search(spark, d)), "tfidf": (1.0, T.tfidf_search(spark, d)), "grep": (0.8, T.grep_baseline(spark, d))}
    expected = L.expected_of(spark, d)
    score = lambda names: E.case_metrics(R.rrf([lists[n] for n in names]).withColumnRenamed("query_id", "case_id"), expected)
    return S.ablation({n: score([m for m in lists if m != n]) for n in lists}, score(list(lists)))


PQ = "pq AS (SELECT p_partkey AS query_id, p_name AS query FROM part WHERE p_partkey % 20 = 0)"


@query(
    f"WITH {I.SQL_ITEMS}, {PQ}, ix AS (SELECT DISTINCT item_id AS doc, path, unnest(regexp_split_to_array(lower(path), '[^a-z0-9]+')) AS term FROM items), t AS (SELECT query_id, unnest(list_distinct({T.TERMS.format('query')}[1:16])) AS term FROM pq), h AS (SELECT query_id, doc, path, count(*) AS score FROM ix JOIN t USING (term) WHERE length(term) >= 3 GROUP BY ALL) "
    "SELECT query_id, doc, path, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM h) WHERE rank <= 20"
)
def path_search(spark, d):
    q = I.read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return S.path_hits(I.items(spark, d), q)


@query("WITH s AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN strlen(text) ELSE 0 END) AS BIGINT) AS subset FROM documents GROUP BY source) SELECT source, bytes, subset, round(CASE WHEN bytes > 0 THEN 100.0::DOUBLE * (bytes - subset) / bytes ELSE 0 END, 1) AS saved_pct FROM s")
def token_savings(spark, d):
    size = F.octet_length("text").cast("long")
    rows = I.read(spark, d, "documents").groupBy("source").agg(F.sum(size).alias("bytes"), F.sum(F.when(F.col("doc_id") % 4 == 0, size).otherwise(0)).alias("subset"))
    return rows.withColumn("saved_pct", S.savings(F.col("subset"), F.col("bytes")))


@query(f"WITH {L.EV} SELECT kind, count(*) AS n, round(sum(dwell_seconds), 4) AS dwell FROM fb GROUP BY kind")
def event_log_roundtrip(spark, d):
    """Events written as JSON lines and read again."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    stores.write_events(I.feedback_events(spark, d), folder)
    return stores.read_events(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("dwell_seconds"), 4).alias("dwell"))


@query("SELECT sha256(text) AS key, length(text) AS size FROM documents GROUP BY text")
def payload_cache(spark, d):
    """Payloads stored twice: equal ones are kept once."""
    folder = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    rows = I.read(spark, d, "documents").select(F.col("text").alias("payload"))
    stores.store_payloads(rows, folder)
    stores.store_payloads(rows, folder)
    return spark.read.parquet(folder).select("key", F.length("payload").cast("long").alias("size"))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'ref\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)', 1))) AS ref FROM (SELECT doc_id, 'select * from {{ ref(''m' || (doc_id % 7) || ''') }} join {{ ref(\"n' || (doc_id % 3) || '\") }}' AS text FROM documents)")
def template_refs(spark, d):
    text = F.expr("""concat("select * from {{ ref('m", doc_id % 7, "') }} join {{ ref(\\"n", doc_id % 3, "\\") }}")""")
    return I.read(spark, d, "documents").select("doc_id", F.explode(W.model_refs(text)).alias("ref"))


@query(f"WITH {L.FOLD}, lw AS (SELECT path, ln(least(greatest(used / greatest(total, 1), 0.01), 0.99) / (1 - least(greatest(used / greatest(total, 1), 0.01), 0.99))) AS m, total FROM fold) SELECT path, round(least(0.75, total / (total + 40)) * 10 * m + (1 - least(0.75, total / (total + 40))) * 1.0, 6) AS score FROM lw")
def learned_blend(spark, d):
    folded = B.fold(I.feedback_events(spark, d))
    r = B.rate(F.col("used"), F.col("total"))
    return folded.select("path", F.round(B.blend(F.lit(1.0), F.log(r / (1 - r)), F.col("total")), 6).alias("score"))


@query()
def context(spark, d):
    """The whole answer for ten requests: traversal, boost, diversity, packing."""
    engine = Engine.build(I.items(spark, d), I.baskets(spark, d), I.basket_items(spark, d))
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    return engine.context(seeds, 400, P.token_estimate(F.col("path"), F.col("path")))
