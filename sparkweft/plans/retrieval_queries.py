"""Path, scoring, text and vector queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import cochange as C
from ..operators import retrieval as R
from ..operators import structure as X
from ..sources import inputs as I
from .graph_queries import edges_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IT = I.SQL_ITEMS
TEST = "regexp_matches(path, '(?i)(^|/)(spec|test|tests|__tests__)/|_(spec|test)\\.|\\.(spec|test)\\.')"
CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in P.CLASS_RULES) + " ELSE 'source' END"
QS = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = "regexp_extract_all(lower({}), '[a-zA-Z][\\p{{L}}\\p{{N}}_]{{2,}}')"


def queries_of(spark, d):
    """Each benchmark text is a query."""
    return I.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {IT} SELECT item_id, path, {CLASS} AS kind FROM items")
def file_class(spark, d):
    return I.items(spark, d).withColumn("kind", P.file_class(F.col("path")))


@query(f"WITH {IT} SELECT item_id, path FROM items WHERE NOT ({TEST} OR regexp_matches(path, '^(docs_src/|docs/|scripts/)'))")
def noise_filter(spark, d):
    return I.items(spark, d).where(~P.is_noise(F.col("path")))


@query(f"WITH {IT} SELECT item_id, {TEST} AS ranking_test, {TEST} OR regexp_matches(path, '(^|/)test_[^/]*$') AS structural_test, regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|target|\\.venv|venv|Pods|\\.next|__pycache__|\\.git)(/|$)') OR path LIKE 'db/migrations/s%' OR path LIKE '%.yaml' AS excluded FROM items")
def path_predicates(spark, d):
    p = F.col("path")
    return I.items(spark, d).select("item_id", P.is_test(p).alias("ranking_test"), P.is_structural_test(p).alias("structural_test"), P.excluded(p, patterns=["db/migrations/s*", "*.yaml"]).alias("excluded"))


def _intent(q: str) -> str:
    n = {k: f"len(list_intersect(list_distinct(regexp_split_to_array(trim(lower({q})), '\\s+')), [{', '.join(repr(t) for t in v)}]))" for k, v in P.INTENT_TERMS.items()}
    most = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN contains(lower({q}), 'openapi') OR contains(lower({q}), 'swagger') THEN 'openapi' WHEN {most} = 0 THEN 'default' " + " ".join(f"WHEN {v} = {most} THEN '{k}'" for k, v in n.items()) + " END"


SAMPLE = ["user API endpoint", "How does routing work here", "fix_bug", "FastAPI", "migrate db table", "swagger docs", "test mock coverage", "", "readme guide", "parse tokens"]
SAMPLE_SQL = f"s AS (SELECT unnest(range({len(SAMPLE)})) AS query_id, unnest([" + ", ".join(f"'{x}'" for x in SAMPLE) + "]) AS query)"


def sample_queries(spark):
    return spark.createDataFrame(list(enumerate(SAMPLE)), "query_id long, query string")


ALL_Q = f"{SAMPLE_SQL}, {QS}, allq AS (SELECT * FROM s UNION ALL SELECT query_id + 100, query FROM q)"


def all_queries(spark, d):
    return sample_queries(spark).union(queries_of(spark, d).select((F.col("query_id") + 100).alias("query_id"), "query"))


@query(
    f"WITH {ALL_Q}, t AS (SELECT *, regexp_extract_all(query, '[a-zA-Z][\\p{{L}}\\p{{N}}_]{{2,}}') AS terms, regexp_split_to_array(trim(query), '\\s+') AS words FROM allq) SELECT query_id, {_intent('query')} AS intent, "
    "len(list_filter(terms, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 OR (len(terms) = 1 AND contains(coalesce(terms[1], ''), '_')) AS symbol_like, "
    f"len(words) >= 4 OR regexp_matches(lower(query), '{P.CONCEPT_HINTS}') AS concept, len(list_intersect(regexp_split_to_array(trim(lower(query)), '\\s+'), [{', '.join(repr(t) for t in P.TEST_TERMS)}])) > 0 AS test_focused, "
    "CASE WHEN trim(query) = '' THEN 25 WHEN len(terms) <= 2 AND length(trim(query)) < 48 THEN 25 WHEN len(terms) >= 5 OR length(trim(query)) >= 80 THEN 75 ELSE 50 END AS cap FROM t"
)
def query_shape(spark, d):
    q = F.col("query")
    return all_queries(spark, d).select("query_id", P.query_intent(q).alias("intent"), P.looks_like_symbol(q).alias("symbol_like"), P.is_concept(q).alias("concept"), P.is_test_focused(q).alias("test_focused"), P.adaptive_cap(q, F.lit(False)).alias("cap"))


PARENT = "regexp_replace(path, '/?[^/]*$', '')"
STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')"


@query(f"WITH {IT}, k AS (SELECT regexp_replace(regexp_replace(lower({STEM}), '(_spec|_test|\\.spec|\\.test)$', ''), '^test_', '') AS mirror, {TEST} AS t FROM items) SELECT mirror, bool_or(t) AS has_test, bool_or(NOT t) AS has_non_test, count(*) AS n FROM k GROUP BY mirror")
def mirror_groups(spark, d):
    p = F.col("path")
    rows = I.items(spark, d).select(P.mirror_key(p).alias("mirror"), P.is_test(p).alias("t"))
    return rows.groupBy("mirror").agg(F.bool_or("t").alias("has_test"), F.bool_or(~F.col("t")).alias("has_non_test"), F.count("*").alias("n"))


@query(
    f"WITH {IT}, pre AS (SELECT path, CASE WHEN len(string_split(path, '/')) >= 3 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] ELSE '.' END AS prefix FROM items) "
    "SELECT prefix, count(*) AS n, min(path) AS first_path FROM pre GROUP BY prefix HAVING count(*) >= 5 ORDER BY n DESC, prefix LIMIT 40"
)
def auto_subsystems(spark, d):
    pre = I.items(spark, d).withColumn("prefix", P.auto_prefix(F.col("path")))
    return pre.groupBy("prefix").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n >= 5").orderBy(F.desc("n"), "prefix").limit(40)


@query(f"WITH {IT}, p AS (SELECT item_id, path, {PARENT} AS dir FROM items) SELECT item_id, sib AS sibling, CAST(k AS INT) AS k FROM (SELECT a.item_id, b.item_id AS sib, row_number() OVER (PARTITION BY a.item_id ORDER BY b.path) AS k FROM p a JOIN p b ON a.dir = b.dir AND a.item_id <> b.item_id) WHERE k <= 10")
def dir_siblings(spark, d):
    """The first ten other paths of the directory of each item."""
    return X.siblings(I.items(spark, d))


def _shared(a: str, b: str) -> str:
    x, y = f"string_split(regexp_replace({a}, '/?[^/]*$', ''), '/')", f"string_split(regexp_replace({b}, '/?[^/]*$', ''), '/')"
    return f"(SELECT coalesce(min(i) - 1, least(len({x}), len({y}))) FROM range(1, least(len({x}), len({y})) + 1) g(i) WHERE {x}[i] <> {y}[i] OR {x}[i] = '')"


@query(
    f"WITH {IT}, pr AS (SELECT a.item_id AS a, b.item_id AS b, a.path AS pa, b.path AS pb FROM items a JOIN items b ON b.item_id BETWEEN a.item_id + 1 AND a.item_id + 5), sh AS (SELECT *, {_shared('pa', 'pb')} AS shared, len(string_split(pa, '/')) - 1 AS da, len(string_split(pb, '/')) - 1 AS db FROM pr) "
    "SELECT a, b, CAST(shared AS INT) AS shared, CASE WHEN shared = 0 THEN 1.0 WHEN da - shared <= 0 THEN 3.0 WHEN da - shared = 1 THEN 1.8 ELSE 1.3 END::DOUBLE AS locality, CAST(da + db - 2 * shared AS INT) AS distance FROM sh"
)
def locality(spark, d):
    """Locality and directory distance of each item to the next five."""
    it = I.items(spark, d)
    a = it.select(F.col("item_id").alias("a"), F.col("path").alias("pa"), F.explode(F.sequence(F.col("item_id") + 1, F.col("item_id") + 5)).alias("b"))
    pr = a.join(it.select(F.col("item_id").alias("b"), F.col("path").alias("pb")), "b")
    x, y = F.col("pa"), F.col("pb")
    return pr.select("a", "b", P.shared_dirs(x, y).alias("shared"), P.locality(x, y).alias("locality"), P.dir_distance(x, y).alias("distance"))


@query(f"WITH {IT} SELECT item_id, greatest(1, CASE WHEN path LIKE '%.py' THEN floor(strlen(path) * 0.28) WHEN path LIKE '%.rb' THEN floor(strlen(path) * 0.27) WHEN path LIKE '%.js' THEN floor(strlen(path) * 0.28) WHEN path LIKE '%.md' THEN floor(strlen(path) * 0.25) WHEN path LIKE '%.yaml' THEN floor(strlen(path) * 0.31) ELSE floor(strlen(path) / 4) END)::BIGINT AS tokens FROM items")
def token_estimate(spark, d):
    return I.items(spark, d).select("item_id", P.token_estimate(F.col("path"), F.col("path")).alias("tokens"))


# --- text -----------------------------------------------------------------------------------------
POST = f"post AS (SELECT doc_id AS doc, t.term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT doc_id, {TERMS.format('text')} AS ts FROM documents)) t GROUP BY doc_id, t.term)"
QT = f"{QS}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TERMS.format('query')}[1:16]) AS term FROM q) GROUP BY ALL)"


QA = f"{QS}, qa AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM q))"


@query(f"WITH {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def doc_frequency(spark, d):
    return R.postings(I.read(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    f"WITH {POST}, {QT}, n AS (SELECT count(*) AS n, avg(len({TERMS.format('text')})) AS avgdl FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    "sc AS (SELECT query_id, doc, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term), n GROUP BY ALL) "
    "SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 20"
)
def bm25_search(spark, d):
    docs, q = I.read(spark, d, "documents"), queries_of(spark, d)
    return R.bm25_of(docs, q)


@query(
    f"WITH {POST}, {QA}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), sc AS (SELECT query_id, doc, round(sum(tf * ln(n::DOUBLE / df)), 6) AS score FROM qa JOIN post USING (term) JOIN df USING (term), n GROUP BY ALL) "
    "SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0) WHERE rank <= 20"
)
def tfidf_search(spark, d):
    docs, q = I.read(spark, d, "documents"), queries_of(spark, d)
    return R.tfidf_search(docs, q)


@query(f"WITH {POST}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), sc AS (SELECT doc, term, round(tf * ln(n::DOUBLE / df), 6) AS score FROM post JOIN df USING (term), n) SELECT doc, term, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rank FROM sc) WHERE rank <= 10")
def doc_keywords(spark, d):
    return R.keywords(I.read(spark, d, "documents"))


@query(
    f"WITH {QS}, t AS (SELECT query_id, unnest(list_distinct({TERMS.format('query')}[1:12])) AS term FROM q), sc AS (SELECT query_id, doc_id AS doc, CAST(sum((length(text) - length(replace(lower(text), term, ''))) // length(term)) AS BIGINT) AS score FROM documents, t WHERE contains(lower(text), term) GROUP BY ALL) "
    "SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 3"
)
def grep_baseline(spark, d):
    return R.grep_baseline(I.read(spark, d, "documents"), queries_of(spark, d))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1][1:120] AS summary FROM documents")
def doc_summary(spark, d):
    first = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 0)
    return I.read(spark, d, "documents").select("doc_id", F.substring(first, 1, 120).alias("summary"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '***REDACTED***', 'g'), '(?i)(api|secret)_?key[\"'']?\\s*[:=]\\s*[\"''][^\"'']+[\"'']', '***REDACTED***', 'g') AS redacted FROM documents")
def redact(spark, d):
    return I.read(spark, d, "documents").select("doc_id", P.redact(F.col("text")).alias("redacted"))


# --- vectors, fusion, selection ---------------------------------------------------------------------
COS = "round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
VEC = f"vk AS (SELECT q.vec_id AS query_id, v.vec_id, {COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)"


@query(f"WITH {VEC} SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vk) WHERE rank <= 10")
def vector_topk(spark, d):
    v = I.read(spark, d, "embeddings")
    return R.vector_topk(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(
    f"WITH b AS ({SQL['bm25_search'].replace('WITH ', 'WITH ', 1)}), t AS ({SQL['tfidf_search']}), g AS ({SQL['grep_baseline']}), u AS (SELECT query_id, doc, 1.5 / (60 + rank) AS s FROM b UNION ALL SELECT query_id, doc, 1.0 / (60 + rank) FROM t UNION ALL SELECT query_id, doc, 0.8 / (60 + rank) FROM g), "
    "f AS (SELECT query_id, doc, round(sum(s::DOUBLE), 9) AS score FROM u GROUP BY ALL) SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 50"
)
def rrf_fusion(spark, d):
    return R.rrf([(1.5, bm25_search(spark, d)), (1.0, tfidf_search(spark, d)), (0.8, grep_baseline(spark, d))])


DEG = "deg AS (SELECT src AS item_id, count(*) AS degree, sum(weight) AS total FROM sym GROUP BY src)"


@query(f"WITH {I.SQL_EDGES}, {DEG} SELECT item_id, degree, round(greatest(1, log2(2 + greatest(degree - 80, 0))), 6) AS penalty, round(0.1 * log2(2 + degree), 6) AS tiebreak FROM deg")
def hub_penalty(spark, d):
    g = F.col("degree")
    return C.degrees(edges_of(spark, d)).select("item_id", "degree", F.round(P.hub_penalty(g), 6).alias("penalty"), F.round(P.tie_break(g), 6).alias("tiebreak"))


RANKED = f"""{I.SQL_EDGES}, {IT}, {DEG}, c AS (SELECT r.request_id, i.item_id, i.path, s.weight, {CLASS} AS kind, {TEST} AS is_test, coalesce(d.degree, 0) AS degree
 FROM (SELECT r AS request_id, r * 7 + 1 AS seed FROM range(10) a(r)) r JOIN sym s ON s.src = r.seed JOIN items i ON i.item_id = s.dst LEFT JOIN deg d ON d.item_id = i.item_id),
sc AS (SELECT *, round((weight * CASE WHEN is_test OR regexp_matches(path, '^(docs_src/|docs/|scripts/)') THEN 0.05 ELSE 1.0 END
  * CASE kind WHEN 'generated' THEN 0.01 WHEN 'fixture' THEN 0.1 WHEN 'doc' THEN 0.5 ELSE 1.0 END) / greatest(1, log2(2 + greatest(degree - 80, 0))) - 0.1 * log2(2 + degree), 6) AS score FROM c),
rk AS (SELECT request_id, item_id, path, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) AS rank FROM sc)"""


def ranked_candidates(spark, d):
    """Neighbours of one seed a request, scored: class and noise factors, hub penalty, tie-break."""
    edges = edges_of(spark, d)
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    rows = C.neighbours(edges, seeds, 0.0).join(I.items(spark, d), "item_id").join(C.degrees(edges).select("item_id", "degree"), "item_id", "left")
    p, g = F.col("path"), F.coalesce("degree", F.lit(0))
    score = F.col("weight") * F.when(P.is_noise(p), 0.05).otherwise(1.0) * P.file_class_weight(P.file_class(p), F.lit("default"), p) / P.hub_penalty(g) - P.tie_break(g)
    rows = rows.select("request_id", "item_id", "path", F.round(score, 6).alias("score"))
    return R.ranked(rows, "request_id", [F.desc("score"), F.col("path")], 1_000_000)


@query(f"WITH {RANKED} SELECT request_id, item_id, path, score, CAST(rank AS INT) AS rank FROM rk")
def rank_scores(spark, d):
    return ranked_candidates(spark, d)


@query(f"WITH {RANKED}, u AS (SELECT request_id, item_id, CAST(rank AS INT) AS rank, CAST(sum(strlen(path)) OVER (PARTITION BY request_id ORDER BY rank) AS BIGINT) AS used FROM rk) SELECT * FROM u WHERE used <= 600")
def budget_pack(spark, d):
    rows = ranked_candidates(spark, d).withColumn("tokens", F.octet_length("path"))
    return R.budget_pack(rows, "request_id", "tokens", 600).select("request_id", "item_id", "rank", "used")


@query(f"WITH {RANKED}, k AS (SELECT *, rank <= 10 OR regexp_matches(path, 'src/') AS keep FROM rk), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY keep DESC, rank) AS place FROM k) SELECT request_id, item_id, path, score, CAST(rank AS INT) AS rank FROM p WHERE keep OR place <= 3")
def summary_prune(spark, d):
    return R.summary_prune(ranked_candidates(spark, d), F.col("path").rlike("src/"))


@query()
def mmr_select(spark, d):
    rows = ranked_candidates(spark, d).where("rank <= 60").withColumn("relevance", F.col("score"))
    return R.mmr(rows)


@query("WITH r AS (SELECT v % 2 = 0 AS sparse, v % 3 = 0 AS truncated, v % 5 = 0 AS query_only, v % 4 AS hits, v % 7 AS files, v FROM (SELECT unnest(range(200)) AS v)), s AS (SELECT v, greatest(0, 1.0::DOUBLE - CASE WHEN sparse THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN truncated THEN 0.28::DOUBLE ELSE 0 END - CASE WHEN query_only AND hits = 0 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN files < 2 THEN 0.1::DOUBLE ELSE 0 END) AS score FROM r) SELECT v, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s")
def confidence(spark, d):
    v = F.col("v")
    s = P.confidence(v % 2 == 0, v % 3 == 0, v % 5 == 0, v % 4, v % 7)
    return spark.range(200).withColumnRenamed("id", "v").select("v", F.round(s, 6).alias("score"), P.confidence_level(s).alias("level"))
