"""Identifier, symbol and dispatched search, retriever lists and payload compression, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import paths as P
from ..operators import cochange as C
from ..operators import payload as Y
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators import semantic as M
from ..session import checkpointed, sorted_side
from ..sources import inputs as I
from . import code_queries as N
from . import graph_queries as G
from . import retrieval_queries as T
from . import selection_queries as L

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


WORDS = "regexp_extract_all({}, '[a-zA-Z][\\p{{L}}\\p{{N}}_]{{2,}}')"
CAMEL = "string_split(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g'), '_')"
USEFUL = f"list_filter(list_transform(flatten(list_transform({{}}, lambda w: {CAMEL})), lambda p: lower(p)), lambda p: length(p) >= 3 AND NOT list_contains({sql_list(M.STOP_WORDS)}, p))"


def idents(text: str) -> str:
    words = WORDS.format(text)
    return f"list_concat({USEFUL.format(words)}, list_transform({words}, lambda w: lower(w)))"


def expand(q: str) -> str:
    words = f"list_transform({WORDS.format(q)}, lambda w: lower(w))"
    return f"list_distinct(list_concat({USEFUL.format(words)}, {words}))"


CODE = f"code AS (SELECT {I.PATH} AS path, {N.CODE_SQL} AS text, p_partkey FROM part)"


@query(f"WITH {CODE}, t AS (SELECT path, unnest({idents('text')}) AS term FROM code) SELECT path, term, count(*) AS tf FROM t GROUP BY ALL")
def identifier_terms(spark, d):
    return M.identifier_postings(N.code_files(spark, d), "path").select(F.col("doc").alias("path"), "term", "tf")


def _identifier_sql(docs: str, key: str, queries: str, k: int) -> str:
    return (
        f"dt AS (SELECT {key} AS doc, {idents('text')} AS t FROM {docs}), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
        f"n AS (SELECT count(*) AS n FROM dt WHERE len(t) > 0), qx AS (SELECT query_id, unnest({expand('query')}) AS term FROM {queries}), sc AS (SELECT query_id, doc, round(sum(tf * ln(n::DOUBLE / df)), 6) AS score FROM qx JOIN p USING (term) JOIN df USING (term), n GROUP BY ALL), "
        f"ids AS (SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"
    )


@query(f"WITH {T.QS}, {_identifier_sql('documents', 'doc_id', 'q', 20)} SELECT * FROM ids")
def identifier_search(spark, d):
    return M.identifier_search(I.read(spark, d, "documents"), T.queries_of(spark, d))


# queries by symbol and path: the name of every twentieth part, and a few fixed ones
NAMED = ["main", "run_17", "un_1", "class", "xyzzy", "def run_3 main", "RUN_20 other"]
NQ = "nq AS (SELECT p_partkey AS query_id, p_name AS query FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT -1 - i, q FROM (SELECT unnest(range({})) AS i, unnest({}) AS q))".format(len(NAMED), sql_list(NAMED))
SYMS = f"syms AS (SELECT {I.PATH} AS path, {N.CAPITALS} AS symbol, 'class' AS kind, 2 AS line FROM part UNION ALL SELECT {I.PATH}, 'run_' || p_partkey, 'function', 3 FROM part UNION ALL SELECT {I.PATH}, 'main', 'function', 6 FROM part)"


def named_queries(spark, d):
    q = I.read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return q.union(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(NAMED)], "query_id long, query string"))


TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
SYMBOL_SQL = (
    f"sr AS (SELECT path, symbol, line, list_concat({TOK.format('symbol')}, {TOK.format('kind')}) AS w FROM syms), sz AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM sr), "
    "sq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(" + WORDS.format("lower(query)") + "[1:16]) AS term FROM nq) GROUP BY ALL), "
    f"sh AS (SELECT path, symbol, line, len(w) AS dl, term, (length(' ' || array_to_string(w, ' ') || ' ') - length(replace(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string({TOK.format('term')}, ' ') || ' ', ' '))) / (length(array_to_string({TOK.format('term')}, ' ')) + 1) AS tf "
    f"FROM sr JOIN (SELECT DISTINCT term FROM sq) t ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string({TOK.format('term')}, ' ') || ' ')), sdf AS (SELECT term, count(*) AS df FROM sh GROUP BY term), "
    "sfound AS (SELECT query_id, path, symbol, line, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM sh JOIN sdf USING (term) JOIN sq USING (term), sz GROUP BY ALL), "
    "sfew AS (SELECT query_id, unnest(" + WORDS.format("query") + "[1:4]) AS term FROM nq WHERE query_id NOT IN (SELECT query_id FROM sfound)), "
    "spart AS (SELECT query_id, path, symbol, min(line) AS line, max(CASE WHEN symbol = term THEN 10.0 ELSE 5.0 END)::DOUBLE AS score FROM sfew JOIN syms ON contains(lower(symbol), lower(term)) GROUP BY ALL), "
    "sall AS (SELECT query_id, path, symbol, line, score FROM sfound UNION ALL SELECT query_id, path, symbol, line, score FROM spart), "
    "srank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(symbol), symbol, path, line) AS rank FROM sall)"
)


def symbol_table(spark, d):
    return K.symbols(N.code_files(spark, d)).select("path", "symbol", "kind", "line")


@query(f"WITH {SYMS}, {NQ}, {SYMBOL_SQL} SELECT query_id, path, symbol, line, score, CAST(rank AS INT) AS rank FROM srank WHERE rank <= 20")
def symbol_bm25(spark, d):
    return R.by_text(named_queries(spark, d), lambda q: M.symbol_bm25(symbol_table(spark, d), q))


PATH_SQL = (
    f"ix AS (SELECT DISTINCT path, unnest(regexp_split_to_array(lower(path), '[^a-z0-9]+')) AS term FROM items), pt AS (SELECT query_id, unnest(list_distinct({T.TERMS.format('query')}[1:16])) AS term FROM nq), ph AS (SELECT query_id, path, count(*) AS score FROM ix JOIN pt USING (term) WHERE length(term) >= 3 GROUP BY ALL), "
    "prank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM ph)"
)
K_CAP = 15
CAND = (
    f"cand AS (SELECT query_id, doc, min(place) AS place FROM (SELECT query_id, path AS doc, rank AS place FROM prank WHERE rank <= {3 * K_CAP} UNION ALL SELECT query_id, path, 1000 + rank FROM srank WHERE rank <= {2 * K_CAP}) GROUP BY ALL), "
    f"near AS (SELECT query_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, doc) AS k FROM cand) WHERE k <= {4 * K_CAP}), ct AS (SELECT path AS doc, {idents('text')} AS t FROM code), "
    f"cr AS (SELECT query_id, doc, t, {expand('query')} AS q FROM near JOIN ct USING (doc) JOIN nq USING (query_id) WHERE len(t) > 0), cn AS (SELECT query_id, count(*) AS n FROM cr GROUP BY ALL), "
    "ctf AS (SELECT query_id, doc, term, count(*) AS tf FROM (SELECT query_id, doc, unnest(list_filter(t, lambda x: list_contains(q, x))) AS term FROM cr) GROUP BY ALL), cdf AS (SELECT query_id, term, count(*) AS df FROM ctf GROUP BY ALL), "
    "csc AS (SELECT query_id, doc, round(sum(tf * ln(n::DOUBLE / df)), 6) AS score FROM ctf JOIN cdf USING (query_id, term) JOIN cn USING (query_id) GROUP BY ALL), "
    f"capped AS (SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM csc WHERE score > 0) WHERE rank <= {K_CAP})"
)


def path_list(spark, d, q, k):
    return S.path_hits(I.items(spark, d), q, k)


def candidates(spark, d, q):
    paths = path_list(spark, d, q, 3 * K_CAP).select("query_id", F.col("path").alias("doc"), F.col("rank").alias("place"))
    syms = M.symbol_bm25(symbol_table(spark, d), q, k=2 * K_CAP).select("query_id", F.col("path").alias("doc"), (F.col("rank") + 1000).alias("place"))
    return paths.union(syms).groupBy("query_id", "doc").agg(F.min("place").alias("place"))


@query(f"WITH {SYMS}, {NQ}, {I.SQL_ITEMS}, {CODE}, {SYMBOL_SQL}, {PATH_SQL}, {CAND} SELECT * FROM capped")
def capped_tfidf(spark, d):
    return R.by_text(named_queries(spark, d), lambda q: M.capped_tfidf(N.code_files(spark, d), candidates(spark, d, q), q, k=K_CAP))


CODE_BM25 = (
    f"cpost AS (SELECT path AS doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT path, len(ts) AS dl, unnest(ts) AS term FROM (SELECT path, {T.TERMS.format('text')} AS ts FROM code)) GROUP BY ALL), cbn AS (SELECT count(*) AS n, avg(len({T.TERMS.format('text')})) AS avgdl FROM code), cbd AS (SELECT term, count(*) AS df FROM cpost GROUP BY term), "
    f"cqt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({T.TERMS.format('query')}[1:16]) AS term FROM nq) GROUP BY ALL), "
    "cbs AS (SELECT query_id, doc, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM cqt JOIN cpost USING (term) JOIN cbd USING (term), cbn GROUP BY ALL), "
    "cbm AS (SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM cbs) WHERE rank <= 30)"
)


def code_bm25(spark, d, q, k=30):
    return R.bm25_of(N.code_files(spark, d), q, key="path", k=k)


MODE = "mode AS (SELECT query_id, query_id % 3 <> 0 AS prefer_bm25, query_id % 2 = 0 AS large_graph FROM nq)"


@query(
    f"WITH {SYMS}, {NQ}, {I.SQL_ITEMS}, {CODE}, {SYMBOL_SQL}, {PATH_SQL}, {CAND}, {CODE_BM25}, {_identifier_sql('code', 'path', 'nq', 15)}, {MODE}, use AS (SELECT query_id, CASE WHEN prefer_bm25 AND query_id IN (SELECT query_id FROM cbm) THEN 'bm25' WHEN large_graph THEN 'tfidf_capped' ELSE 'tfidf_full' END AS backend, prefer_bm25 AND query_id NOT IN (SELECT query_id FROM cbm) AS bm25_empty_fallback FROM mode), "
    "al AS (SELECT *, 'bm25' AS backend FROM cbm UNION ALL SELECT *, 'tfidf_capped' FROM capped UNION ALL SELECT *, 'tfidf_full' FROM ids) SELECT query_id, backend, bm25_empty_fallback, doc, score, rank FROM use JOIN al USING (query_id, backend)"
)
def semantic_dispatch(spark, d):
    """Every query by the way its request allows: here two of three prefer BM25, and every other is on a large graph."""
    q = named_queries(spark, d)
    mode = q.select("query_id", (F.col("query_id") % 3 != 0).alias("prefer_bm25"), (F.col("query_id") % 2 == 0).alias("large_graph"))
    full = R.by_text(q, lambda t: M.identifier_search(N.code_files(spark, d), t, key="path", k=15))
    return M.dispatched(mode, R.by_text(q, lambda t: code_bm25(spark, d, t)), capped_tfidf(spark, d), full)


@query("WITH f AS (SELECT v, CASE WHEN v % 5 = 0 THEN ' ' ELSE 'query' END AS query, v % 2 = 0 AS hf, v % 3 = 0 AS lg, v % 4 = 0 AS qo FROM (SELECT unnest(range(60)) AS v)) SELECT v, NOT hf AND NOT lg AS seed_hybrid, trim(query) <> '' AND NOT hf AND (NOT lg OR qo) AS semantic, CASE WHEN lg AND qo THEN 10 ELSE 15 END AS top_n, lg AND qo AS prefer_bm25 FROM f")
def search_policy(spark, d):
    v = F.col("v")
    q = F.when(v % 5 == 0, " ").otherwise("query")
    return spark.range(60).withColumnRenamed("id", "v").select("v", *[c.alias(n) for n, c in M.search_policy(q, v % 2 == 0, v % 3 == 0, v % 4 == 0).items()])


NOISE = f"({T.TEST.replace('path', 'doc')} OR regexp_matches(doc, '^(docs_src/|docs/|scripts/)'))"


def clean_sql(name: str, rows: str, k: int = 30) -> str:
    return (
        f"{name}0 AS ({rows}), {name} AS (SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, bool_or(NOT {NOISE}) OVER (PARTITION BY query_id) AS anyclean FROM {name}0) WHERE NOT anyclean OR NOT {NOISE}) WHERE rank <= {k})"
    )


LISTS = ", ".join([
    clean_sql("lp", "SELECT query_id, path AS doc, score::DOUBLE AS score, rank FROM prank WHERE rank <= 30"),
    clean_sql("ls", "SELECT query_id, path AS doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT query_id, path, max(score) AS score FROM srank WHERE rank <= 30 GROUP BY ALL)"),
    clean_sql("lb", "SELECT * FROM cbm"),
])


def lists_of(spark, d, q):
    """The path, symbol and text lists of each query, noise taken out."""
    paths = path_list(spark, d, q, 30).select("query_id", F.col("path").alias("doc"), F.col("score").cast("double").alias("score"), "rank")
    syms = M.symbol_bm25(symbol_table(spark, d), q, k=30).select("query_id", F.col("path").alias("doc"), "score")
    return {"path": M.without_noise(paths), "symbol": M.without_noise(M.max_merged(syms, ["query_id", "doc"], 30)), "bm25": M.without_noise(code_bm25(spark, d, q))}


@query(f"WITH {SYMS}, {NQ}, {I.SQL_ITEMS}, {CODE}, {SYMBOL_SQL}, {PATH_SQL}, {CODE_BM25}, {LISTS} SELECT 'path' AS source, * FROM lp UNION ALL SELECT 'symbol', * FROM ls UNION ALL SELECT 'bm25', * FROM lb")
def retriever_lists(spark, d):
    def search(q):
        parts = [df.select(F.lit(n).alias("source"), "query_id", "doc", "score", "rank") for n, df in lists_of(spark, d, q).items()]
        return parts[0].union(parts[1]).union(parts[2])

    return R.by_text(named_queries(spark, d), search)


VECTOR = "list_transform(range(32), lambda i: ('0x' || substr(sha256({0}), CAST(i * 2 + 1 AS INT), 2))::INT / 255.0::DOUBLE - 0.5)"
FIVE = (
    f"ev AS (SELECT path, {VECTOR.format('path')} AS v FROM items), eq AS (SELECT query_id, {VECTOR.format('query')} AS v FROM nq), em AS (SELECT query_id, path AS doc, round(list_dot_product(ev.v, eq.v) / (sqrt(list_dot_product(ev.v, ev.v)) * sqrt(list_dot_product(eq.v, eq.v))), 6) AS score FROM ev, eq), "
    "le AS (SELECT query_id, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM em) WHERE rank <= 30), "
    "co AS (SELECT query_id, path AS doc, max(weight) AS score FROM nq JOIN sym ON src IN (query_id, query_id - 1) JOIN items ON item_id = dst GROUP BY ALL), lc AS (SELECT query_id, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM co) WHERE rank <= 30)"
)


def cochange_list(spark, d):
    """Neighbours of the two items up to the query's number, the best weight over both."""
    seeds = named_queries(spark, d).select(F.col("query_id").alias("request_id"), F.explode(F.array("query_id", F.col("query_id") - 1)).alias("item_id"))
    near = C.neighbours(G.edges_of(spark, d), seeds, 0.0).join(sorted_side(I.items(spark, d)), "item_id")
    near = near.select(F.col("request_id").alias("query_id"), F.col("path").alias("doc"), F.col("weight").alias("score"))
    return M.max_merged(near, ["query_id", "doc"], 30).withColumn("score", F.round("score", 6))


@query(f"WITH {I.SQL_EDGES}, {I.SQL_ITEMS}, {NQ}, {FIVE} SELECT * FROM lc")
def neighbour_pool(spark, d):
    return cochange_list(spark, d)


def embed_list(spark, d, q):
    q = S.hash_embeddings(q, "query_id", "query")
    v = S.hash_embeddings(I.items(spark, d), "path", "path").withColumnRenamed("path", "vec_id")
    return R.vector_topk(v, q, 30).withColumnRenamed("vec_id", "doc")


SHAPE = f"CASE WHEN len(list_filter({WORDS.format('query')}, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 OR (len({WORDS.format('query')}) = 1 AND contains(coalesce({WORDS.format('query')}[1], ''), '_')) THEN 'symbol_like' WHEN len(regexp_split_to_array(trim(query), '\\s+')) >= 4 OR regexp_matches(lower(query), '{P.CONCEPT_HINTS}') THEN 'concept' ELSE 'default' END"
WEIGHT = "CASE plan || '/' || source " + " ".join(f"WHEN '{p}/{s}' THEN {w}" for p, ws in S.PLANS.items() for s, w in ws.items()) + " END::DOUBLE"


@query(
    f"WITH {I.SQL_EDGES}, {I.SQL_ITEMS}, {SYMS}, {NQ}, {CODE}, {SYMBOL_SQL}, {PATH_SQL}, {CODE_BM25}, {LISTS}, {FIVE}, sh2 AS (SELECT query_id, {SHAPE} AS plan FROM nq), "
    "u AS (SELECT query_id, doc, rank, 'path' AS source FROM lp UNION ALL SELECT query_id, doc, rank, 'symbol' FROM ls UNION ALL SELECT query_id, doc, rank, 'bm25' FROM lb UNION ALL SELECT query_id, doc, rank, 'embed' FROM le UNION ALL SELECT query_id, doc, rank, 'co_change' FROM lc), "
    f"f AS (SELECT query_id, doc, round(sum({WEIGHT} / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(source))), '+') AS reason FROM u JOIN sh2 USING (query_id) GROUP BY ALL) "
    "SELECT query_id, doc, score, reason, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 50"
)
def five_list_retrieval(spark, d):
    """Paths by all five lists under the plan of each query's shape."""
    q = F.col("query")
    shape = named_queries(spark, d).select("query_id", F.when(P.looks_like_symbol(q), "symbol_like").when(P.is_concept(q), "concept").otherwise("default").alias("plan"))
    names = ["path", "symbol", "bm25", "embed"]

    def search(q):
        lists = lists_of(spark, d, q) | {"embed": embed_list(spark, d, q)}
        return reduce(DataFrame.union, [lists[n].select("query_id", "doc", "rank", F.lit(n).alias("source")) for n in names])

    found = checkpointed(R.by_text(named_queries(spark, d), search))  # read once a list
    lists = {n: found.where(F.col("source") == n).select("query_id", "doc", "rank") for n in names}
    return S.query_first(lists | {"co_change": cochange_list(spark, d)}, shape, limit=50)


# --- payloads -------------------------------------------------------------------------------------
# conversations as entries: the text is the content, the role is asked for
ENTRY = "entry AS (SELECT conv_id, turn, conv_id || '/' || turn AS path, text AS content, CASE turn % 3 WHEN 0 THEN 'how is ' || role || ' done' WHEN 1 THEN '' ELSE split_part(text, ' ', 2) || ' the class' END AS query, CASE turn % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.8 WHEN 2 THEN -0.8 ELSE -0.3 END::DOUBLE AS bias FROM conversations)"


def entries(spark, d):
    t = F.col("turn")
    query = F.when(t % 3 == 0, F.concat(F.lit("how is "), "role", F.lit(" done"))).when(t % 3 == 1, "").otherwise(F.concat(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" the class")))
    bias = F.when(t % 4 == 0, 0.0).when(t % 4 == 1, 0.8).when(t % 4 == 2, -0.8).otherwise(-0.3)
    return I.read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content"), query.alias("query"), bias.alias("bias"))


YTERMS = f"list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2 AND NOT list_contains({sql_list(Y.STOP_WORDS)}, t)))"


@query(f"WITH {ENTRY} SELECT conv_id, turn, list_sort({YTERMS}) AS terms FROM entry")
def payload_terms(spark, d):
    return entries(spark, d).select("conv_id", "turn", F.sort_array(Y.query_terms(F.col("query"))).alias("terms"))


KEEP = Y.KEEP_LINE.replace("'", "''")
COMMENT = Y.COMMENT.replace("'", "''")


def body_sql(rows: str, aggressive: bool) -> str:
    """Rows with content, terms and bias -> short, by line rows."""
    return f"""bl AS (SELECT * EXCLUDE (lines), lines, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM (SELECT *, string_split(content, chr(10)) AS lines, {'true' if aggressive else 'false'} OR bias < -0.5 AS hard FROM {rows})),
bs AS (SELECT *, 2 * len(list_filter(terms, lambda t: contains(lower(line), t))) + CASE WHEN regexp_matches(line, '{KEEP}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(line, '{COMMENT}') THEN 1 ELSE 0 END + CASE WHEN bias > 0 THEN CAST(round_even(bias * 2, 0) AS INT) WHEN bias < 0 THEN -CAST(round_even(abs(bias), 0) AS INT) ELSE 0 END AS s FROM bl),
br AS (SELECT *, CASE WHEN s > 0 THEN row_number() OVER (PARTITION BY path ORDER BY CASE WHEN s > 0 THEN 0 ELSE 1 END, s DESC, i) END AS r, least(greatest(4, CAST(floor(n * least(0.9, greatest(0.2, CASE WHEN hard THEN 0.35 ELSE 0.55 END::DOUBLE + bias * 0.12))) AS INT)), {30 if aggressive else 50}) AS most FROM bs),
bk AS (SELECT *, i = 0 OR (i = 1 AND trim(line) <> '') OR coalesce(r <= most, false) OR ({'true' if aggressive else 'false'} AND s >= 5) AS keep FROM br),
bg AS (SELECT path, any_value(content) AS content, any_value(n) AS n, any_value(terms) AS terms, any_value(bias) AS bias, any_value(lines) AS lines, count(*) FILTER (keep) AS k, count(r) AS positive, string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS kept FROM bk GROUP BY path),
body AS (SELECT path, CASE WHEN trim(content) = '' OR n <= 3 THEN content WHEN positive = 0 AND len(terms) = 0 THEN array_to_string(lines[1 : CAST(floor({25 if aggressive else 40} * (1 + greatest(0.0, bias) * 0.25)) AS INT)], chr(10)) WHEN k >= n THEN content ELSE kept || chr(10) || '{Y.CUT}' END AS short FROM bg)"""


# bodies of many lines: sentences of documents as lines
DOCLINES = f"dl AS (SELECT doc_id AS path, replace(text, '. ', '.' || chr(10)) AS content, split_part(text, ' ', 3) || ' return class' AS query, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.8 WHEN 2 THEN -0.8 ELSE -0.3 END::DOUBLE AS bias FROM documents), dlt AS (SELECT *, {YTERMS} AS terms FROM dl)"


def doc_lines(spark, d):
    p = F.col("doc_id")
    bias = F.when(p % 4 == 0, 0.0).when(p % 4 == 1, 0.8).when(p % 4 == 2, -0.8).otherwise(-0.3)
    query = F.concat(F.split_part("text", F.lit(" "), F.lit(3)), F.lit(" return class"))
    return I.read(spark, d, "documents").select(p.alias("path"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n")).alias("content"), query.alias("query"), bias.alias("bias"))


@query(f"WITH {DOCLINES}, {body_sql('dlt', False)} SELECT path, short AS body FROM body")
def payload_prune(spark, d):
    rows = doc_lines(spark, d)
    return rows.select("path", Y.pruned_body(F.col("content"), Y.query_terms(F.col("query")), bias=F.col("bias")).alias("body"))


@query(f"WITH {DOCLINES}, {body_sql('dlt', True)} SELECT path, short AS body FROM body")
def payload_prune_hard(spark, d):
    rows = doc_lines(spark, d)
    return rows.select("path", Y.pruned_body(F.col("content"), Y.query_terms(F.col("query")), bias=F.col("bias"), aggressive=True).alias("body"))


SENT = "regexp_split_to_array(trim(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g')), chr(1))"


@query(f"WITH {DOCLINES}, s AS (SELECT path, terms, {SENT} AS parts FROM (SELECT * REPLACE (trim(content) AS content) FROM dlt)), k AS (SELECT path, parts, list_concat(parts[1:1], list_filter(parts[2:], lambda x: len(list_filter(terms, lambda t: contains(lower(x), t))) > 0)) AS kept FROM s) SELECT path, array_to_string(CASE WHEN len(kept) < len(parts) THEN list_append(kept, '…') ELSE kept END, ' ') AS summary FROM k")
def payload_summary(spark, d):
    return doc_lines(spark, d).select("path", Y.pruned_summary(F.col("content"), Y.query_terms(F.col("query"))).alias("summary"))


# chunks: the lines of a document's text, named by their first word
CHUNKS = f"ch AS (SELECT path, terms, bias, i AS position, split_part(line, ' ', 1) AS name, line AS body FROM (SELECT *, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM dlt))"


def doc_chunks(spark, d):
    rows = doc_lines(spark, d)
    return rows.select("path", "query", "bias", F.posexplode(F.split("content", "\n")).alias("position", "body")).withColumn("name", F.split_part("body", F.lit(" "), F.lit(1)))


@query(
    f"WITH {DOCLINES}, {CHUNKS}, sc AS (SELECT *, 3 * len(list_filter(terms, lambda t: contains(lower(name || ' ' || body), t))) + CASE WHEN contains(lower(name), 'class') OR contains(lower(substr(body, 1, 80)), 'def ') THEN 2 ELSE 0 END AS score FROM ch), "
    "pl AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, position) AS place, max(score) OVER (PARTITION BY path) AS best FROM sc) SELECT path, name, CAST(place AS INT) AS place, CAST(score AS INT) AS score, body FROM pl WHERE place <= CASE WHEN bias < -0.5 THEN 2 ELSE 4 END + CASE WHEN bias > 0.5 THEN 1 ELSE 0 END AND (score > 0 OR best = 0)"
)
def payload_chunks(spark, d):
    return Y.pruned_chunks(doc_chunks(spark, d)).select("path", "name", "place", F.col("score").cast("int").alias("score"), "body")


@query(
    f"WITH {DOCLINES}, {CHUNKS}, q AS (SELECT path, query, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '')) AS words FROM dlt), sc AS (SELECT path, position, name, CAST(10 * len(list_filter(words, lambda t: contains(lower(name || ' ' || body), t))) + CASE WHEN lower(name) = 'the' THEN 15 ELSE 0 END + CASE WHEN contains(lower(body), 'class') THEN 3 ELSE 0 END AS INT) AS score FROM ch JOIN q USING (path)), "
    "pl AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, position) AS place, max(score) OVER (PARTITION BY path) AS best FROM sc) SELECT path, name, score, CAST(place AS INT) AS place FROM pl WHERE place <= 5 AND (score > 0 OR best = 0)"
)
def relevant_chunks(spark, d):
    """Chunks by the words asked for; here every query imports the name 'the', in either case of its first letter."""
    rows = doc_chunks(spark, d).withColumn("signature", F.col("body"))
    names = rows.select("query").distinct().select("query", F.explode(F.array(*[F.lit(n) for n in ("the", "The", "THE", "tHe", "thE", "THe", "tHE", "ThE")])).alias("name"))
    return Y.relevant_chunks(rows, names).select("path", "name", F.col("score").cast("int").alias("score"), "place")


@query(
    f"WITH {ENTRY}, et AS (SELECT *, {YTERMS} AS terms FROM entry), {body_sql('et', False)}, js AS (SELECT e.conv_id AS request_id, e.path, content, short, to_json(struct_pack(path := e.path, content := content)) AS was, strlen(to_json(struct_pack(path := e.path, content := content))) // 4 AS tb, strlen(to_json(struct_pack(path := e.path, content := short))) // 4 AS ta FROM et e JOIN body b ON b.path = e.path), "
    "per AS (SELECT request_id, CAST(sum(tb) AS BIGINT) AS tokens_before, CAST(sum(ta) AS BIGINT) AS tokens_after FROM js GROUP BY ALL) SELECT request_id, path, CASE WHEN tokens_after < tokens_before THEN short ELSE content END AS content, tokens_before, tokens_after, CASE WHEN tokens_after < tokens_before THEN round(1 - tokens_after / tokens_before, 4) ELSE 0 END AS saved, tokens_after < tokens_before AS applied FROM js JOIN per USING (request_id)"
)
def payload_compress(spark, d):
    rows = entries(spark, d).withColumnRenamed("conv_id", "request_id")
    return Y.compressed(rows).drop("content_hash")


@query("WITH s AS (SELECT v, v % 37 * 10 AS graph, v % 11 * 7 AS comp, v * 100 AS corpus FROM (SELECT unnest(range(120)) AS v)) SELECT v, CASE WHEN graph > 0 THEN round(1 - comp / graph, 4) ELSE 0 END AS savings_ratio, CASE WHEN comp > 0 THEN round(graph / comp, 2) ELSE 0 END AS vs_graph, CASE WHEN corpus > 0 AND comp > 0 THEN round(corpus / comp, 2) ELSE 0 END AS vs_corpus FROM s")
def compression_stack(spark, d):
    v = F.col("id")
    return spark.range(120).select(v.alias("v"), *[c.alias(n) for n, c in Y.stack_row(v % 37 * 10, v % 11 * 7, v * 100).items()])


@query("WITH s AS (SELECT conv_id, strlen(text) AS graph_tokens, CASE WHEN turn % 3 <> 0 THEN strlen(text) // 2 END AS c, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN strlen(text) // 3 END AS l, turn % 5 AS vs, turn % 7 / 7.0::DOUBLE AS sv FROM conversations) SELECT count(*) AS cases, round(coalesce(avg(graph_tokens), 0), 2) AS graph_tokens, round(coalesce(avg(coalesce(c, l)), 0), 2) AS compressed_tokens, round(coalesce(avg(vs), 0), 2) AS vs_graph, round(coalesce(avg(sv), 0), 2) AS savings_ratio FROM s WHERE coalesce(c, l) IS NOT NULL")
def stack_means(spark, d):
    """Means over compressed rows; some rows have their figure under the older name."""
    size, t = F.octet_length("text"), F.col("turn")
    rows = I.read(spark, d, "conversations").select(
        size.alias("graph_tokens"), F.when(t % 3 != 0, F.floor(size / 2)).alias("compressed_tokens"), F.when((t % 3 == 0) & (t % 2 == 0), F.floor(size / 3)).alias("legacy_tokens"), (t % 5).alias("vs_graph"), (t % 7 / 7.0).alias("savings_ratio")
    )
    return Y.stack_means(rows)
