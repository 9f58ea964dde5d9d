"""Structure, extraction and upkeep queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import paths as P
from ..operators import cochange as C
from ..operators import retrieval as R
from ..operators import structure as X
from ..session import sorted_side
from ..sources import inputs as I
from . import graph_queries as G
from . import retrieval_queries as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IT = I.SQL_ITEMS
MIRROR = f"regexp_replace(regexp_replace(lower({T.STEM}), '(_spec|_test|\\.spec|\\.test)$', ''), '^test_', '')"
PREFIX = "CASE WHEN len(string_split(path, '/')) >= 3 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] ELSE '.' END"

# A source line for each item, so that the extractors have code to read; the same text in both engines.
CODE = "'import ' || replace(lower(p_name), ' ', '_') || chr(10) || 'class ' || replace(initcap(p_name), ' ', '') || ':' || chr(10) || '    def run_' || p_partkey || '(self):' || chr(10) || '        return ' || p_size || chr(10) || chr(10) || 'def main():' || chr(10) || '    pass'"

CAPITALS = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '')"
CODE_SQL = CODE.replace("replace(initcap(p_name), ' ', '')", CAPITALS)


def code_files(spark, d):
    part = I.read(spark, d, "part")
    return part.select(F.expr(I.PATH).alias("path"), F.expr(CODE).alias("text"), "p_partkey")


LINES = f"src AS (SELECT {I.PATH} AS path, 'import ' || replace(lower(p_name), ' ', '_') AS l1, 'class ' || {CAPITALS} || ':' AS l2, '    def run_' || p_partkey || '(self):' AS l3, '        return ' || p_size AS l4, {CAPITALS} AS cls, 'run_' || p_partkey AS fn FROM part)"


@query(f"WITH {LINES} SELECT path, cls AS symbol, 'class' AS kind, 2 AS line, NULL AS container FROM src UNION ALL SELECT path, fn, 'function', 3, cls FROM src UNION ALL SELECT path, 'main', 'function', 6, cls FROM src")
def symbols(spark, d):
    return K.symbols(code_files(spark, d))


@query(f"WITH {LINES} SELECT path, cls AS name, 2 AS first, 5 AS last, l2 || chr(10) || l3 || chr(10) || l4 || chr(10) AS body FROM src UNION ALL SELECT path, fn, 3, 5, l3 || chr(10) || l4 || chr(10) FROM src UNION ALL SELECT path, 'main', 6, 7, 'def main():' || chr(10) || '    pass' FROM src")
def chunks(spark, d):
    return K.chunks(code_files(spark, d))


@query(
    f"WITH {LINES}, b AS (SELECT path, [l1, l2, l3, l4, '', 'def main():', '    pass'] AS ls FROM src), s AS (SELECT path, i, ls[i] AS line, 2 * (CASE WHEN contains(lower(ls[i]), 'run') THEN 1 ELSE 0 END + CASE WHEN contains(lower(ls[i]), 'return') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(ls[i], '\\b(def|class|return|raise|import|func|fn|function|interface|struct)\\b') THEN 3 ELSE 0 END AS s FROM b, unnest(range(1, 8)) g(i)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, i) AS r FROM s) SELECT path, string_agg(line, chr(10) ORDER BY i) AS body FROM k WHERE r <= 4 OR i <= 2 GROUP BY path"
)
def prune_body(spark, d):
    return K.pruned_bodies(code_files(spark, d), ["run", "return"])


@query(f"WITH {IT} SELECT path, replace(lower(p_name), ' ', '_') AS ref FROM items JOIN part ON p_partkey = item_id")
def extract_imports(spark, d):
    return code_files(spark, d).select("path", F.explode(K.imports(F.col("text"))).alias("ref"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_type, ' ', ''), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def snake_case(spark, d):
    return I.read(spark, d, "part").select("p_partkey", K.snake_case(F.replace(F.col("p_type"), F.lit(" "), F.lit(""))).alias("snake"))


TWIN = "'spec/' || regexp_extract(regexp_replace(path, '\\.[^./]*$', ''), '([^/]*)$', 1) || '_spec.py'"


@query(f"WITH {IT}, files AS (SELECT path FROM items UNION ALL SELECT {TWIN} FROM items WHERE item_id % 4 = 3), m AS (SELECT path, {MIRROR} AS mirror, {T.TEST} OR regexp_matches(path, '(^|/)test_[^/]*$') AS t FROM files) SELECT test, impl FROM (SELECT a.path AS test, b.path AS impl, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS k FROM m a JOIN m b ON a.mirror = b.mirror WHERE a.t AND NOT b.t) WHERE k <= 10")
def naming_pairs(spark, d):
    """Items and, for every fourth, a test file named after it."""
    it = I.items(spark, d)
    twins = it.where("item_id % 4 = 3").select(F.concat(F.lit("spec/"), P.stem(F.col("path")), F.lit("_spec.py")).alias("path"))
    return X.paired_tests(it.select("path").union(twins))


@query(f"WITH {IT}, f AS (SELECT path AS dst, regexp_extract(regexp_replace(path, '\\.[^./]*$', ''), '([^/]*)$', 1) AS stem FROM items), r AS (SELECT i.path AS src, regexp_extract(regexp_replace(j.path, '\\.[^./]*$', ''), '([^/]*)$', 1) AS ref FROM items i JOIN items j ON j.item_id = i.item_id + 3), h AS (SELECT src, dst, row_number() OVER (PARTITION BY src, ref ORDER BY length(dst), dst) AS k FROM r JOIN f ON ref = stem WHERE src <> dst) SELECT DISTINCT src, dst FROM h WHERE k = 1")
def resolve_imports(spark, d):
    """Every item imports the item three on by the stem of its path."""
    it = I.items(spark, d)
    refs = it.select((F.col("item_id") + 3).alias("item_id"), F.col("path").alias("src")).join(sorted_side(it), "item_id").select(F.col("src").alias("path"), P.stem(F.col("path")).alias("ref"))
    return X.resolve_imports(refs, it)


@query(f"WITH {IT}, {I.SQL_BASKET_ITEMS}, t AS (SELECT DISTINCT basket_id, {PREFIX} AS subsystem, regexp_matches(path, '\\.md$') AS is_spec FROM basket_items JOIN items USING (item_id)), p AS (SELECT basket_id, subsystem, bool_or(NOT is_spec) AS code, bool_or(is_spec) AS spec FROM t GROUP BY ALL) SELECT subsystem, count(*) AS drifting FROM p WHERE code AND NOT spec GROUP BY subsystem")
def spec_drift(spark, d):
    touched = I.basket_items(spark, d).join(I.items(spark, d), "item_id").select("basket_id", P.auto_prefix(F.col("path")).alias("subsystem"), F.col("path").endswith(".md").alias("is_spec"))
    return X.drift(touched)


@query(f"WITH {I.SQL_EDGES}, {IT}, {T.DEG}, r AS (SELECT {PREFIX} AS subsystem, path, degree FROM items JOIN deg USING (item_id) WHERE degree > 0) SELECT subsystem, path, degree, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subsystem ORDER BY degree DESC, path) AS rank FROM r) WHERE rank <= 5")
def subsystem_hubs(spark, d):
    return X.subsystem_summary(I.items(spark, d), C.degrees(G.edges_of(spark, d)).select("item_id", "degree"))


RULES = [(1, None, "src/", None, None), (2, "endpoint", None, None, None), (3, None, None, None, 100), (4, "docs", "docs/", None, None), (5, None, None, "brass", None), (6, "docs", "sr", None, None)]


@query(f"WITH {I.SQL_EDGES}, {IT}, {T.DEG}, rules AS (SELECT * FROM (VALUES (1, NULL, 'src/', NULL, NULL), (2, 'endpoint', NULL, NULL, NULL), (3, NULL, NULL, NULL, 100), (4, 'docs', 'docs/', NULL, NULL), (5, NULL, NULL, 'brass', NULL), (6, 'docs', 'sr', NULL, NULL)) v(rule_id, rule_intent, path_prefix, path_contains, degree_gte)), rq AS (SELECT item_id AS request_id, path, degree, CASE item_id % 2 WHEN 0 THEN 'docs' ELSE 'endpoint' END AS intent FROM items JOIN deg USING (item_id)) SELECT request_id, rule_id, CAST(nth AS INT) AS nth FROM (SELECT request_id, rule_id, row_number() OVER (PARTITION BY request_id ORDER BY rule_id) AS nth FROM rq JOIN rules ON (rule_intent IS NULL OR rule_intent = intent) AND (path_prefix IS NULL OR path = rtrim(path_prefix, '/') OR starts_with(path, rtrim(path_prefix, '/') || '/')) AND (path_contains IS NULL OR contains(path, path_contains)) AND (degree_gte IS NULL OR degree >= degree_gte)) WHERE nth <= 5")
def routing_hints(spark, d):
    rq = I.items(spark, d).join(C.degrees(G.edges_of(spark, d)).select("item_id", "degree"), "item_id")
    rq = rq.select(F.col("item_id").alias("request_id"), "path", "degree", F.when(F.col("item_id") % 2 == 0, "docs").otherwise("endpoint").alias("intent"))
    return X.routing_hints(rq, spark.createDataFrame(RULES, "rule_id int, rule_intent string, path_prefix string, path_contains string, degree_gte int"))


@query("SELECT doc_id AS path, md5(text) AS signature FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 3")
def pending_index(spark, d):
    """The stored state lacks every tenth document and has an old signature for others."""
    now = I.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("signature"))
    old = now.where("path % 10 <> 0").withColumn("signature", F.when(F.col("path") % 7 == 3, "old").otherwise(F.col("signature")))
    return X.changed_since(old, now)


@query(f"WITH u AS (SELECT item_id AS path, 0 AS source_order, 'a' AS source FROM (SELECT p_partkey AS item_id FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT p_partkey, 1, 'b' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 2, 'c' FROM part WHERE p_partkey % 5 = 0) SELECT path, source, source_order FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source_order) AS k FROM u) WHERE k = 1")
def unified_merge(spark, d):
    ids = I.read(spark, d, "part").select(F.col("p_partkey").alias("path"))
    return R.first_wins([ids.where(f"path % {m} = 0").withColumn("source", F.lit(s)) for m, s in ((2, "a"), (3, "b"), (5, "c"))], ["path"])


@query(f"WITH {I.SQL_EDGES}, {T.DEG}, {IT}, ch AS (SELECT item_id FROM items WHERE item_id <= 20), hit AS (SELECT dst AS item_id, max(weight) AS w FROM sym JOIN ch ON src = item_id WHERE weight >= 0.8 GROUP BY dst), al AS (SELECT item_id, 0 AS depth, 0.0 AS w FROM ch UNION ALL SELECT item_id, 1, w FROM hit WHERE item_id NOT IN (SELECT item_id FROM ch)) SELECT item_id, depth, degree, degree >= 500 AS hub FROM al LEFT JOIN deg USING (item_id)")
def detect_changes(spark, d):
    """What one hop from changed items reaches, with its degree and whether it is a hub."""
    edges = G.edges_of(spark, d)
    seeds = I.items(spark, d).where("item_id <= 20").select(F.lit(0).cast("long").alias("request_id"), "item_id")
    hit = G.G.blast_radius(edges, seeds, min_weight=0.8, max_depth=1, max_results=1_000_000)
    rows = hit.join(C.degrees(edges).select("item_id", "degree"), "item_id", "left")
    return rows.select("item_id", "depth", "degree", (F.col("degree") >= 500).alias("hub"))
