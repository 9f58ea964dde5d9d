"""Globs, subsystems, specs, references, pairs, affected tests, estimates and communities, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import cochange as C
from ..operators import structure as X
from ..operators import tree as W
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
# names of tests in the forms of several languages beside the items
FORMS = ["{0}_test.go", "test_{0}.py", "tests/test_{0}.py", "a/{0}_test.py", "b/{0}.spec.ts", "{0}.test.js", "src/{0}.go", "src/{0}.py", "c/{0}_controller.rb", "c/{0}_service.rb"]
MANY = "many AS (SELECT path FROM items UNION ALL SELECT replace(f, '{0}', 'm' || (item_id // 3)) FROM items, (SELECT unnest([" + ", ".join(f"'{f}'" for f in FORMS) + "]) AS f, unnest(range(10)) AS k) WHERE item_id % 3 = 0)"


def many_files(spark, d):
    it = I.items(spark, d)
    stem = F.concat(F.lit("m"), F.floor(F.col("item_id") / 3).cast("string"))
    named = it.where("item_id % 3 = 0").select(F.explode(F.array(*[F.concat(F.lit(f.split("{0}")[0]), stem, F.lit(f.split("{0}")[1])) for f in FORMS])).alias("path"))
    return it.select("path").union(named)


def many_size(spark, d):
    """About how many files there are."""
    return I.read(spark, d, "part").count() * (3 + len(FORMS)) // 3


BASE = "regexp_extract({}, '([^/]*)$', 1)"
GLOB = "(" + " OR ".join(f"{BASE.format('path')} GLOB '{g}' OR path GLOB '{g}'" for g in W.TEST_GLOBS) + ")"


@query(f"WITH {IT}, {MANY} SELECT path, {GLOB} AS matched FROM many")
def test_globs(spark, d):
    return many_files(spark, d).select("path", W.matches_glob(F.col("path"), W.TEST_GLOBS).alias("matched"))


MANUAL = {"guides": ["docs/**"], "python": ["src/**/*.py"], "settings": ["app/config/*", "**/*.yaml"]}
ROOT = f"CASE WHEN len(string_split(path, '/')) >= 3 AND list_contains([{', '.join(repr(r) for r in W.SUBSYSTEM_ROOTS)}], string_split(path, '/')[1]) THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"


@query(
    f"WITH {IT}, {MANY}, mn AS (SELECT path, CASE WHEN starts_with(path, 'docs') THEN 'guides' END AS a, CASE WHEN starts_with(path, 'src') AND (path GLOB '*/[*].py' OR path LIKE '%/%.py' OR {BASE.format('path')} LIKE '%.py') THEN 'python' END AS b, CASE WHEN path LIKE 'app/config/%' OR path LIKE '%.yaml' THEN 'settings' END AS c FROM many), "
    f"own AS (SELECT path, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS subsystem FROM mn), rest AS (SELECT {ROOT} AS subsystem, path FROM mn WHERE a IS NULL AND b IS NULL AND c IS NULL), tops AS (SELECT subsystem, count(*) AS n FROM rest WHERE subsystem NOT IN ('guides', 'python', 'settings') GROUP BY ALL HAVING count(*) >= 5 ORDER BY n DESC, subsystem LIMIT 40) "
    "SELECT subsystem, 'manual' AS source, path FROM own UNION ALL SELECT subsystem, 'auto', path FROM rest JOIN tops USING (subsystem)"
)
def assigned_subsystems(spark, d):
    """Named globs first, what they leave by its prefix."""
    return W.assigned_subsystems(many_files(spark, d), MANUAL)


SPECS = f"sp AS (SELECT path, item_id % 7 = 0 AS mapped, item_id % 2 = 0 AS tracked, item_id % 5 <> 0 AS present FROM items UNION ALL SELECT 'README.md', false, true, true UNION ALL SELECT 'docs/guide.rst', false, false, true)"
IS_SPEC = f"(regexp_matches(path, '(?i)\\.(md|mdc|txt|rst)$') AND (regexp_matches(path, '^(docs/|doc/|\\.cursor/rules/|\\.github/)') OR {BASE.format('path')} IN ({', '.join(repr(s) for s in W.SPEC_ROOTS)})) OR path IN ({', '.join(repr(s) for s in W.SPEC_ROOTS)}))"


@query(f"WITH {IT}, {SPECS}, r AS (SELECT *, (mapped AND present) OR (tracked AND {IS_SPEC}) AS found FROM sp), k AS (SELECT path, CASE WHEN mapped OR path IN ({', '.join(repr(s) for s in W.SPEC_ROOTS)}) THEN 0 ELSE 1 END AS late FROM r WHERE found OR (NOT (SELECT bool_or(found) FROM r) AND present AND {IS_SPEC})) SELECT path, CAST(place AS INT) AS place FROM (SELECT path, row_number() OVER (ORDER BY late, path) AS place FROM k) WHERE place <= 300")
def discovered_specs(spark, d):
    """Specs of the map and tracked ones, the first three hundred."""
    i = F.col("item_id")
    rows = I.items(spark, d).select("path", (i % 7 == 0).alias("mapped"), (i % 2 == 0).alias("tracked"), (i % 5 != 0).alias("present"))
    more = spark.createDataFrame([("README.md", False, True, True), ("docs/guide.rst", False, False, True)], rows.schema)
    return W.discovered_specs(rows.union(more))


# SQL templates: a model for each part, which refers to others by stem, by suffix and by source
MODEL = "'models/' || CASE WHEN p_partkey % 4 = 0 THEN 'stg__' ELSE '' END || 'm' || p_partkey || '.sql'"
BODY = "'select * from {{ ref(''m' || (p_partkey + 1) || ''') }} join {{ ref(\"M' || (p_partkey + 4) || '\") }} join {{ source(''raw'', ''m' || (p_partkey + 2) || ''') }} -- ref(''m' || (p_partkey + 3) || ''')'"
MODELS = f"models AS (SELECT {MODEL} AS path, {BODY} AS text FROM part)"
REFS = "list_distinct(list_concat(regexp_extract_all(text, '\\{\\{\\s*ref\\s*\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)\\s*\\}\\}', 1), regexp_extract_all(text, '\\{\\{\\s*source\\s*\\(\\s*[''\"][^''\"]+[''\"]\\s*,\\s*[''\"]([^''\"]+)[''\"]\\s*\\)\\s*\\}\\}', 1)))"


def models_of(spark, d):
    key = F.col("p_partkey")
    path = F.concat(F.lit("models/"), F.when(key % 4 == 0, "stg__").otherwise(""), F.lit("m"), key.cast("string"), F.lit(".sql"))
    num = lambda k: (key + k).cast("string")
    text = F.concat(F.lit("select * from {{ ref('m"), num(1), F.lit("') }} join {{ ref(\"M"), num(4), F.lit("\") }} join {{ source('raw', 'm"), num(2), F.lit("') }} -- ref('m"), num(3), F.lit("')"))
    return I.read(spark, d, "part").select(path.alias("path"), text.alias("text"))


@query(
    f"WITH {MODELS}, kn AS (SELECT path AS dst, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem FROM models), keys AS (SELECT dst, stem AS name, 'stem' AS how FROM kn UNION ALL SELECT dst, regexp_extract(stem, '__([^_].*)$', 1), 'suffix' FROM kn WHERE contains(stem, '__')), "
    f"w AS (SELECT path AS src, unnest({REFS}) AS ref FROM models), h AS (SELECT src, ref, dst, how FROM w JOIN keys ON lower(ref) = name WHERE src <> dst) SELECT src, dst, how FROM (SELECT *, row_number() OVER (PARTITION BY src, ref ORDER BY CASE WHEN how = 'stem' THEN 0 ELSE 1 END, dst) AS k FROM h) WHERE k = 1"
)
def model_edges(spark, d):
    return W.model_edges(models_of(spark, d))


@query(f"WITH {MODELS}, s AS (SELECT path, unnest(list_distinct(regexp_extract_all(text, 'ref\\([''\"]([^''\"]+)[''\"]\\)', 1))) AS stem FROM models), k AS (SELECT path AS seed, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM models) SELECT seed, path FROM k JOIN s USING (stem) WHERE seed <> path")
def reverse_models(spark, d):
    models = models_of(spark, d)
    return W.reverse_models(models, models)


@query("SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['src/m' || doc_id || x FOR x IN ['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js']] WHEN doc_id % 3 = 1 THEN ['node_modules/@org' || doc_id, 'node_modules/@org' || doc_id || '/index.ts', 'node_modules/@org' || doc_id || '/index.js', 'packages/org' || doc_id, 'packages/org' || doc_id || '/src/index.ts', 'packages/org' || doc_id || '/src/index.tsx'] ELSE ['node_modules/@o/p' || doc_id, 'node_modules/@o/p' || doc_id || '/index.ts', 'node_modules/@o/p' || doc_id || '/index.js', 'packages/o/p' || doc_id, 'packages/o/p' || doc_id || '/src/index.ts', 'packages/o/p' || doc_id || '/src/index.tsx', 'packages/p' || doc_id || '/src/index.ts', 'libs/p' || doc_id || '/src/index.ts'] END) AS candidate FROM documents")
def import_candidates(spark, d):
    """Relative references two up and down again, scoped ones, and scoped ones with a part."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    ref = F.when(k == 0, F.concat(F.lit("../.././m"), i)).when(k == 1, F.concat(F.lit("@org"), i)).otherwise(F.concat(F.lit("@o/p"), i))
    return I.read(spark, d, "documents").select("doc_id", F.explode(W.import_candidates(ref, F.lit("src/a/b/c.ts"))).alias("candidate"))


def _stem(p: str) -> str:
    return f"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '\\.[^.]*$', '')"


@query(
    f"WITH {IT}, {MANY}, v AS (SELECT path, unnest(list_distinct([" + ", ".join(f"replace('{f}', '{{0}}', st)" for f in W.TWIN_FORMS) + ", " + ", ".join(f"replace('{f}', '{{0}}', replace(replace(replace(st, '_controller', ''), '_service', ''), '_helper', ''))" for f in W.ROLE_FORMS) + f"])) AS stem FROM (SELECT path, {_stem('path')} AS st FROM many)), "
    f"k AS (SELECT path AS twin, {_stem('path')} AS stem FROM many) SELECT path, twin FROM (SELECT path, twin, row_number() OVER (PARTITION BY path ORDER BY twin) AS n FROM v JOIN k USING (stem) WHERE path <> twin) WHERE n <= 10"
)
def naming_variants(spark, d):
    """Files whose stem is a test form or a role form of another's."""
    return W.naming_variants(many_files(spark, d))


STRUCT = f"({T.TEST} OR regexp_matches(path, '(^|/)test_[^/]*$'))"
PAR = "regexp_replace({}, '/?[^/]*$', '')"
TSTEM = f"regexp_replace(regexp_replace(lower({_stem('path')}), '(_test|_spec)$', ''), '^test_', '')"
SUFFIX = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]+)$', 1)"


def _at(folder: str) -> str:
    return f"CASE WHEN {folder} = '' THEN '' ELSE {folder} || '/' END || stem || suffix"


TARGETS = (
    f"ts AS (SELECT path, {TSTEM} AS stem, {SUFFIX} AS suffix FROM many WHERE {STRUCT} OR {GLOB}), tw AS (SELECT path AS test, unnest([{_at(PAR.format('path'))}, {_at(PAR.format(PAR.format('path')))}, 'src/' || stem || suffix]) AS impl, unnest([0, 1, 2]) AS o FROM ts), "
    f"tn AS (SELECT lower({_stem('path')}) AS stem, min(path) AS impl FROM many WHERE NOT {STRUCT} GROUP BY 1), tc AS (SELECT test, o, impl FROM tw WHERE impl IN (SELECT path FROM many) UNION ALL SELECT path, 9, impl FROM ts JOIN tn USING (stem)), "
    "targets AS (SELECT test, impl FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY o, impl) AS k FROM tc WHERE test <> impl) WHERE k = 1)"
)


@query(f"WITH {IT}, {MANY}, {TARGETS} SELECT test, impl FROM targets")
def inferred_tests(spark, d):
    return W.test_targets(many_files(spark, d), size=many_size(spark, d))


# imports between files: every file of many depends on the one after it in order, of a kind by turns
KINDS = "ord AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM (SELECT DISTINCT path FROM many)), dep AS (SELECT a.path AS src, b.path AS dst, ['calls', 'inherits', 'imports', 'tests'][a.n % 4 + 1] AS kind FROM ord a JOIN ord b ON b.n = a.n + 1)"


def depends(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("calls", "inherits", "imports", "tests")]), (F.col("n") % 4).cast("int"))
    rows = X.numbered(many_files(spark, d).distinct(), "path").where("next is not null")
    return rows.select(F.col("path").alias("src"), F.col("next").alias("dst"), kind.alias("kind"))


@query(
    f"WITH RECURSIVE {IT}, {MANY}, {KINDS}, {TARGETS}, ch AS (SELECT DISTINCT path FROM many WHERE contains(path, 'src/m1')), wk AS (SELECT path, 0 AS depth FROM ch UNION SELECT d.src, w.depth + 1 FROM wk w JOIN dep d ON d.dst = w.path WHERE w.depth < 3 AND d.kind <> 'imports'), wm AS (SELECT path, min(depth) AS depth FROM wk GROUP BY path), "
    f"al AS (SELECT path, depth, {STRUCT} OR {GLOB} AS t FROM wm UNION ALL SELECT test, depth, true FROM targets JOIN wm ON wm.path = impl) SELECT path, min(depth) AS depth, bool_or(t) AS is_test FROM al GROUP BY path"
)
def affected_tests(spark, d):
    """What depends on changed files within three hops over the kinds that bind, and the tests that are named after it."""
    files = many_files(spark, d)
    changed = files.where(F.contains("path", F.lit("src/m1"))).distinct()
    return W.affected_tests(files, depends(spark, d), changed, size=many_size(spark, d))


@query(
    f"WITH {I.SQL_EDGES}, {IT}, r AS (SELECT r AS request_id, r * 7 + 1 AS seed FROM range(10) a(r)), c AS (SELECT request_id, seed, dst, weight FROM r JOIN sym ON src = seed), pr AS (SELECT request_id, j.path AS path, weight, i.path AS pa FROM c JOIN items i ON i.item_id = seed JOIN items j ON j.item_id = dst) "
    f"SELECT request_id, path, round((len(string_split(path, '/')) - 1 + len(string_split(pa, '/')) - 1 - 2 * {T._shared('path', 'pa')}) * weight, 6) AS surprise FROM pr"
)
def surprise(spark, d):
    """How far from its seed a neighbour lies, by its weight."""
    seeds = spark.range(10).select(F.col("id").alias("request_id"), (F.col("id") * 7 + 1).alias("item_id"))
    it = I.items(spark, d)
    near = C.neighbours(G.edges_of(spark, d), seeds, 0.0).join(it, "item_id").select("request_id", "path", "weight")
    return W.surprise(near, seeds.join(it, "item_id").select("request_id", F.col("path").alias("seed")))


@query("WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 3), s AS (SELECT list(doc_id ORDER BY doc_id)[1:8] AS sample, count(*) AS pending FROM p) SELECT pending, sample, CASE WHEN pending > 0 THEN pending || ' file(s) edited since the last index: ' || array_to_string(sample, ', ') || CASE WHEN pending > len(sample) THEN ', ... (+' || (pending - len(sample)) || ' more)' ELSE '' END ELSE '' END AS banner FROM s")
def staleness(spark, d):
    now = I.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("signature"))
    old = now.where("path % 10 <> 0").withColumn("signature", F.when(F.col("path") % 7 == 3, "old").otherwise(F.col("signature")))
    return W.staleness(old, now)


EST = (
    "e AS (SELECT v, v * 1700 AS commits, v % 13 * 900 + v // 20 * 5000 AS files FROM (SELECT unnest(range(80)) AS v)), f AS (SELECT *, greatest(commits, 1)::DOUBLE AS c, greatest(files, 50)::DOUBLE AS f FROM e), "
    "a AS (SELECT *, CASE WHEN c > 30000 OR f > 25000 THEN [100000, 40000, 37877.0, 1200.0]::DOUBLE[] WHEN c < 8000 AND f < 6000 THEN [5000, 3500, 17.0, 24.0]::DOUBLE[] ELSE [5150, 10500, 792.0, 289.0]::DOUBLE[] END AS k FROM f), s AS (SELECT *, pow(c / k[1], 0.85::DOUBLE) * pow(f / k[2], 0.55::DOUBLE) AS scale, abs(log10(c / k[1])) + abs(log10(f / k[2])) * 0.5::DOUBLE AS far FROM a), "
    "m AS (SELECT *, k[3] * scale < 2.0 AS tiny, k[3] * scale AS s0, k[4] * pow(scale, 0.92::DOUBLE) AS m0, least(0.45::DOUBLE, 0.12::DOUBLE + far * 0.08::DOUBLE) AS spread FROM s), n AS (SELECT *, CASE WHEN tiny THEN greatest(0.5::DOUBLE, c * 0.015::DOUBLE + f * 0.08::DOUBLE) ELSE s0 END AS sec, CASE WHEN tiny THEN greatest(0.5::DOUBLE, f * 0.006::DOUBLE + c * 0.001::DOUBLE) ELSE m0 END AS mb FROM m)"
)


@query(
    f"WITH {EST} SELECT v, round(sec * (1 - spread), 1) AS seconds_low, round(sec, 1) AS seconds_mid, round(sec * (1 + spread), 1) AS seconds_high, round(mb * (1 - spread * 0.7::DOUBLE), 1) AS mb_low, round(mb, 1) AS mb_mid, round(mb * (1 + spread * 0.7::DOUBLE), 1) AS mb_high, CASE WHEN commits = 0 OR files = 0 THEN 'low' WHEN far > 0.6 THEN 'medium' ELSE 'high' END AS confidence FROM n"
)
def build_estimate(spark, d):
    v = F.col("id")
    est = W.build_estimate(v * 1700, v % 13 * 900 + F.floor(v / 20) * 5000)
    return spark.range(80).select(v.alias("v"), *[c.alias(n) for n, c in est.items()])


@query("WITH v AS (SELECT unnest(range(200)) AS v) SELECT v, CASE WHEN v * 47.3::DOUBLE < 90 THEN printf('%.0fs', v * 47.3::DOUBLE) WHEN v * 47.3::DOUBLE < 7200 THEN printf('%.1f min', v * 47.3::DOUBLE / 60) ELSE printf('%.1f h', v * 47.3::DOUBLE / 3600) END AS duration, CASE WHEN v * 10.7::DOUBLE < 1 THEN '<1 MB' WHEN v * 10.7::DOUBLE < 1024 THEN printf('~%.0f MB', v * 10.7::DOUBLE) ELSE printf('~%.1f GB', v * 10.7::DOUBLE / 1024) END AS size FROM v")
def human_sizes(spark, d):
    v = F.col("id")
    return spark.range(200).select(v.alias("v"), W.human_duration(v * F.lit(47.3)).alias("duration"), W.human_size(v * F.lit(10.7)).alias("size"))


@query(f"WITH {I.SQL_EDGES}, {IT}, {T.DEG} SELECT item_id, path, degree FROM items JOIN deg USING (item_id) ORDER BY degree DESC, path LIMIT 1")
def hub_seed(spark, d):
    return W.hub_seed(C.degrees(G.edges_of(spark, d)).select("item_id", "degree"), I.items(spark, d))


@query()
def modularity_communities(spark, d):
    """Communities by modularity over strong edges, those above fifty split again."""
    return W.modularity_communities(G.edges_of(spark, d), min_weight=0.9)


@query(f"WITH {IT}, c AS (SELECT count(*) AS items, count(DISTINCT {ROOT}) AS groups, count(*) FILTER (WHERE {T.TEST}) AS tests FROM items) SELECT * FROM c")
def build_inputs(spark, d):
    """What a build would take in: files, their groups, tests."""
    p = F.col("path")
    return I.items(spark, d).agg(F.count("*").alias("items"), F.count_distinct(W.root_prefix(p)).alias("groups"), F.count(F.when(P.is_test(p), 1)).alias("tests"))


@query(f"WITH {IT} SELECT path, twin FROM (SELECT a.path, b.path AS twin, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS k FROM items a JOIN items b ON {PAR.format('a.path')} = {PAR.format('b.path')} AND a.item_id <> b.item_id) WHERE k = 1")
def first_sibling(spark, d):
    it = I.items(spark, d)
    rows = X.siblings(it, 1)
    names = it.select(F.col("item_id").alias("sibling"), F.col("path").alias("twin"))
    return rows.join(it, "item_id").join(names, "sibling").select("path", "twin")
