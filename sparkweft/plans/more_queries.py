"""Symbol search, inheritance and route edges, reasons and gates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import paths as P
from ..operators import retrieval as R
from ..sources import inputs as I
from . import code_queries as N
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


SYM = f"syms AS (SELECT {I.PATH} AS path, 'run_' || p_partkey AS symbol, 'function' AS kind FROM part UNION ALL SELECT {I.PATH}, 'main', 'function' FROM part)"


@query(f"WITH {SYM}, q AS (SELECT * FROM (VALUES (1, 'main'), (2, 'run_17'), (3, 'un_1')) v(query_id, query)), h AS (SELECT query_id, path, symbol, CASE WHEN symbol = query THEN 10 ELSE 5 END AS score FROM syms JOIN q ON contains(symbol, query)) SELECT query_id, path, symbol, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(symbol), symbol, path) AS rank FROM h) WHERE rank <= 20")
def symbol_search(spark, d):
    """Functions whose name holds the query: whole names first, then the shortest."""
    q = spark.createDataFrame([(1, "main"), (2, "run_17"), (3, "un_1")], "query_id int, query string")
    syms = K.symbols(N.code_files(spark, d)).where("kind = 'function'").select("path", "symbol")
    hit = syms.join(F.broadcast(q), F.expr("contains(symbol, query)"))
    hit = hit.withColumn("score", F.when(F.col("symbol") == F.col("query"), 10).otherwise(5))
    return R.ranked(hit, "query_id", [F.desc("score"), F.length("symbol"), F.col("symbol"), F.col("path")], 20).select("query_id", "path", "symbol", "score", "rank")


@query(f"WITH {I.SQL_ITEMS}, st AS (SELECT item_id, path, {T.STEM} AS stem FROM items), c AS (SELECT item_id, path, 'class X(' || {T.STEM} || '):' AS text FROM items) SELECT c.path AS src, st.path AS dst, 'inherits' AS kind FROM c JOIN st ON st.stem = regexp_extract(c.text, 'class\\s+[A-Za-z0-9_]+\\(([A-Za-z0-9_]+)\\)', 1) WHERE c.item_id >= 0")
def inherits_edges(spark, d):
    """Class headers name their parent; the parent is the file of that stem."""
    it = I.items(spark, d)
    text = F.concat(F.lit("class X("), P.stem(F.col("path")), F.lit("):"))
    parents = it.select(F.col("path").alias("src"), F.regexp_extract(text, r"class\s+[A-Za-z0-9_]+\(([A-Za-z0-9_]+)\)", 1).alias("stem"))
    return parents.join(it.select(F.col("path").alias("dst"), P.stem(F.col("path")).alias("stem")), "stem").select("src", "dst", F.lit("inherits").alias("kind"))


@query(f"WITH {G.LINKS} SELECT src, dst, 'route' AS kind FROM links WHERE regexp_matches(dst, '/[a-z]+') AND src IN (SELECT url FROM pages WHERE contains(html, '<a '))")
def route_edges(spark, d):
    """Links of pages that hold a marker."""
    marked = I.read(spark, d, "pages").where(F.contains("html", F.lit("<a "))).select(F.col("url").alias("src")).distinct()
    links = I.page_links(spark, d).distinct().where(F.col("dst").rlike("/[a-z]+"))
    return links.join(marked, "src", "left_semi").withColumn("kind", F.lit("route"))


@query(f"WITH {I.SQL_ITEMS} SELECT item_id, CASE WHEN regexp_matches(lower(path), '(^|/)(agents|claude)\\.md$') THEN 'agents' WHEN regexp_matches(lower(path), '(^|/)rules/') THEN 'rule' WHEN regexp_matches(lower(path), '\\.(md|rst)$') THEN 'doc' END AS spec_kind FROM items")
def spec_kind(spark, d):
    low = F.lower("path")
    kind = F.when(low.rlike(r"(^|/)(agents|claude)\.md$"), "agents").when(low.rlike("(^|/)rules/"), "rule").when(low.rlike(r"\.(md|rst)$"), "doc")
    return I.items(spark, d).select("item_id", kind.alias("spec_kind"))


REASON = "array_to_string(list_filter(['co-change', CASE WHEN kind <> 'source' THEN 'class ' || kind END, CASE WHEN degree >= 80 THEN 'hub' END], lambda x: x IS NOT NULL), ' + ')"


@query(f"WITH {T.RANKED} SELECT sc.request_id, sc.item_id, {REASON} AS reason, CASE WHEN is_test THEN 'run' WHEN degree >= 80 THEN 'narrow' ELSE 'read' END AS next_step FROM sc")
def pick_reasons(spark, d):
    deg = G.C.degrees(G.edges_of(spark, d)).select("item_id", "degree")
    rows = T.ranked_candidates(spark, d).join(deg, "item_id")
    kind, hub = P.file_class(F.col("path")), F.col("degree") >= 80
    reason = F.concat_ws(" + ", F.lit("co-change"), F.when(kind != "source", F.concat(F.lit("class "), kind)), F.when(hub, "hub"))
    step = F.when(P.is_test(F.col("path")), "run").when(hub, "narrow").otherwise("read")
    return rows.select("request_id", "item_id", reason.alias("reason"), step.alias("next_step"))


@query(f"WITH {L.EV}, t AS (SELECT quantile_disc(ts, 0.8) AS cut FROM fb), tr AS (SELECT path, avg(u) AS r FROM (SELECT *, {L.USED} AS u FROM fb) x, t WHERE ts <= cut AND u IS NOT NULL GROUP BY path), ho AS (SELECT path, u FROM (SELECT *, {L.USED} AS u FROM fb) x, t WHERE ts > cut AND u IS NOT NULL), s AS (SELECT avg(CASE WHEN coalesce(r, 0.5) >= 0.5 THEN u ELSE 1 - u END) AS learned, greatest(avg(u), 1 - avg(u)) AS prior, count(*) AS n FROM ho LEFT JOIN tr USING (path)) SELECT n, round(learned, 6) AS learned, round(prior, 6) AS prior, learned - prior >= 0.03 AS saved FROM s")
def holdout_gate(spark, d):
    """Weights learned on the first four fifths of events are saved only if they help on the rest."""
    ev = L.B.labelled(I.feedback_events(spark, d)).withColumn("u", F.col("used").cast("int"))
    cut = ev.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY ts)")).first()[0]
    rate = ev.where((F.col("ts") <= cut) & F.col("u").isNotNull()).groupBy("path").agg(F.avg("u").alias("r"))
    held = ev.where((F.col("ts") > cut) & F.col("u").isNotNull()).join(rate, "path", "left")
    right = F.when(F.coalesce("r", F.lit(0.5)) >= 0.5, F.col("u")).otherwise(1 - F.col("u"))
    s = held.agg(F.count("*").alias("n"), F.avg(right).alias("learned"), F.greatest(F.avg("u"), 1 - F.avg("u")).alias("prior"))
    return s.select("n", F.round("learned", 6).alias("learned"), F.round("prior", 6).alias("prior"), (F.col("learned") - F.col("prior") >= 0.03).alias("saved"))
