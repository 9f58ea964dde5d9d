"""Queries over the co-occurrence graph, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cochange as C
from ..operators import graph as G
from ..sources import inputs as I

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges_of(spark, d):
    return C.cochange_edges(I.baskets(spark, d), I.basket_lines(spark, d), size=I.read(spark, d, "lineitem").count())


def seeds_of(spark, d):
    """Request r asks about the five items from 7 r on."""
    return spark.range(10).select(F.col("id").alias("request_id"), F.explode(F.sequence(F.col("id") * 7 + 1, F.col("id") * 7 + 5)).alias("item_id"))


E = I.SQL_EDGES
TOTAL = "round(CAST(sum(CAST(round(weight * 1e9) AS BIGINT)) AS DOUBLE) / 1e9, 6)"
SEEDS = "seeds AS (SELECT r AS request_id, r * 7 + k AS item_id FROM range(10) a(r), range(1, 6) b(k))"


@query(f"WITH {E} SELECT src, dst, round(weight, 6) AS weight, last_seen, n FROM edges")
def cochange_edges(spark, d):
    return edges_of(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"WITH {E} SELECT src, dst, round(weight, 6) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM sym) WHERE rank <= 50")
def top_neighbours(spark, d):
    return C.top_neighbours(edges_of(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {E} SELECT src AS item_id, count(*) AS degree, {TOTAL} AS total_weight FROM sym GROUP BY src ORDER BY total_weight DESC, item_id LIMIT 20")
def hotspots(spark, d):
    return C.hotspots(edges_of(spark, d))


@query(f"WITH {E} SELECT src AS item_id, count(*) AS degree, {TOTAL} AS total_weight FROM sym GROUP BY src")
def node_degrees(spark, d):
    return C.degrees(edges_of(spark, d)).withColumn("total_weight", F.round("total_weight", 6))


@query(
    f"WITH {E}, deg AS (SELECT src, count(*) AS d FROM sym GROUP BY src) SELECT (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM edges) AS edges, "
    "(SELECT list_sort(list(d))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] FROM deg) AS p95_degree, (SELECT max(d) FROM deg) AS max_degree"
)
def graph_stats(spark, d):
    return C.graph_stats(I.items(spark, d), edges_of(spark, d))


@query(f"WITH {E}, {SEEDS} SELECT request_id, src AS seed, dst AS item_id, round(weight, 6) AS weight FROM sym JOIN seeds ON src = item_id WHERE weight >= 0.8")
def neighbours(spark, d):
    return C.neighbours(edges_of(spark, d), seeds_of(spark, d), 0.8).withColumn("weight", F.round("weight", 6))


@query(
    f"WITH {E}, t AS (SELECT max(ts) AS now FROM baskets) SELECT src, dst, round(weight * exp(-greatest(0, (now - last_seen) / 86400.0) / 180.0), 6) AS weight FROM edges, t "
    "WHERE weight * exp(-greatest(0, (now - last_seen) / 86400.0) / 180.0) >= 0.05"
)
def edge_decay(spark, d):
    now = I.baskets(spark, d).agg(F.max("ts")).first()[0]
    return C.decayed(edges_of(spark, d), now).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {E} SELECT src, dst, round(weight, 6) AS weight, last_seen FROM edges")
def edge_upsert_merge(spark, d):
    """Even and odd baskets counted apart and merged: the same as counted together."""
    baskets, items = I.baskets(spark, d), I.basket_lines(spark, d)
    size = I.read(spark, d, "lineitem").count()
    parts = [C.cochange_edges(baskets.where(F.col("basket_id") % 2 == k), items.where(F.col("basket_id") % 2 == k), size=size // 2) for k in (0, 1)]
    return C.merge_edges(*parts, size=size).withColumn("weight", F.round("weight", 6))


@query(f"WITH {E}, t AS (SELECT max(ts) - 365 * 86400 AS since FROM baskets), late AS (SELECT k.* FROM kept k, t WHERE k.ts > t.since) SELECT a.item_id AS src, b.item_id AS dst, round(CAST(sum(a.w) AS DOUBLE) / 1e12, 6) AS weight, max(a.ts) AS last_seen, count(*) AS n FROM late a JOIN late b ON a.basket_id = b.basket_id AND a.item_id < b.item_id GROUP BY 1, 2")
def incremental_edges(spark, d):
    """Only the baskets after a watermark, here the last year."""
    baskets = I.baskets(spark, d)
    since = baskets.agg(F.max("ts")).first()[0] - 365 * 86400
    return C.cochange_edges(baskets.where(F.col("ts") > since), I.basket_items(spark, d)).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {E}, {SEEDS}, good AS (SELECT * FROM sym WHERE weight >= 0.8),
h1 AS (SELECT request_id, dst AS item_id, max(weight) AS w FROM seeds JOIN good ON src = item_id GROUP BY ALL),
f1 AS (SELECT request_id, item_id FROM h1 ANTI JOIN seeds USING (request_id, item_id)),
h2 AS (SELECT request_id, dst AS item_id, max(weight) AS w FROM f1 JOIN good ON src = item_id GROUP BY ALL),
f2 AS (SELECT request_id, item_id FROM h2 ANTI JOIN seeds USING (request_id, item_id) ANTI JOIN f1 USING (request_id, item_id)),
seen AS (SELECT *, 0 AS depth FROM seeds UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2),
most AS (SELECT request_id, item_id, max(w) AS w FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
r AS (SELECT request_id, item_id, depth, round(coalesce(w, 0), 6) AS weight, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, coalesce(w, 0) DESC, item_id) AS INT) AS rank FROM seen LEFT JOIN most USING (request_id, item_id))
SELECT * FROM r WHERE rank <= 100"""
)
def blast_radius(spark, d):
    return G.blast_radius(edges_of(spark, d), seeds_of(spark, d), min_weight=0.8).withColumn("weight", F.round("weight", 6))


def _walk_sql(steps: int) -> str:
    out = f"WITH {E}, {SEEDS}, topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM sym) WHERE rank <= 50), hop AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM topk), m0 AS (SELECT request_id, item_id AS seed, item_id, 1.0::DOUBLE AS p FROM seeds)"
    for t in range(1, steps):
        out += (
            f", m{t} AS (SELECT request_id, seed, item_id, sum(p) AS p FROM (SELECT request_id, seed, dst AS item_id, 0.85 * p * share AS p FROM m{t - 1} JOIN hop ON src = item_id "
            f"UNION ALL SELECT request_id, seed, seed, 0.15 * sum(p) FROM m{t - 1} GROUP BY request_id, seed) GROUP BY ALL)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM m{t}" for t in range(steps))
    return out + f", v AS (SELECT request_id, item_id, sum(p) AS v FROM ({every}) GROUP BY ALL) SELECT request_id, item_id, round(v / sum(v) OVER (PARTITION BY request_id), 6) AS score FROM v"


@query(_walk_sql(4))
def rwr_expected(spark, d):
    return G.walk_scores(edges_of(spark, d), seeds_of(spark, d), steps=4).withColumn("score", F.round("score", 6))


COMP = f"WITH RECURSIVE {E}, strong AS (SELECT src, dst FROM sym WHERE weight >= 0.9), nodes AS (SELECT DISTINCT src AS id FROM strong), reach AS (SELECT id, id AS root FROM nodes UNION SELECT s.dst, r.root FROM reach r JOIN strong s ON s.src = r.id), comp AS (SELECT id AS item_id, min(root) AS component FROM reach GROUP BY id)"


def components_of(spark, d):
    return G.connected_components(edges_of(spark, d), min_weight=0.9)


@query(f"{COMP} SELECT item_id, component FROM comp")
def connected_components(spark, d):
    return components_of(spark, d)


@query(f"{COMP} SELECT p_partkey AS item_id, coalesce(component, p_partkey) AS component FROM part LEFT JOIN comp ON item_id = p_partkey")
def community_membership(spark, d):
    return G.connected_components(edges_of(spark, d), I.items(spark, d), min_weight=0.9)


@query(f"{COMP}, b AS (SELECT *, (row_number() OVER (PARTITION BY component ORDER BY item_id) - 1) // 50 AS block FROM comp), s AS (SELECT *, count(*) OVER (PARTITION BY component, block) AS size FROM b) SELECT component || ':' || block AS community, item_id, size FROM s WHERE size >= 2")
def communities(spark, d):
    return G.communities(components_of(spark, d))


@query(
    f"{COMP}, mem AS (SELECT p_partkey AS item_id, coalesce(component, p_partkey) AS c FROM part LEFT JOIN comp ON item_id = p_partkey), eu AS (SELECT src, dst, round(weight * 1e9) AS weight FROM edges), su AS (SELECT src, round(weight * 1e9) AS weight FROM sym), m AS (SELECT sum(weight) AS m FROM eu), ins AS (SELECT a.c, sum(weight) AS i FROM eu JOIN mem a ON a.item_id = src JOIN mem b ON b.item_id = dst WHERE a.c = b.c GROUP BY a.c), dg AS (SELECT c, sum(weight) AS g FROM su JOIN mem ON item_id = src GROUP BY c) "
    "SELECT round(CAST(sum(CAST(round((coalesce(i, 0) / m - pow(g / (2 * m), 2)) * 1e12) AS BIGINT)) AS DOUBLE) / 1e12, 4) AS modularity FROM dg LEFT JOIN ins ON ins.c = dg.c, m"
)
def modularity(spark, d):
    edges = edges_of(spark, d)
    return G.modularity(edges, G.connected_components(edges, I.items(spark, d), min_weight=0.9))


LINKS = "links AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages)"


@query(f"WITH {LINKS} SELECT src, dst, 'calls' AS kind FROM links")
def structural_edges(spark, d):
    return I.page_links(spark, d).distinct().withColumn("kind", F.lit("calls"))


@query(
    f"""WITH RECURSIVE {LINKS}, walk AS (SELECT DISTINCT dst AS path, 0 AS depth FROM links WHERE dst IN (SELECT min(dst) FROM links) UNION SELECT l.src, w.depth + 1 FROM walk w JOIN links l ON l.dst = w.path WHERE w.depth < 3)
SELECT path, min(depth) AS depth FROM walk GROUP BY path"""
)
def affected_walk(spark, d):
    links = I.page_links(spark, d)
    return G.affected(links, links.agg(F.min("dst").alias("path")))


@query(f"WITH {E}, {LINKS} SELECT items, cochange, structural, round(100.0 * least(greatest(cochange, structural), items) / greatest(items, 1), 1) AS pct FROM (SELECT (SELECT count(*) FROM part) AS items, (SELECT count(DISTINCT src) FROM sym) AS cochange, (SELECT count(*) FROM (SELECT src FROM links UNION SELECT dst FROM links)) AS structural)")
def coverage(spark, d):
    return C.coverage(I.items(spark, d), edges_of(spark, d), I.page_links(spark, d))


@query(f"WITH {E}, deg AS (SELECT src AS item_id, count(*) AS degree FROM sym GROUP BY src), p AS (SELECT list_sort(list(degree))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS v FROM deg) SELECT item_id, degree FROM (SELECT * FROM deg ORDER BY degree DESC, item_id LIMIT 10), p WHERE degree >= greatest(v, 10)")
def emerging_hubs(spark, d):
    deg = C.degrees(edges_of(spark, d)).select("item_id", "degree")
    return G.emerging_hubs(deg, C.lower_percentile(deg, "degree", 0.95))


@query(
    f"""WITH {E}, deg AS (SELECT src AS item_id, count(*) AS degree FROM sym GROUP BY src), hits AS (SELECT r AS request_id, r * 7 + k AS item_id, k AS rank FROM range(10) a(r), range(1, 6) b(k)),
s AS (SELECT request_id, h.item_id FROM hits h LEFT JOIN deg USING (item_id) WHERE rank <= 3 AND coalesce(degree, 0) < 500), h1 AS (SELECT request_id, dst AS item_id, max(weight) AS w FROM s JOIN sym ON src = item_id WHERE weight >= 0.8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seed DESC, w DESC, item_id) AS k FROM (SELECT request_id, item_id, 1 AS seed, 0 AS w FROM s UNION ALL SELECT request_id, item_id, 0, w FROM h1 ANTI JOIN s USING (request_id, item_id)))
SELECT request_id, item_id, CAST(floor(w) AS BIGINT) AS weight FROM r WHERE k <= 8 AND seed = 0"""
)
def prf_expansion(spark, d):
    hits = seeds_of(spark, d).withColumn("rank", (F.col("item_id") - F.col("request_id") * 7).cast("int"))
    edges = edges_of(spark, d)
    return G.prf_additions(edges, hits, C.degrees(edges).select("item_id", "degree"), min_weight=0.8)
