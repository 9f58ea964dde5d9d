"""Engine inputs from the star-schema, document, page and event tables.

Expressions are written once as SQL text; ``SQL_*`` give the same relations for any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = (
    "CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'src/routes/' WHEN 3 THEN 'app/config/' WHEN 4 THEN 'db/migrations/' ELSE 'src/' END"
    " || replace(lower(p_type), ' ', '_') || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(lower(p_name), ' ', '_') || '_' || p_partkey"
    " || CASE CAST(p_size % 5 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.rb' WHEN 2 THEN '.js' WHEN 3 THEN '.md' ELSE '.yaml' END"
)
SUBJECT = "CASE WHEN o_orderpriority = '5-LOW' THEN 'chore(deps): bump' ELSE 'feature ' || o_orderkey END"
KIND = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'cite' WHEN 'view' THEN 'view' WHEN 'error' THEN 'reject' ELSE 'dwell' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> F.Column:
    """Epoch seconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.expr(PATH).alias("path"))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("basket_id"), seconds("o_orderdate").alias("ts"), F.expr(SUBJECT).alias("subject"))


def basket_items(spark: SparkSession, d: str) -> DataFrame:
    return basket_lines(spark, d).distinct()


def basket_lines(spark: SparkSession, d: str) -> DataFrame:
    """The items of baskets with their repeats."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("item_id"))


def feedback_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("request_id"),
        F.expr("'item_' || (event_id % 200)").alias("path"),
        F.expr(KIND).alias("kind"),
        seconds("ts").alias("ts"),
        F.col("value").alias("dwell_seconds"),
    )


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) of every href in every page."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return read(spark, d, "pages").select(F.col("url").alias("src"), links.alias("dst"))


SQL_ITEMS = f"items AS (SELECT p_partkey AS item_id, {PATH} AS path FROM part)"
SQL_BASKETS = f"baskets AS (SELECT o_orderkey AS basket_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, {SUBJECT} AS subject FROM orders)"
SQL_BASKET_ITEMS = "basket_items AS (SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS item_id FROM lineitem)"
SQL_EVENTS = f"fb AS (SELECT event_id, CAST(user_id AS VARCHAR) AS request_id, 'item_' || (event_id % 200) AS path, {KIND} AS kind, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, value AS dwell_seconds FROM events)"
SQL_EDGES = f"""{SQL_BASKETS}, {SQL_BASKET_ITEMS},
sized AS (SELECT b.basket_id, b.ts, b.subject, i.item_id, count(*) OVER (PARTITION BY i.basket_id) AS n FROM basket_items i JOIN baskets b ON b.basket_id = i.basket_id),
kept AS (SELECT *, CAST(round(w0 * 1e12) AS BIGINT) AS w FROM (SELECT *, greatest(1 / ln(n + 1) * CASE WHEN regexp_matches(trim(subject), '(?i)^(merge|bump|format|lint|rubocop|prettier|reformat|chore\\(deps\\))') THEN 0.25 ELSE 1.0 END, 0.05) AS w0 FROM sized WHERE n BETWEEN 2 AND 250)),
edges AS (SELECT a.item_id AS src, b.item_id AS dst, CAST(sum(a.w) AS DOUBLE) / 1e12 AS weight, max(a.ts) AS last_seen, count(*) AS n FROM kept a JOIN kept b ON a.basket_id = b.basket_id AND a.item_id < b.item_id GROUP BY 1, 2),
sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""
