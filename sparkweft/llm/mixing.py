"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The token counts of the cells source x language x topic are raked in turn to the target marginal of
each dimension until all three agree.  A document's inclusion probability is the density its
cell gets (raked over actual tokens), scaled so that the densest cell keeps all; a hash of the
document id decides, so a rerun after a lost executor decides alike.

All rounds run on the cell table, pre-aggregated before its shuffle: its size is the number of cells,
not of documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Targets where none are given: shares of the dimension to these powers (1: as they are), normalised.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
PER_PLAN, TOLERANCE, SEED = 4, 1e-10, "mix"
#: Rounds after which raking that still moves is given up, with a warning; and those that the SQL has.
ROUNDS, SQL_ROUNDS = 48, 24


def tokens_of(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(tokens: F.Column, lines: F.Column) -> F.Column:
    """A coarse topic from the form of a text: note, list, essay or article."""
    return F.when(tokens < 60, "note").when(tokens < 12 * lines, "list").when(tokens < 600, "essay").otherwise("article")


def with_cells(docs: DataFrame) -> DataFrame:
    """The rows with mix_tokens, mix_source, mix_lang, mix_topic and mix_u added; a column ``topic`` is the topic where there is one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) if c in docs.columns else F.lit("(none)")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10)
    return (
        docs.withColumn("mix_tokens", tokens_of(text))
        .withColumn("mix_topic", label("topic") if "topic" in docs.columns else topic_of(F.col("mix_tokens"), F.regexp_count(text, F.lit("\n")) + 1))
        .withColumn("mix_source", label("source"))
        .withColumn("mix_lang", label("lang"))
        .withColumn("mix_u", draw.cast("double") / F.lit(4294967296.0))
    )


def _targets(cells: DataFrame, dim: str, power: float, given: dict[str, float] | None) -> DataFrame:
    key = f"mix_{dim}"
    sums = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("t"))
    if given is not None:
        spark = cells.sparkSession
        wanted = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{key} string, goal double")
        return sums.join(wanted, key, "left").select(key, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    return sums.select(key, F.pow("t", F.lit(power)).alias("goal"))


def rake(cells: DataFrame, scratch: Scratch, *, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, tokens) -> the same with w, the raked share of all tokens.

    Targets are normalised; a value without a target in a given table gets 0.  Where the targets
    contradict each other or the cells, the last dimension raked agrees exactly and the others nearly; that
    they did not settle within ``rounds`` is warned of, with the largest correction of the last round.
    """
    dims = list(POWERS)
    goals = {}
    for d in dims:
        goal = _targets(cells, d, POWERS[d], (targets or {}).get(d))
        total = goal.agg(F.sum("goal").alias("all"))
        goals[d] = scratch.keep(goal.join(F.broadcast(total)).select(f"mix_{d}", (F.col("goal") / F.col("all")).alias("goal")))
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in dims:  # goals by value: as few rows as the dimension has values
        now = now.join(goals[d].withColumnRenamed("goal", f"goal_{d}"), f"mix_{d}")
    now = scratch.keep(now)
    for at in range(0, rounds, PER_PLAN):
        for _ in range(min(PER_PLAN, rounds - at)):
            for d in dims:
                # a window names `now` once, where a join would double the plan at every step
                s = F.sum("w").over(Window.partitionBy(f"mix_{d}"))
                now = now.withColumn("f", F.when(s > 0, F.col(f"goal_{d}") / s).otherwise(F.lit(0.0)))
                moved = F.lit(0.0) if d == dims[0] else F.col("moved")
                now = now.withColumn("moved", F.greatest(moved, F.abs(F.col("f") - 1))).withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = scratch.keep(now)
        moved = now.agg(F.max("moved")).first()[0] or 0.0
        if moved < TOLERANCE:
            break
    else:
        warnings.warn(f"raking has not settled after {rounds} rounds: the last one still corrected by {moved:.3g}", stacklevel=2)
    return now.select(*[f"mix_{d}" for d in dims], "tokens", "w")


def probabilities(rows: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """Rows of with_cells -> mix_source, mix_lang, mix_topic, tokens, w, p for each cell."""
    dims = [f"mix_{d}" for d in POWERS]
    cells = scratch.keep(rows.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0"))
    raked = scratch.keep(rake(cells, scratch, **how).withColumn("density", F.col("w") / F.col("tokens")))
    top = raked.agg(F.max("density").alias("top"))
    return raked.join(F.broadcast(top)).select(*dims, "tokens", "w", F.when(F.col("top") > 0, F.col("density") / F.col("top")).otherwise(0.0).alias("p"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Documents with mix_tokens, mix_source, mix_lang, mix_topic, mix_u, mix_p and mix_kept added.

    A null source or language is a value of its own.  Documents without tokens have no weight to
    rake and are not kept.  Repeated rows of one doc_id are kept or dropped together, as are those without one.  Long
    texts weigh by all their tokens.  Columns of these names in the input are replaced; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_p", "mix_kept")
    rows = with_cells(docs)
    p = probabilities(rows, scratch, **how)
    dims = [f"mix_{d}" for d in POWERS]
    out = rows.join(p.select(*dims, F.col("p").alias("mix_p")), dims, "left")
    out = out.withColumn("mix_p", F.coalesce("mix_p", F.lit(0.0)))
    return out.withColumn("mix_kept", F.col("mix_u") < F.col("mix_p"))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (relative, 1 at most: the inclusion probability), kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = mixed(docs)
    return rows.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_p", 6).alias("probability"), F.col("mix_kept").alias("kept")
    )


def cells_sql(docs: str) -> str:
    """SQL whose CTE mix has the rows of ``docs`` with tokens, topic, probability p and draw u."""
    steps, last = [], "c0"
    for r in range(SQL_ROUNDS):
        for d in POWERS:
            new = f"c{r}_{d}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * goal / sum(w) OVER (PARTITION BY c.{d}) AS w FROM {last} c JOIN goal_{d} USING ({d}))")
            last = new
    goals = ", ".join(
        f"goal_{d} AS (SELECT {d}, pow(sum(tokens), {p}) / sum(pow(sum(tokens), {p})) OVER () AS goal FROM cells GROUP BY {d})" for d, p in POWERS.items()
    )
    return f"""
toks AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, len(regexp_extract_all(coalesce(text, ''), chr(10))) + 1 AS lines,
    CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM {docs}
), topics AS (
  SELECT * EXCLUDE (source, lang), coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, source AS source0, lang AS lang0,
    CASE WHEN tokens < 60 THEN 'note' WHEN tokens < 12 * lines THEN 'list' WHEN tokens < 600 THEN 'essay' ELSE 'article' END AS topic FROM toks
), cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM topics GROUP BY ALL HAVING sum(tokens) > 0),
{goals}, c0 AS (SELECT *, tokens AS w FROM cells), {", ".join(steps)},
probs AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM {last}),
mix AS (SELECT t.*, coalesce(p, 0) AS p FROM topics t LEFT JOIN probs USING (source, lang, topic))"""


SQL = f"WITH {cells_sql('documents')} SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS n_tokens, round(p, 6) AS probability, u < p AS kept FROM mix"
