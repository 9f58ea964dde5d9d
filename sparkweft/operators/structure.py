"""Structure of a tree of files: imports resolved, tests paired, subsystems, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import checkpointed, sorted_side


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref), (path) -> (src, dst): a reference goes to the file whose path ends in it.

    Every suffix of every path is a key, so that the suffix match is an equi-join; the shortest path wins, then the first.
    """
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(bare, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = files.select(F.col("path").alias("dst"), F.explode(keys).alias("key"))
    # the two best of a key will do, as a file is not its own import
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.length("dst"), "dst"))).where("nth <= 2").drop("nth")
    want = refs.select(F.col("path").alias("src"), "ref", F.regexp_replace(F.regexp_replace("ref", r"^(\./|\.\./)+", ""), r"[.:]+", "/").alias("key"))
    hit = want.join(sorted_side(known), "key").where("src <> dst")
    first = F.row_number().over(Window.partitionBy("src", "ref").orderBy(F.length("dst"), "dst"))
    return hit.withColumn("nth", first).where("nth = 1").select("src", "dst").distinct()


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Rows of distinct values with their place n from 1 in the order of the column, and the next value; no task has more than a range of them."""
    ranged = checkpointed(rows.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    by = Window.orderBy("first")  # over a row a range
    before = F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.count("*").alias("c"), F.min(column).alias("first")).select("part", before.alias("before"), F.lead("first").over(by).alias("after"))
    own = Window.partitionBy("part").orderBy(column)
    out = ranged.join(F.broadcast(parts), "part")
    return out.select(*rows.columns, (F.col("before") + F.row_number().over(own)).alias("n"), F.coalesce(F.lead(column).over(own), F.col("after")).alias("next"))


def paired_tests(files: DataFrame, cap: int = 10) -> DataFrame:
    """(path) -> (test, impl): files that share a mirror key, at most ``cap`` for each test."""
    rows = files.select("path", P.mirror_key(F.col("path")).alias("mirror"), P.is_structural_test(F.col("path")).alias("t"))
    # the first of each key, before anything is paired
    first = F.row_number().over(Window.partitionBy("mirror").orderBy("impl"))
    impls = rows.where("not t").select(F.col("path").alias("impl"), "mirror").withColumn("nth", first).where(F.col("nth") <= cap)
    return rows.where("t").select(F.col("path").alias("test"), "mirror").join(impls, "mirror").select("test", "impl")


def siblings(files: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, path) -> (item_id, sibling, k): the first k other paths of each path's directory."""
    rows = files.withColumn("dir", P.parent(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("dir").orderBy("path", "item_id"))
    # k + 1 of a directory will do, as one of them may be the path itself
    first = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("dir", F.col("item_id").alias("sibling"), "nth")
    own = first.select(F.col("sibling").alias("item_id"), F.col("nth").alias("own"))
    pairs = rows.select("item_id", "dir").join(first, "dir").where("item_id <> sibling").join(own, "item_id", "left")
    place = F.col("nth") - F.when(F.col("own") < F.col("nth"), 1).otherwise(0)
    return pairs.select("item_id", "sibling", place.cast("int").alias("k")).where(F.col("k") <= k)


def drift(touched: DataFrame) -> DataFrame:
    """(basket_id, subsystem, is_spec) -> baskets that change a subsystem's code and none of its specs."""
    per = touched.groupBy("basket_id", "subsystem").agg(F.bool_or(~F.col("is_spec")).alias("code"), F.bool_or("is_spec").alias("spec"))
    return per.where("code and not spec").groupBy("subsystem").agg(F.count("*").alias("drifting"))


def subsystem_summary(files: DataFrame, degrees: DataFrame, top: int = 5) -> DataFrame:
    rows = files.withColumn("subsystem", P.auto_prefix(F.col("path"))).join(degrees, "item_id")
    nth = F.row_number().over(Window.partitionBy("subsystem").orderBy(F.desc("degree"), "path"))
    return rows.where("degree > 0").withColumn("rank", nth).where(F.col("rank") <= top).select("subsystem", "path", "degree", "rank")


def routing_hints(requests: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """Rules (rule_id, rule_intent, path_prefix, path_contains, degree_gte; null matches all) that fit each request, the first few.

    A prefix is whole directories of a path, or the path.

    Rules are configuration: the caller vouches for their number, which is checked before they go to every task.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 routing rules")
    fits = (
        (F.col("rule_intent").isNull() | (F.col("rule_intent") == F.col("intent")))
        & (F.col("path_prefix").isNull() | (F.col("path") == F.rtrim("path_prefix", F.lit("/"))) | F.expr("startswith(path, concat(rtrim('/', path_prefix), '/'))"))
        & (F.col("path_contains").isNull() | F.expr("contains(path, path_contains)"))
        & (F.col("degree_gte").isNull() | (F.col("degree") >= F.col("degree_gte")))
    )
    rows = requests.join(F.broadcast(rules), fits)
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("rule_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select("request_id", "rule_id", "nth")


def changed_since(state: DataFrame, now: DataFrame) -> DataFrame:
    """(path, signature) before and now -> paths to index again: new ones and those whose signature differs."""
    old = state.select("path", F.col("signature").alias("was"))
    return now.join(old, "path", "left").where(~F.col("signature").eqNullSafe(F.col("was"))).select("path", "signature")
