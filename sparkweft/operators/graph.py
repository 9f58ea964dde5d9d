"""Traversal, walks and communities over the co-occurrence graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..session import checkpointed, kept, sorted_side
from .cochange import UNIT, symmetric, units
from .retrieval import is_small, ranked


def blast_radius(edges: DataFrame, seeds: DataFrame, *, min_weight: float = CONFIG.min_weight, max_depth: int = CONFIG.max_depth, max_results: int = CONFIG.max_results) -> DataFrame:
    """(request_id, item_id) -> (request_id, item_id, depth, weight, rank): what lies within some hops of the seeds.

    Depth is the least number of hops; weight the most over all edges from expanded nodes; seeds rank
    first, and the cap counts them.  All requests walk at once, one join a hop.
    """
    sym = symmetric(edges).where(F.col("weight") >= min_weight)
    seen = seeds.select("request_id", "item_id").distinct().withColumn("depth", F.lit(0))
    frontier, hops = seen, []
    for depth in range(1, max_depth + 1):
        step = frontier.join(sym, frontier.item_id == sym.src).select("request_id", F.col("dst").alias("item_id"), "weight")
        step = step.groupBy("request_id", "item_id").agg(F.max("weight").alias("weight"))
        hops.append(step)
        frontier = step.join(seen, ["request_id", "item_id"], "left_anti").select("request_id", "item_id", F.lit(depth).alias("depth"))
        seen = seen.union(frontier)
    most = reduce(DataFrame.union, hops).groupBy("request_id", "item_id").agg(F.max("weight").alias("weight"))
    out = seen.join(most, ["request_id", "item_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), F.desc("weight"), "item_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results)


def walk_scores(edges: DataFrame, seeds: DataFrame, *, steps: int = 6, restart: float = CONFIG.restart, k: int = CONFIG.top_k) -> DataFrame:
    """Expected visit shares of a random walk with restart, (request_id, item_id, score): no sampling, one join a step.

    A walk goes on by weight over the top k neighbours, restarts at its seed, and ends where there are none.  Neighbours are
    sought only for items that a walk has come to, each once; where those are many, for all that are left at one time.
    """
    edges = kept(edges.where("weight > 0").select("src", "dst", "weight"))  # read once a step
    hop, come = None, None
    seeds = seeds.select("request_id", F.col("item_id").alias("seed")).distinct()
    mass = seeds.select("request_id", "seed", F.col("seed").alias("item_id"), F.lit(1.0).alias("p"))
    parts, whole = [mass], False
    for _ in range(steps - 1):
        at = mass.select(F.col("item_id").alias("src")).distinct()
        fresh = at if come is None else at.join(sorted_side(come), "src", "left_anti")
        if not whole and (hop is None or not fresh.isEmpty()):
            fresh = checkpointed(fresh)
            whole = not is_small(fresh)
            more = _shares(edges, k, come if whole else fresh, whole)
            hop, come = (more, fresh) if hop is None else (hop.union(more), come.union(fresh))
        on = mass.join(sorted_side(hop), F.col("item_id") == F.col("src")).select("request_id", "seed", F.col("dst").alias("item_id"), ((1 - restart) * F.col("p") * F.col("share")).alias("p"))
        back = mass.groupBy("request_id", "seed").agg((restart * F.sum("p")).alias("p")).select("request_id", "seed", F.col("seed").alias("item_id"), "p")
        mass = checkpointed(on.union(back).groupBy("request_id", "seed", "item_id").agg(F.sum("p").alias("p")))  # read four times
        parts.append(mass)
    visits = reduce(DataFrame.union, parts).groupBy("request_id", "item_id").agg(F.sum("p").alias("v"))
    return visits.select("request_id", "item_id", (F.col("v") / F.sum("v").over(Window.partitionBy("request_id"))).alias("score"))


def _shares(edges: DataFrame, k: int, of: DataFrame | None, rest: bool) -> DataFrame:
    """(src, dst, share) over the top k neighbours of the few nodes ``of`` (src), or of all but those."""
    sym = symmetric(edges)
    if of is not None:
        sym = sym.join(sorted_side(of) if rest else F.broadcast(of), "src", "left_anti" if rest else "left_semi")
    hop = ranked(sym, "src", [F.desc("weight"), F.col("dst")], k)
    return kept(hop.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share")))


#: A node with more than one in so many of the links is a hub; there are fewer hubs than this.
HUBS = 1000


def connected_components(edges: DataFrame, items: DataFrame | None = None, *, min_weight: float = 1.0, rounds: int = 50) -> DataFrame:
    """(item_id, component) over edges of enough weight, the component being its least item.

    Labels spread and jump to their label's label; each round is checkpointed, and it ends when none changes.
    Labels of hubs, fewer than HUBS, go out to their links by broadcast, so that no hub's links meet in one task.
    """
    # dealt anew, as few of the edges may be left
    sym = checkpointed(symmetric(edges).where(F.col("weight") >= min_weight).select("src", "dst").repartition("src"))
    first = sym.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label"), F.count("*").alias("n"))
    first = checkpointed(first.withColumnRenamed("src", "item_id"))
    hubs = first.where(F.col("n") > max(1, sym.count() // HUBS)).select("item_id")
    to_hub = sym.join(F.broadcast(hubs.withColumnRenamed("item_id", "dst")), "dst", "left_semi")
    to_rest = sym.join(F.broadcast(hubs.withColumnRenamed("item_id", "dst")), "dst", "left_anti")
    labels = first.select("item_id", "label")
    for _ in range(rounds):
        far = labels.withColumnRenamed("item_id", "dst")
        of_hubs = F.broadcast(labels.join(hubs, "item_id", "left_semi").withColumnRenamed("item_id", "dst"))
        near = to_rest.join(sorted_side(far), "dst").union(to_hub.join(of_hubs, "dst")).groupBy("src").agg(F.min("label").alias("near")).withColumnRenamed("src", "item_id")
        step = labels.join(sorted_side(near), "item_id").select("item_id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("item_id").alias("via"), F.col("label").alias("far"))
        step = checkpointed(step.join(sorted_side(jump), step.new == jump.via, "left").select("item_id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.where("label <> new").limit(1).count()
        labels = step.select("item_id", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    out = labels.select("item_id", F.col("label").alias("component"))
    if items is None:
        return out
    return items.select("item_id").join(sorted_side(out), "item_id", "left").withColumn("component", F.coalesce("component", "item_id"))


def communities(components: DataFrame, *, max_size: int = 50) -> DataFrame:
    """Components of two and more, cut into blocks of at most ``max_size`` in item order; (community, item_id, size)."""
    nth = F.row_number().over(Window.partitionBy("component").orderBy("item_id"))
    blocks = components.withColumn("block", F.floor((nth - 1) / max_size).cast("long"))
    size = F.count("*").over(Window.partitionBy("component", "block"))
    return blocks.withColumn("size", size).where("size >= 2").select(F.concat_ws(":", "component", "block").alias("community"), "item_id", "size")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Weighted modularity of (item_id, component), from sums in whole units, so that it does not depend on the order of rows."""
    edges = edges.select("src", "dst", units(F.col("weight"), 1e9).cast("double").alias("weight"))  # whole numbers, summed exactly
    m = edges.agg(F.sum("weight").alias("m"))
    a, b = membership.select(F.col("item_id").alias("src"), F.col("component").alias("ca")), membership.select(F.col("item_id").alias("dst"), F.col("component").alias("cb"))
    a, b = sorted_side(a), sorted_side(b)
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.sum("weight").alias("inside"))
    deg = symmetric(edges).join(a, "src").groupBy(F.col("ca").alias("component")).agg(F.sum("weight").alias("deg"))
    per = deg.join(sorted_side(inside), "component", "left").crossJoin(F.broadcast(m))
    term = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)
    return per.agg(F.round(F.sum(units(term)) / F.lit(UNIT), 4).alias("modularity"))


def affected(links: DataFrame, changed: DataFrame, *, depth: int = 3) -> DataFrame:
    """(src depends on dst) and (path) -> (path, depth): what depends on the changed paths, with the fewest hops."""
    seen = checkpointed(changed.select("path").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    back = checkpointed(links.select("src", "dst").distinct())  # read once a hop
    for d in range(1, depth + 1):
        step = frontier.join(sorted_side(back), F.col("path") == F.col("dst")).select(F.col("src").alias("path")).distinct()
        frontier = checkpointed(step.join(sorted_side(seen), "path", "left_anti").withColumn("depth", F.lit(d)))  # read twice a hop
        seen = seen.union(frontier)
    return seen


def prf_additions(edges: DataFrame, hits: DataFrame, degree: DataFrame, *, top: int = 3, max_degree: int = 500, min_weight: float = 1.0, rows: int = 8) -> DataFrame:
    """Feedback from the best hits: (request_id, item_id, rank) -> one-hop neighbours of the first ``top`` that are no hubs; ``rows`` counts those seeds."""
    seeds = hits.where(F.col("rank") <= top).join(degree, "item_id", "left").where(F.coalesce("degree", F.lit(0)) < max_degree)
    seeds = seeds.select("request_id", "item_id")
    found = blast_radius(edges, seeds, min_weight=min_weight, max_depth=1, max_results=rows)
    return found.where("depth > 0").select("request_id", "item_id", F.floor("weight").cast("long").alias("weight"))


def emerging_hubs(degree: DataFrame, p95: DataFrame, *, top: int = 10, least: int = 10) -> DataFrame:
    best = degree.orderBy(F.desc("degree"), "item_id").limit(top)
    return best.crossJoin(F.broadcast(p95)).where(F.col("degree") >= F.greatest("value", F.lit(least))).select("item_id", "degree")
