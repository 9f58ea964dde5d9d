"""Connected components over a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A node with more than one in so many of the rows is a hub; there are fewer hubs than this.
HUBS = 1000


def _with_least(rows: DataFrame, rows_count: int, with_self: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, v) -> (u, v, m), m being the least v of u (and u itself, if so), and the table of u and m.

    The rows of a hub do not meet in one task: fewer than HUBS nodes have more than rows_count / HUBS rows,
    and those go out to the rows by broadcast.
    """
    least = F.least(F.min("v"), F.col("u")) if with_self else F.min("v")
    low = scratch.keep(rows.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")))
    hub = F.col("n") > max(1, rows_count // HUBS)
    hubs = F.broadcast(low.where(hub).select("u", "m"))
    rest = rows.join(hubs, "u", "left_anti").join(low.where(~hub).select("u", "m"), "u")
    return rows.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m")), low


def connected_components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (id, root): every id that occurs, with the smallest id it reaches.

    Each round hangs every node's larger neighbours on its smallest one (large star), then its
    smaller neighbours (small star); both only regroup the links that are there, so the table
    never grows beyond them, and the number of rounds is about the logarithm of the longest
    chain.  Ends when a round changes nothing.  Null ends and self-links are left out.
    """
    now = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    count, before = now.count(), None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        # u's larger neighbours go to m, the least of u and its neighbours
        met, low = _with_least(both, 2 * count, True, scratch)
        large = scratch.keep(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        met, lower = _with_least(large, count, False, scratch)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower.select("u", "m")).distinct()
        after = scratch.keep(small)
        mark = tuple(after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        scratch.drop(now, low, large, lower)
        now, count = after, mark[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
