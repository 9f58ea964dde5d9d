"""Resharding by minimum-cost flow over blocks of equal texts.

A document has an old shard (a column, or the hash of its text).  Within an old shard, documents
fall into blocks: a bucket of text hashes, or a text of its own where its copies weigh as much as a
bucket; copies of one text stay together unless they weigh more than a new shard, when they are dealt
over the fewest equal blocks.  The number of blocks is bounded by the parameters, not by the
data, so the plan is solved on the driver: old shard sizes are supplies, capacities of the new shards
are demands, a byte that stays costs nothing and one that moves costs 1.  Successive shortest
augmenting paths give the flow; blocks then follow it, the largest first, each to the shard the flow
leaves most room in.  The law is ``bytes``: new shards are near equal in size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS, OLD, BUCKETS, OVERHEAD = 40, 32, 256, 16
#: Parts in which the rows of a block are numbered, so that a block as heavy as a shard is no single task's.
PARTS = 64


def min_cost_flow(supply: dict[int, int], room: dict[int, int], cost=lambda a, b: int(a != b)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at least total cost, by successive shortest paths.

    The total supply must not exceed the total room.
    """
    left = [a for a in sorted(supply) if supply[a] > 0]
    right = sorted(room)
    have, free = dict(supply), dict(room)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    price = {("a", a): 0 for a in left} | {("b", b): 0 for b in right}
    while any(have[a] > 0 for a in left):
        dist, back, done = {("a", a): 0 for a in left if have[a] > 0}, {}, set()
        heap = [(0, x) for x in dist]
        end = None
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x[0] == "b" and free[x[1]] > 0:
                end = x
                break
            if x[0] == "a":
                steps = [(("b", b), cost(x[1], b)) for b in right]
            else:
                steps = [(("a", a), -cost(a, x[1])) for a in left if flow[a, x[1]] > 0]
            for y, c in steps:
                nd = d + c + price[x] - price[y]
                if y not in done and nd < dist.get(y, 1 << 62):
                    dist[y], back[y] = nd, x
                    heapq.heappush(heap, (nd, y))
        if end is None:
            raise ValueError("more bytes than room")
        for x in price:
            price[x] += min(dist.get(x, dist[end]), dist[end])
        path = [end]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        hops = list(zip(path, path[1:], strict=False))
        much = min(have[path[0][1]], free[end[1]], *(flow[y[1], x[1]] for x, y in hops if x[0] == "b"))
        for x, y in hops:
            if x[0] == "a":
                flow[x[1], y[1]] += much
            else:
                flow[y[1], x[1]] -= much
        have[path[0][1]] -= much
        free[end[1]] -= much
    return {k: v for k, v in flow.items() if v}


def place_blocks(blocks: list[tuple], shards: int) -> list[tuple]:
    """(old, block, bytes, rows) -> (old, block, shard, first slot), following the least-moving flow."""
    total = sum(b[2] for b in blocks)
    cap = {s: total // shards + (s < total % shards) for s in range(shards)}
    supply: dict[int, int] = defaultdict(int)
    for b in blocks:
        supply[b[0]] += b[2]
    wanted = min_cost_flow(supply, cap)
    targets: dict[int, list[int]] = defaultdict(list)
    for a, s in wanted:
        targets[a].append(s)
    left = dict(wanted)
    free = dict(cap)
    heap = [(-v, s) for s, v in free.items()]
    heapq.heapify(heap)
    shard_of = {}
    for b in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        old, size = b[0], b[2]
        fits = [s for s in targets[old] if free[s] >= size and left[old, s] * 2 >= size]
        if fits:
            s = max(fits, key=lambda s: (s == old, left[old, s], -s))
            left[old, s] -= size
        else:  # the flow cuts through this block: to the emptiest shard
            while -heap[0][0] != free[heap[0][1]]:
                heapq.heapreplace(heap, (-free[heap[0][1]], heap[0][1]))
            s = heap[0][1]
        free[s] -= size
        shard_of[b[:2]] = s
    _even_out(blocks, shard_of, free, max(1, total // (shards * 200)))
    nxt, out = [0] * shards, []
    for b in sorted(blocks, key=lambda x: (x[0], x[1])):
        s = shard_of[b[:2]]
        out.append((b[0], b[1], s, nxt[s]))
        nxt[s] += b[3]
    return out


def _even_out(blocks: list[tuple], shard_of: dict, free: dict[int, int], slack: int) -> None:
    """Moves single blocks from the fullest to the emptiest shard while that brings the two closer.

    Every move lessens the sum of the squares of what is free, in whole bytes, so it ends by itself.
    """
    own = defaultdict(list)
    for b in blocks:
        own[shard_of[b[:2]]].append((b[2], b[:2]))
    while True:
        full, empty = min(free, key=lambda s: (free[s], s)), max(free, key=lambda s: (free[s], -s))
        gap = free[empty] - free[full]
        if gap <= slack:
            return
        good = [x for x in own[full] if 0 < x[0] < gap]
        if not good:
            return
        size, key = min(good, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        own[full].remove((size, key))
        own[empty].append((size, key))
        shard_of[key] = empty
        free[full] += size
        free[empty] -= size


def sizes_of(docs: DataFrame) -> list[F.Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [(F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash")]


def reshard(docs: DataFrame, *, shards: int = SHARDS, old_shards: int = OLD, buckets: int = BUCKETS, old: F.Column | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard; one row for each input row.

    ``old`` gives the present shard of a row (0 to old_shards - 1); by default it is the hash of
    the text modulo old_shards.  A null text weighs its overhead only and equals an empty text.
    Rows are told apart by doc_id, size and CRC; rows alike in all three share no slot, in either order.
    Equal sizes are placed in the order of their block's number.  A long text counts by its bytes alone; one heavier
    than a shard overfills it.  Other columns of any name are not read, but for those that ``old`` names.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    old = F.pmod("text_hash", F.lit(old_shards)).cast("int") if old is None else old.cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *sizes_of(docs))
    rows = rows.withColumn("old_shard", old).withColumn("block", F.pmod(F.shiftright("text_hash", 20), F.lit(buckets)))
    rows = scratch.keep(rows)
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), *(F.lit(None).cast("int").alias(c) for c in ("shard",)), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
    bucket, cap = total / (old_shards * buckets), total / shards
    # texts as heavy as a bucket are blocks of their own: at most old_shards * buckets of them
    heavy = rows.groupBy("old_shard", "text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= bucket)
    heavy = heavy.withColumn("deals", F.ceil(F.col("bytes") / cap))
    # so few by their definition that they go out to the rows, where a heavy text would meet in one task
    rows = rows.join(F.broadcast(heavy.select("old_shard", "text_hash", "deals")), ["old_shard", "text_hash"], "left")
    dealt_ = F.pmod(F.xxhash64("doc_id", "text_hash"), F.greatest("deals", F.lit(1)))
    # buckets are numbered below `buckets`; a heavy text is known by its hash, a dealt one also by its part
    block = F.when(F.col("deals").isNull(), F.col("block")).otherwise(F.xxhash64("text_hash", dealt_))
    rows = scratch.keep(rows.select("doc_id", "size", "text_crc32", "old_shard", block.cast("long").alias("block")))
    blocks = [tuple(r) for r in rows.groupBy("old_shard", "block").agg(F.sum("size"), F.count("*")).collect()]
    plan = spark.createDataFrame(place_blocks(blocks, shards), "old_shard int, block long, shard int, first long")
    # numbered within parts of a block, which follow each other: PARTS counts a block, not its rows, meet in a window
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    key = ["old_shard", "block", "part"]
    rows = rows.withColumn("part", part)
    upto = F.sum("n").over(Window.partitionBy("old_shard", "block").orderBy("part"))
    parts = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n")).join(plan, ["old_shard", "block"])
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size", "text_crc32"))
    out = rows.withColumn("nth", nth).join(parts.select(*key, "shard", (F.col("first") + F.col("before")).alias("start")), key)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def rewrite(docs: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Writes the files of the affected shards, with all their rows, and returns that table.

    A shard is affected if a row leaves or enters it; it is written whole.  One that keeps its rows gets no file,
    nor does one that has none left: its old files go.  ``plan`` is the result of reshard over the same
    rows: each row takes one row of the plan of its doc_id (or null), size and CRC.
    """
    key = ["doc_id", "size", "text_crc32"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.monotonically_increasing_id())).alias("nth")
    # rows alike in the key are alike in text: which takes which slot does not matter
    moved = plan.where("shard <> old_shard")
    hit = moved.select("shard").union(moved.select("old_shard")).distinct()
    places = plan.select(*key, "shard", "slot", nth)
    places = places.select(*(F.col(c).alias(f"plan_{c}") for c in [*key, "nth"]), "shard", "slot").join(F.broadcast(hit), "shard", "left_semi")
    clash = [c for c in ("shard", "slot") if c in docs.columns]
    rows = docs.select(F.struct(*(c for c in docs.columns if c not in clash)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *sizes_of(docs)[:2])
    rows = rows.select("row", *key, nth)
    same = [F.col(c).eqNullSafe(F.col(f"plan_{c}")) for c in [*key, "nth"]]
    out = rows.join(places, same).select("row.*", "slot", "shard")
    out.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(16))).write.partitionBy("shard").mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def op5_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents")).drop("old_shard")
