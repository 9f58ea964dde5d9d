"""MinHash near-duplicates by a chosen-path set similarity join.

Every document becomes the set of its five-word shingles and keeps ``POSITIONS`` minwise values of
it.  Each of ``TREES`` independent trees branches the documents recursively: a node picks one of
the positions, or two in one node out of three (4/3 = 1/0.75 branches on average, so that a pair
at the threshold is expected to go on together in one child), and documents with the same token
there meet in a child.  Nodes of at most ``LEAF`` documents are compared exhaustively, first by
their minwise values and then, on the full sets, link by link.  Repeating the trees carries the recall:
a pair at 0.75 in nodes of depth two is missed by 16 trees with a chance below 1e-5.

Nodes that stay large hold very similar documents or very common tokens.  Before it branches on,
such a node compares its members with one representative; if there is no member in the doubtful
zone, those that are surely similar leave the node with that link (anything they are linked with
is, by the triangle inequality of the Jaccard distance, linked or in the doubtful zone, but for the
error of the minwise estimates).  What is
still large at ``DEPTH`` is compared in full, block by block.

What may be linked within a leaf forms groups, each confirmed once wherever it was found.  Links only
have to connect the same documents, so a group skips a pair that is already connected and hands on a
spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, dealt, mix, pieces, shingle_set, table, whole_groups
from .components import connected_components

POSITIONS, TREES, LEAF, DEPTH, BROADCAST_HEADS = 128, 16, 2048, 10, 20_000
#: Minwise agreement (of POSITIONS) from which a pair is compared in full, and from which it is surely similar: 0.75 less 4.7 and more 3.9 standard deviations (0.038).
#: All trees share the same minwise values, so a pair below MAYBE is missed by all: at exactly 0.75 with a chance of 1.2e-6 (binomial, fewer than 72 of 128).
MAYBE, SURE = 0.57, 0.9

_MULT = mix(np.arange(1001, 1001 + POSITIONS, dtype=U64)) | U64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values of a set, as signed 32-bit integers."""
    low = np.full(POSITIONS, U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 1024):
        # shingle hashes are mixed already: a random odd multiplier orders them anew
        np.minimum(low, (_MULT[:, None] * shingles[None, at : at + 1024]).min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        n, k1, k2, mh = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            k1.append(int(np.bitwise_xor.reduce(mix(s + U64(7))).view(np.int64)) if len(s) else 0)
            k2.append(int(np.add.reduce(mix(s ^ U64(0xA5A5A5A5))).view(np.int64)) if len(s) else 0)
            mh.append(minwise(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(mh, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "k1", "k2", "mh"],
        )


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        roots = [self.find(x) for x in range(len(self.up))]
        far = [x for x, r in enumerate(roots) if r != x]
        return [roots[x] for x in far], far


def _alike(sk: np.ndarray, least: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of rows that agree in at least so many places, block by block, with their agreement."""
    n = len(sk)
    for a in range(0, n, block):
        for b in range(a, n, block):
            left, right = sk[a : a + block], sk[b : b + block]
            same = np.zeros((len(left), len(right)), dtype=np.uint8)
            for k in range(sk.shape[1]):
                same += left[:, k, None] == right[None, :, k]
            i, j = np.nonzero(same >= least)
            i, j, s = i + a, j + b, same[i, j]
            up = i < j
            yield i[up], j[up], s[up]


def _small_alike(sk: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int):
    """The same over many small groups at once: all pairs of rows of a group, by offset."""
    for off in range(1, int(sizes.max(initial=1))):
        g = np.flatnonzero(sizes > off)
        count = sizes[g] - off
        i = np.repeat(starts[g], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        for c in range(0, len(i), 8192):
            x = i[c : c + 8192]
            s = (sk[x] == sk[x + off]).sum(axis=1)
            ok = s >= least
            yield x[ok], x[ok] + off, s[ok]


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _compare_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, doc, sk) sorted by leaf -> (grp, doc): the sets of documents of a leaf that may be linked.

    A set is named by its members, so that it is the same set wherever it is found.
    """
    least = int(MAYBE * POSITIONS)
    for t in whole_groups(batches, "leaf", 20000):
        ids = t.column("doc").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
        starts, sizes = _bounds(t.column("leaf").to_numpy())
        small = sizes <= 24
        u = Union(len(ids))
        for i, j, _ in _small_alike(sk, starts[small], sizes[small], least):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                u.join(a, b)
        for at, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            for i, j, _ in _alike(sk[at : at + n], least):
                for a, b in zip((i + at).tolist(), (j + at).tolist(), strict=True):
                    u.join(a, b)
        root = np.fromiter(map(u.find, range(len(ids))), dtype=np.int64, count=len(ids))
        order = np.argsort(root, kind="stable")
        begin, n = _bounds(root[order])
        names = np.add.reduceat(mix(ids[order].view(U64) + U64(3)), begin).view(np.int64)
        many = np.repeat(n > 1, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)[many]), pa.array(ids[order][many])], names=["grp", "doc"])


def _links(sets: list[np.ndarray], u: Union) -> None:
    """Joins in u the true links: 100 * intersection >= 75 * union, on full sets.

    One row of the comparison at a time, with the later documents of a fitting size that are not connected
    with it yet.  What they share is counted the cheaper way: from the documents that hold its shingles, or
    from their shingles that it holds.  Both ways are exact.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    _, ids, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    end = np.cumsum(size)
    own = [ids[e - k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True)]
    # the documents that hold a shingle stand together, in their order
    holders = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(ids, kind="stable")]
    first = np.cumsum(held) - held
    mark = np.zeros(len(held), dtype=bool)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero((root[i + 1 :] != root[i]) & (4 * np.minimum(size[i + 1 :], size[i]) >= 3 * np.maximum(size[i + 1 :], size[i]))) + i + 1
        if not len(near):
            continue
        many = held[own[i]]
        if many.sum() <= size[near].sum():
            shared = own[i][many > 1]
            common = np.zeros(n, dtype=np.int64)
            # so many at once that the gathered holders stay few
            step = max(1, (1 << 22) // n)
            for at in range(0, len(shared), step):
                part = shared[at : at + step]
                k = held[part]
                to = np.cumsum(k)
                common += np.bincount(holders[np.arange(to[-1]) + np.repeat(first[part] - to + k, k)], minlength=n)
            common = common[near]
        else:
            mark[own[i]] = True
            common = np.empty(len(near), dtype=np.int64)
            # so many at once that the gathered shingles stay few
            for at in range(0, len(near), 64):
                part = near[at : at + 64]
                got = mark[np.concatenate([own[j] for j in part])]
                common[at : at + 64] = np.add.reduceat(got, np.concatenate(([0], np.cumsum(size[part])[:-1])), dtype=np.int64)
            mark[own[i]] = False
        for j in near[100 * common >= 75 * (size[i] + size[near] - common)].tolist():
            u.join(i, j)
            root[root == root[j]] = root[i]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, doc, text) sorted by grp -> a spanning forest of the true links within each group."""
    for t in whole_groups(batches, "grp", 64):
        starts, sizes = _bounds(t.column("grp").to_numpy())
        ids, texts = t.column("doc").to_numpy(), t.column("text")
        out_a, out_b = [], []
        for at, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n < 2:
                continue
            u = Union(n)
            _links([shingle_set(x.as_py()) for x in texts.slice(at, n)], u)
            a, b = u.stars()
            out_a.append(ids[at : at + n][a])
            out_b.append(ids[at : at + n][b])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def _token(pos) -> F.Column:
    return F.expr(f"element_at(mh, cast({pos} + 1 as int))")


def _leaves(sets: DataFrame, scratch: Scratch, leaf: int, depth: int) -> DataFrame:
    """(leaf, doc) of the nodes that are small enough to compare, each set of documents once."""
    step = POSITIONS // TREES
    root = [F.xxhash64(F.lit(t), _token(t * step)) for t in range(TREES)]
    root += [F.xxhash64(F.lit(t), F.lit(-1), _token(t * step + step // 2)) for t in range(0, TREES, 3)]
    rows = sets.select("doc", F.explode(F.array(*root)).alias("node"))
    first = F.xxhash64("node", _token(f"pmod(node, {POSITIONS})"))
    second = F.when(F.expr("pmod(shiftright(node, 7), 3) = 0"), F.xxhash64("node", F.lit(2), _token(f"pmod(shiftright(node, 20), {POSITIONS})")))
    out, held = [], sets
    for level in range(1, depth + 1):
        nodes = scratch.keep(
            rows.groupBy("node")
            .agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc))").alias("x"), F.expr("bit_xor(xxhash64(doc, 1))").alias("y"), F.min("doc").alias("pivot"))
            .where("n > 1")
        )
        once = nodes.where(F.col("n") <= leaf).groupBy("n", "x", "y").agg(F.min("node").alias("node"))
        out.append(scratch.keep(rows.join(once.select("node"), "node").select(F.col("node").alias("leaf"), "doc")))
        large = scratch.keep(nodes.where(F.col("n") > leaf).select("node", "n", "pivot"))
        heads = large.count()
        if not heads:
            break
        # only documents of large nodes go on, each with its minwise values once
        members = scratch.keep(rows.join(large, "node"))
        held = scratch.keep(held.select("doc", "mh").join(members.select("doc").distinct(), "doc"))
        head = large.select("node", F.col("pivot").alias("doc")).join(held, "doc").select("node", F.col("mh").alias("head"))
        head = F.broadcast(head) if heads <= BROADCAST_HEADS else head
        near = F.expr(f"aggregate(zip_with(mh, head, (p, q) -> int(p = q)), 0, (s, e) -> s + e) / {POSITIONS}D")
        members = members.join(held, "doc").join(head, "node").select("node", "doc", "n", "pivot", near.alias("near"), first.alias("first"), second.alias("second"))
        members = scratch.keep(members)
        doubtful = members.groupBy("node").agg(F.max(F.col("near").between(MAYBE, SURE)).alias("doubt"))
        # one representative and a bounded part of the members similar to it, as leaves of their own
        part = members.where(F.col("near") >= MAYBE).select(
            F.xxhash64("node", F.lit("pivot"), F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / (leaf // 2)))).alias("leaf"), "doc", "pivot"
        )
        out.append(scratch.keep(part.select("leaf", "doc").union(part.select("leaf", F.col("pivot").alias("doc"))).distinct()))
        on = members.join(doubtful, "node").where(F.col("doubt") | (F.col("near") < MAYBE))
        if level == depth:
            # compared in full: every pair of blocks is a leaf
            blocks = F.greatest(F.lit(2), F.ceil(F.col("n") / (leaf // 2)))
            full = on.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("doc", F.lit(5)), "blocks"))
            full = full.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            out.append(scratch.keep(full.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("leaf"), "doc").distinct()))
            break
        rows = scratch.keep(on.select("doc", F.explode(F.array_compact(F.array("first", "second"))).alias("node")))
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def near_duplicates(docs: DataFrame, *, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each input row.

    Rows are told apart by doc_id; a repeated doc_id with the same text is one document twice, and
    with other texts it links both.  A null or empty text, or one of blanks, has no shingles and is
    linked with nothing.  A null doc_id keeps a null component and is not kept.  Long texts are compared by the full sets of
    their shingles.  Of equals the smallest doc_id stands for the group.  Other columns of any name are not read.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.keep(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, k1 long, k2 long, mh array<int>"))
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "k1", "k2"]
    # one representative for each distinct set
    reps = filled.groupBy(*same).agg(F.min_by("mh", "doc_id").alias("mh"), F.min("doc_id").alias("doc"))
    sk = F.expr("unhex(array_join(transform(mh, m -> right(concat('0', hex(m)), 2)), ''))")
    sets = scratch.keep(reps.withColumn("sk", sk))
    leaves = _leaves(sets, scratch, leaf, depth)
    rows = leaves.join(sets.select("doc", "sk"), "doc").select("leaf", "doc", "sk")
    groups = scratch.keep(dealt(rows, "leaf").mapInArrow(_compare_leaves, "grp long, doc long").distinct())
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    links = dealt(groups.hint("merge").join(texts, "doc").select("grp", "doc", "text"), "grp").mapInArrow(_confirm, "a long, b long")
    # a doc_id that stands for more than one set links them
    own = filled.join(reps.select(*same, "doc"), same).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    twice = own.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi")
    links = links.union(own.join(twice.select("a"), "a"))
    roots = scratch.keep(connected_components(links, scratch))
    rep = filled.groupBy(*same).agg(F.min("doc_id").alias("doc"))
    by_set = rep.join(roots, rep.doc == roots.id, "left").select(*same, F.coalesce("root", "doc").alias("set_root"))
    out = sketch.select("doc_id", *same).join(by_set, same, "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("set_root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def op1_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM sizes x WHERE x.doc_id = a.doc_id) + (SELECT n FROM sizes y WHERE y.doc_id = b.doc_id) - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN comp c ON c.id = d.doc_id
"""
