"""Exact repeated substrings, by column-wise construction of sorted suffixes with common prefixes.

A string of ``length`` bytes that starts at two places is removed at both.  Every such string is known
by its anchor: the k-gram of least hash in it (the leftmost).  Equal strings have equal anchors at
equal offsets, so the windows of a text fall into runs of one anchor, and only runs whose anchor occurs
elsewhere can hold a repeat.  These runs (segments) meet by anchor.

Over the segments of whole anchors, lined up at it, a task inserts one symbol of each segment a round, from
the last column to the first: the symbols, in the order of the suffixes so far, are the column of the
Burrows-Wheeler transform; sorting them stably orders the longer suffixes, and the common prefix of
two that become neighbours is one more than the least of those between them.  A window is a repeat where
that prefix with a neighbour has ``length``.  Columns of a large batch lie in a sequential temporary
file, so memory grows with the number of segments, not with their bytes.

Copies of a whole text are one text (and all repeated).  Runs of anchors that occur more than ``HOT`` times are
split by further anchors of their windows, ``LEVELS`` times at most; their parts are counted before their bytes
move, and equal parts are merged before they meet.

A second pass by the same method takes words for symbols (two bytes of each word's hash): passages of
``PASSAGE`` words and more that stand in more than one document.  400 bytes are some 70 words of prose, so
shorter passages are only seen by this pass.  Nothing is removed by it; it counts.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, U64, Scratch, dealt, mix, pieces, prefix_hash, range_hash, table, whole_groups, word_hashes

LENGTH, GRAM, HOT, LEVELS, BATCH, IN_MEMORY = 400, 32, 20_000, 6, 8192, 64 << 20
#: Words of a passage, and of the grams that anchor it.
PASSAGE, PASSAGE_GRAM = 50, 8
_CHUNK = 1 << 22


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def as_words(text: str) -> bytes:
    """Two bytes of the hash of each word (A-Z as a-z, blanks of any kind and number between them)."""
    return (word_hashes(np.frombuffer(as_bytes(text), dtype=np.uint8)) >> U64(48)).astype("<u2").tobytes()


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(buf) - k + 1)
    return range_hash(prefix_hash(BYTE[buf]), at, at + k)


def _sliding(key: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return key


def runs(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (inclusive) and anchor position of each run, for windows of ``width`` grams."""
    pos = U64(0xFFFFFF)
    firsts, anchors = [], []
    count = len(h) - width + 1
    for at in range(0, count, _CHUNK):
        part = h[at : at + _CHUNK + width - 1]
        low = _sliding((part & ~pos) | np.arange(len(part), dtype=U64), width)
        where = (low[:_CHUNK] & pos).astype(np.int64) + at
        new = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        firsts.append(new + at)
        anchors.append(where[new])
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    return first, np.append(first[1:], count) - 1, anchor


def repeated_windows(segs: list[bytes], rel: np.ndarray, bucket: np.ndarray, length: int, width: int, owner: np.ndarray | None = None) -> np.ndarray:
    """For segments sorted by bucket, with their anchors at offset ``rel``: [i, j] is whether the window
    that starts ``j`` columns from the left end of the longest possible segment is in another of the bucket.
    With ``owner`` (a number for each segment), whether it is in one of another owner."""
    m, left, cols = len(segs), width - 1, width - 1 + length
    size = np.fromiter(map(len, segs), dtype=np.int64, count=m)
    begin = left - rel
    file = None
    if m * cols * 2 <= IN_MEMORY:
        grid = np.full((cols, m), 256, dtype=np.uint16)
    else:  # columns in a sequential file of this task
        file = tempfile.TemporaryFile()
        grid = np.memmap(file, dtype=np.uint16, mode="w+", shape=(cols, m))
        grid[:] = 256
    flat, starts = np.frombuffer(b"".join(segs), dtype=np.uint8), np.concatenate(([0], np.cumsum(size)[:-1]))
    for c in range(cols):
        on = np.flatnonzero((begin <= c) & (c < begin + size))
        grid[c, on] = flat[starts[on] + c - begin[on]]
    base = np.concatenate(([0], np.cumsum(bucket[1:] != bucket[:-1]))).astype(np.int64) * 257
    bits = max(1, int(m - 1).bit_length())
    here, mask = np.arange(m, dtype=np.int64), (1 << bits) - 1
    order, lcp = np.arange(m), np.zeros(m, dtype=np.int64)
    found = np.zeros((m, left + 1), dtype=bool)
    last = begin + size - length
    for c in range(cols - 1, -1, -1):
        sym = grid[c][order]  # this round's column of the transform
        key = base + sym
        placed = np.sort((key << bits) | here) & mask
        same = np.concatenate(([False], (key[placed[1:]] == key[placed[:-1]]) & (sym[placed[1:]] != 256)))
        new = np.zeros(m, dtype=np.int64)
        near = same.copy()
        near[1:] &= placed[1:] == placed[:-1] + 1
        new[near] = lcp[placed[near]] + 1
        far = np.flatnonzero(same & ~near)
        if len(far):
            lo, hi = placed[far - 1] + 1, placed[far] + 1
            # the least prefix strictly between, for pairs that other symbols stood between
            pairs = np.empty(2 * len(far), dtype=np.int64)
            pairs[::2], pairs[1::2] = lo, hi
            new[far] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2] + 1
        order, lcp = order[placed], new
        if c <= left:
            hit = lcp >= length
            if owner is None:
                hit[:-1] |= hit[1:]
            else:  # equal windows stand together: a run of them counts if it has two owners
                first = np.flatnonzero(~hit)
                who = owner[order]
                many = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
                hit = np.repeat(many, np.diff(np.append(first, m)))
            own = order[hit]
            found[own, c] = (begin[own] <= c) & (c <= last[own])
    if file is not None:
        del grid
        file.close()
    return found


def _anchors(length: int, gram: int, passage: int, passage_gram: int):
    def keys_of(raw: bytes, length: int, gram: int) -> np.ndarray:
        if len(raw) < length:
            return np.empty(0, dtype=np.int64)
        h = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
        return h[runs(h, length - gram + 1)[2]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            size, words, sha, own, keys, word_keys = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw, told = as_bytes(text), as_words(text)
                size.append(len(raw))
                words.append(len(told) // 2)
                digest = hashlib.sha256(raw)
                sha.append(digest.hexdigest())
                own.append(digest.digest()[:16])
                keys.append(keys_of(raw, length, gram))
                word_keys.append(keys_of(told, 2 * passage, 2 * passage_gram))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(words, pa.int64()), pa.array(sha, pa.string()), pa.array(own, pa.binary()), pa.array(keys, longs), pa.array(word_keys, longs)],
                names=["doc_id", "n_bytes", "n_words", "sha", "own", "keys", "word_keys"],
            )

    return run


def _parts(h: np.ndarray, width: int, final: set[int], hot: set[int], levels: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(level, key, first window, last window, anchor) of the runs that are final, or reach the last level.

    A run with a hot anchor is split by further anchors, of its windows under another hash; equal windows
    are split alike, and a part is named by all its anchors.
    """
    a, b, p = runs(h, width)
    now = list(zip(h[p].view(np.int64).tolist(), a.tolist(), b.tolist(), p.tolist(), strict=True))
    for level in range(levels + 1):
        split = []
        for part in now:
            if level == levels or part[0] in final:
                yield level, *part
            elif part[0] in hot:
                split.append(part)
        now = []
        for key, s, e, _ in split:
            g = mix(h[s : e + width] + U64(level + 1))
            x, y, q = runs(g, width)
            names = mix(g[q] ^ U64(key & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            now += [(n, s + u, s + v, s + w) for n, u, v, w in zip(names.tolist(), x.tolist(), y.tolist(), q.tolist(), strict=True)]
        if not now:
            return


def _finer(length: int, gram: int, level: int, raw_of):
    """(text, own, hot) -> (own, key, id) of the parts of hot runs at a level (at level 0, the hot runs): their names and a hash of their bytes."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            owns, keys, ids = [], [], []
            for text, own, hot in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw, hot = raw_of(text), set(hot)
                h = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
                for _, k, s, e, at in _parts(h, width, set(), hot, level):
                    if level or k in hot:
                        owns.append(own)
                        keys.append(k)
                        ids.append(hashlib.md5(b"%d:" % (at - s) + raw[s : e + length]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(owns, pa.binary()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["own", "key", "id"])

    return run


def _segments(length: int, gram: int, levels: int, raw_of):
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for text, own, final, hot in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = raw_of(text)
                final, hot = set(final or ()), set(hot or ())
                h = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
                alike: dict[tuple, list[int]] = {}
                for level, k, s, e, at in _parts(h, width, final, hot, levels):
                    if k not in final:
                        continue
                    if level or k in hot:
                        alike.setdefault((k, at - s, raw[s : e + length]), []).append(s)
                    else:
                        rows.append((k, own, [s], at - s, raw[s : e + length], False))
                rows += [(k, own, starts, r, seg, True) for (k, r, seg), starts in alike.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "own", "first", "rel", "seg", "hot"])

    return run


def _find(length: int, gram: int, across: bool):
    """(key, own, first, rel, seg, who, all) sorted by key -> (own, first, lo, hi) of repeated runs; ``all``: every window of the piece repeats."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", BATCH):
            keys = t.column("key").to_numpy()
            rel = t.column("rel").to_numpy().astype(np.int64)
            segs = t.column("seg").to_pylist()
            owner = None
            if across:
                who = t.column("who").combine_chunks()
                owner = who.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                # a piece of several owners differs from each single one
                owner = np.where(owner < 0, len(segs) + np.arange(len(segs)), owner)
            found = repeated_windows(segs, rel, keys, length, width, owner)
            for i in np.flatnonzero(t.column("all").to_numpy(zero_copy_only=False)).tolist():
                begin = width - 1 - int(rel[i])
                found[i, begin : begin + len(segs[i]) - length + 1] = True
            step = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            who, start = np.nonzero(step == 1)
            _, end = np.nonzero(step == -1)
            shift = rel[who] - (width - 1)
            yield pa.RecordBatch.from_arrays(
                [t.column("own").combine_chunks().take(pa.array(who)), t.column("first").combine_chunks().take(pa.array(who)), pa.array(start + shift), pa.array(end + shift - 1 + length)],
                names=["own", "first", "lo", "hi"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        owns, gone, count, kept, text_out = [], [], [], [], []
        for own, text, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            raw = as_bytes(text)
            spans = merged(list(zip(lo, hi, strict=True)))
            rest, at = [], 0
            for a, b in spans:
                rest.append(raw[at:a])
                at = b
            rest.append(raw[at:])
            owns.append(own)
            gone.append(sum(b - a for a, b in spans))
            count.append(len(spans))
            kept.append(hashlib.sha256(b"".join(rest)).hexdigest())
            text_out.append([x for s in spans for x in s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(owns, pa.binary()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string()), pa.array(text_out, pa.list_(pa.int64()))],
            names=["own", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def _passages(length: int):
    """(own, lo, hi) over two-byte words -> (own, words in passages, passages); windows that start amid a word do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = [], []
            for lo, hi in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                even = [((a + 1) // 2, (b - length) // 2 + length // 2) for a, b in zip(lo, hi, strict=True)]
                spans = merged([(a, b) for a, b in even if b - a >= length // 2])
                words.append(sum(b - a for a, b in spans))
                count.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(count, pa.int64())], names=["own", "n_passage_words", "n_passages"])

    return run


def _spans(by_own: DataFrame, at: DataFrame, scratch: Scratch, *, length: int, gram: int, hot: int, raw_of, across: bool) -> DataFrame:
    """(own, text) and the anchors of each distinct text (own, key) -> (own, lo, hi): where repeated strings start and end, arrays.

    ``across``: only strings of more than one text.
    """
    counts = scratch.keep(at.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    final = [at.join(counts.where(F.col("n") <= hot).select("key"), "key").select("own", "key").distinct()]
    crowd, hots, level = counts.where(F.col("n") > hot), None, 0
    while crowd.take(1):
        # crowded anchors: equal pieces count once, by a hash of their bytes; if the different ones are few they
        # can meet, else further anchors split them, and their parts are counted before any bytes move
        mine = at.join(crowd.select("key"), "key").select("own", "key").distinct()
        hots = scratch.keep(mine if hots is None else hots.union(mine))
        again = by_own.join(hots.groupBy("own").agg(F.collect_set("key").alias("hot")), "own").dropDuplicates(["own"]).select("text", "own", "hot")
        at = scratch.keep(again.mapInArrow(_finer(length, gram, level, raw_of), "own binary, key long, id binary"))
        counts = scratch.keep(at.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("id").alias("kinds")).where("n > 1"))
        crowd = counts.where(F.lit(level < LEVELS) & (F.col("kinds") > hot))
        good = counts.where(F.lit(level == LEVELS) | (F.col("kinds") <= hot))
        final.append(at.join(good.select("key"), "key").select("own", "key").distinct())
        at, level = at.select("own", "key"), level + 1
    levels = max(0, level - 1)
    wanted = final[0]
    for df in final[1:]:
        wanted = wanted.union(df)
    wanted = wanted.groupBy("own").agg(F.collect_set("key").alias("final"))
    if hots is not None:
        wanted = wanted.join(hots.groupBy("own").agg(F.collect_set("key").alias("hot")), "own", "left")
    else:
        wanted = wanted.withColumn("hot", F.lit(None).cast("array<bigint>"))
    first = by_own.join(scratch.keep(wanted), "own").dropDuplicates(["own"])
    segs = first.select("text", "own", "final", "hot").mapInArrow(_segments(length, gram, levels, raw_of), "key long, own binary, first array<long>, rel int, seg binary, hot boolean")
    out = "own binary, first array<long>, lo long, hi long"
    plain = lambda df: df.select("key", "own", "first", "rel", "seg", F.col("own").alias("who") if across else F.lit(None).cast("binary").alias("who"), F.lit(False).alias("all"))
    if hots is None:
        hits = dealt(plain(segs), "key").mapInArrow(_find(length, gram, across), out)
    else:
        segs = scratch.keep(segs)
        named = segs.where("hot").withColumn("id", F.md5(F.concat(F.col("key").cast("string").cast("binary"), F.col("rel").cast("string").cast("binary"), F.col("seg"))))
        once = named.groupBy("key", "rel", "seg", "id").agg(F.sum(F.size("first")).alias("n"), F.min("own").alias("one"), F.max("own").alias("other"))
        several = F.col("one") != F.col("other")
        repeats = several if across else F.col("n") > 1
        once = once.select("key", F.col("id").cast("binary").alias("own"), F.array().cast("array<bigint>").alias("first"), "rel", "seg", F.when(~several, F.col("one")).alias("who"), repeats.alias("all"))
        hits = scratch.keep(dealt(plain(segs.where("not hot")).union(once), "key").mapInArrow(_find(length, gram, across), out))
        back = hits.where(F.length("own") == 32).select(F.col("own").cast("string").alias("id"), "lo", "hi").join(named.select("id", "own", "first"), "id")
        hits = hits.where(F.length("own") == 16).select("own", "first", "lo", "hi").union(back.select("own", "first", "lo", "hi"))
    each = F.expr("transform(first, f -> named_struct('lo', f + lo, 'hi', f + hi))")
    spans = hits.groupBy("own").agg(F.flatten(F.collect_list(each)).alias("s"))
    return scratch.keep(spans.select("own", F.expr("s.lo"), F.expr("s.hi")))


def repeated_substrings(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_words, n_passage_words, n_passages, removed; one row for each input row.

    ``removed`` has the starts and ends of the removed runs of bytes in turn.  ``n_passage_words`` counts the
    words within strings of ``passage`` words and more that another document has too, ``n_passages`` their maximal runs.
    Null texts are empty, and a text shorter than ``length`` loses nothing.  Two rows of one doc_id, or of
    none, count as two documents; equal rows are copies, removed whole from ``length`` bytes on.  Which of equal strings
    is kept is never a tie: all go.  Long texts are read whole; their suffixes are never held at once, only their
    segments.  Other columns of any name are not read.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = scratch.keep(docs.mapInArrow(_anchors(length, gram, passage, passage_gram), "doc_id long, n_bytes long, n_words long, sha string, own binary, keys array<long>, word_keys array<long>"))
    texts = scratch.keep(known.groupBy("own").agg(F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("word_keys").alias("word_keys")))
    by_own = docs.withColumn("own", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    spans = _spans(by_own, texts.select("own", F.explode("keys").alias("key")), scratch, length=length, gram=gram, hot=hot, raw_of=as_bytes, across=False)
    words = _spans(by_own, texts.select("own", F.explode("word_keys").alias("key")), scratch, length=2 * passage, gram=2 * passage_gram, hot=hot, raw_of=as_words, across=True)
    # texts of which only parts go; whole copies are known already
    copies = texts.select("own", "copies")
    single = copies.where("copies = 1").select("own").join(spans, "own")
    cut = by_own.join(single, "own").select("own", "text", "lo", "hi").mapInArrow(_cut, "own binary, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
    told = words.mapInArrow(_passages(2 * passage), "own binary, n_passage_words long, n_passages long")
    result = known.select("doc_id", "n_bytes", "n_words", "sha", "own").join(copies, "own").join(cut, "own", "left").join(told, "own", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    told_whole = (F.col("copies") > 1) & (F.col("n_words") >= passage)
    pick = lambda c, all_, none, when=whole: F.when(when, all_).otherwise(F.coalesce(c, none)).alias(c)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return result.select(
        "doc_id",
        "n_bytes",
        pick("n_removed", F.col("n_bytes"), zero),
        pick("n_spans", one, zero),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha")),
        "n_words",
        pick("n_passage_words", F.col("n_words"), zero, told_whole),
        pick("n_passages", one, zero, told_whole),
        pick("removed", F.array(zero, F.col("n_bytes")), F.array().cast("array<bigint>")),
    )


def op2_columnwise_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("removed")
