"""Searches that score within the scan: a task keeps its best rows of each query, so what moves grows with queries and tasks, not with pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Cells of scores that are in memory at once.
CELLS = 1 << 21


def unique_key(rows: DataFrame, key: str) -> bool:
    """Whether no key comes twice, so that a row can be counted where it is read."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists (of null: 0) and their values in one array."""
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0), dtype=np.int64)
    return size, pc.list_flatten(col)


def _runs(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) in order, with how often each comes."""
    key, count = np.unique(rows * n + codes, return_counts=True)
    return key // n, key % n, count


def _known(col: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists, and of the terms in the vocabulary (row, code, times)."""
    size, values = _lists(col)
    found = pc.index_in(values, value_set=vocabulary)
    held = np.asarray(found.is_valid())
    code = np.asarray(found.drop_null(), dtype=np.int64)
    return size, *_runs(code, np.repeat(np.arange(len(size)), size)[held], max(len(vocabulary), 1))


class _Table:
    """What each of the words, by its place, goes with."""

    def __init__(self, place: np.ndarray, words: int):
        self.count = np.bincount(place, minlength=words)
        self.first = np.cumsum(self.count) - self.count

    def __call__(self, code: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For codes: which of them (from ``at`` on), and the place in the table of what it goes with."""
        n = self.count[code]
        entry = np.repeat(np.arange(len(code)), n)
        return entry + at, self.first[code[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)


def counted(rows: DataFrame, pairs: list[tuple[str, str]]) -> tuple[dict[str, int], dict[str, int]]:
    """(doc, t) and (word, term: what the word stands for) -> how many rows hold each term, and of all rows: n, texts (not null), filled (with words), size (words)."""
    words, terms = sorted({w for w, _ in pairs}), sorted({t for _, t in pairs})
    at_word, at_term = ({x: i for i, x in enumerate(names)} for names in (words, terms))
    places = np.array(sorted({(at_word[w], at_term[t]) for w, t in pairs}), dtype=np.int64).reshape(-1, 2)
    table, of, vocabulary = _Table(places[:, 0], len(words)), places[:, 1], pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, sums = np.zeros(len(terms), dtype=np.int64), np.zeros(4, dtype=np.int64)
        for batch in batches:
            size, row, code, _ = _known(batch.column(0), vocabulary)
            entry, at = table(code)
            held = np.unique(row[entry] * max(len(terms), 1) + of[at]) % max(len(terms), 1)
            df += np.bincount(held, minlength=len(terms))[: len(terms)]
            sums += (len(size), len(size) - batch.column(0).null_count, np.count_nonzero(size), size.sum())
        some = np.flatnonzero(df)
        part = np.concatenate((np.full(len(some), -1), np.arange(4)))
        yield pa.RecordBatch.from_arrays([pa.array([terms[i] for i in some] + [None] * 4, pa.string()), pa.array(part, pa.int32()), pa.array(np.concatenate((df[some], sums)))], names=["term", "part", "n"])

    got = rows.select("t").mapInArrow(run, "term string, part int, n long").groupBy("term", "part").agg(F.sum("n").alias("n")).collect()  # a row a term, and four
    sums = {r["part"]: r["n"] for r in got if r["part"] >= 0}
    return {r["term"]: r["n"] for r in got if r["part"] < 0}, {name: sums.get(i, 0) for i, name in enumerate(("n", "texts", "filled", "size"))}


class _Best:
    """The best k rows of each query so far: score descending, then doc."""

    def __init__(self, queries: int, k: int, schema: pa.Schema, least: float = 0.0):
        self.k, self.schema, self.least, self.held, self.rows = k, schema, np.full(queries, least), [], 0
        self.most = 4 * k * queries + (1 << 16)

    def add(self, score: np.ndarray, doc: pa.Array) -> None:
        """Scores (rows x queries), those under the least being none."""
        good = score >= self.least
        if len(score) > self.k and np.count_nonzero(good) > self.most:
            self.least = np.maximum(self.least, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
            good &= score >= self.least
        at, q = np.nonzero(good)
        if len(at):
            self.held.append(pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), doc.take(pa.array(at)), pa.array(score[at, q])], schema=self.schema))
            self.rows += len(at)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> pa.Table:
        t = pa.Table.from_batches(self.held, self.schema)
        t = t.take(pc.sort_indices(t, [("q", "ascending"), ("score", "descending"), ("doc", "ascending")]))
        q = np.asarray(t.column("q"), dtype=np.int64)
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        t = t.filter(pa.array(nth < self.k)).combine_chunks()
        kth = np.asarray(t.column("score"))[(nth := nth[nth < self.k]) == self.k - 1] if self.k else np.empty(0)
        self.least[np.asarray(t.column("q"), dtype=np.int64)[nth == self.k - 1]] = kth
        self.held, self.rows = t.to_batches(), t.num_rows
        return t


def best(rows: DataFrame, weights: list[tuple], id_type: str, *, k: int, saturation: tuple[float, float, float] | None = None) -> DataFrame:
    """(doc, t) x (term, query_id, weight) -> (query_id, doc, score): the best k of each query of each task, to be ranked.

    A score is the sum of weight times how often the row has the term, to six digits, if it is above 0; with ``saturation``
    (k1, b, mean length) the count is that of BM25, and a row with any term has a score.
    """
    terms = sorted({w[0] for w in weights})
    ids = sorted({w[1] for w in weights})
    kind = rows.schema["doc"].dataType.simpleString()
    queries = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, query_id {id_type}")
    place, nth = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
    triples = sorted((place[t], nth[q], float(w)) for t, q, w in weights)
    of_term, of_query, weight = (np.array([x[i] for x in triples], dtype=d) for i, d in enumerate((np.int64, np.int64, np.float64)))
    table = _Table(of_term, len(terms))
    vocabulary = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            doc = batch.column(0)
            top = top or _Best(len(ids), k, pa.schema([("q", pa.int32()), ("doc", doc.type), ("score", pa.float64())]))
            size, row, code, times = _known(batch.column(1), vocabulary)
            value = times.astype(np.float64)
            if saturation:
                k1, b, mean = saturation
                value = value * (k1 + 1) / (value + k1 * (1 - b + b * size[row] / mean))
            # rows in pieces of about CELLS scores and products
            cost = np.cumsum(np.bincount(row, weights=table.count[code], minlength=len(size)) + len(ids))
            start = 0
            while start < len(size):
                done = cost[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(cost, done + CELLS, side="right")))
                lo, hi = np.searchsorted(row, (start, end))
                entry, at = table(code[lo:hi], lo)
                cell = (row[entry] - start) * len(ids) + of_query[at]
                score = np.bincount(cell, weights=weight[at] * value[entry], minlength=(end - start) * len(ids)).reshape(end - start, len(ids))
                some = np.flatnonzero(score.any(axis=1))
                score = score[some]
                score, none = np.floor(score * 1e6 + 0.5) / 1e6, score == 0
                top.add(np.where(none if saturation else score <= 0, -1.0, score), doc.slice(start, end - start).take(pa.array(some)))
                start = end
        if top and top.held:
            yield from top.cut().to_batches()

    found = rows.select("doc", "t").mapInArrow(run, f"q int, doc {kind}, score double") if weights else rows.select(F.lit(0).alias("q"), "doc", F.lit(0.0).alias("score")).limit(0)
    return found.join(F.broadcast(queries), "q").select("query_id", "doc", "score")


def nearest(rows: DataFrame, queries: pa.Table, id_type: str, *, k: int) -> DataFrame:
    """(doc, t: a vector) x (query_id, embedding) -> (query_id, doc, score): cosines to six digits, the best k of each query of each task, to be ranked.

    Only vectors of a query's length are compared; one of length zero counts as of norm 1.
    """
    spark, kind = rows.sparkSession, rows.schema["doc"].dataType.simpleString()
    ids = queries.column("query_id").to_pylist()
    sides = {}  # length -> which queries, their vectors
    size, values = _lists(queries.column("embedding").combine_chunks())
    values, ends = np.asarray(values, dtype=np.float64), np.cumsum(size)
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        sides[n] = of, values[(ends[of] - n)[:, None] + np.arange(n)]
    held = spark.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {}
        unit = lambda m: m / np.where((norm := np.sqrt((m * m).sum(axis=1))) == 0, 1.0, norm)[:, None]
        mine = {n: (of, unit(m).T.copy()) for n, (of, m) in held.value.items()}
        for batch in batches:
            schema = pa.schema([("q", pa.int32()), ("doc", batch.schema.field(0).type), ("score", pa.float64())])
            doc, (size, values) = batch.column(0), _lists(batch.column(1))
            values, ends = np.asarray(values, dtype=np.float64), np.cumsum(size)
            valid = np.asarray(batch.column(1).is_valid())
            for n, (of, right) in mine.items():
                best = top.setdefault(n, _Best(len(of), k, schema, -2.0))
                at = np.flatnonzero((size == n) & valid)
                for i in range(0, len(at), step := max(64, CELLS // len(of))):
                    some = at[i : i + step]
                    score = unit(values[(ends[some] - n)[:, None] + np.arange(n)]) @ right
                    best.add(np.floor(score * 1e6 + 0.5) / 1e6, doc.take(pa.array(some)))
        for n, best in top.items():
            if best.held:
                for b in best.cut().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(mine[n][0][np.asarray(b.column(0))], pa.int32()), b.column(1), b.column(2)], names=["q", "doc", "score"])

    found = rows.select("doc", "t").mapInArrow(run, f"q int, doc {kind}, score double")
    names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {id_type}")
    return found.join(F.broadcast(names), "q").select("query_id", "doc", "score")


def term_counts(rows: DataFrame) -> DataFrame:
    """(doc, t) with a key of its own in every row -> (doc, dl, term, tf), counted where it is read."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, values = _lists(batch.column(1))
            coded = pc.dictionary_encode(values)
            row, code, times = _runs(np.asarray(coded.indices, dtype=np.int64), np.repeat(np.arange(len(size)), size), max(len(coded.dictionary), 1))
            for i in range(0, len(row), 1 << 16):
                part = slice(i, i + (1 << 16))
                at = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(size[row[part]], pa.int32()), coded.dictionary.take(pa.array(code[part])), pa.array(times[part], pa.int64())], names=["doc", "dl", "term", "tf"])

    return rows.select("doc", "t").mapInArrow(run, f"doc {kind}, dl int, term string, tf long")


def holding(rows: DataFrame, keyed: list[tuple], id_type: str) -> DataFrame:
    """(doc, text, t) x (query_id, low, run or null) -> (query_id, doc): texts that hold low; a text must have the run, if there is one, among its t."""
    kind = rows.schema["doc"].dataType.simpleString()
    terms = sorted({r for _, _, r in keyed if r is not None})
    by_term = {t: [] for t in terms}
    for q, low, r in keyed:
        if r is not None:
            by_term[r].append((q, low))
    by_code = [by_term[t] for t in terms]
    plain = [(q, low) for q, low, r in keyed if r is None]
    vocabulary, kinds = pa.array(terms, pa.string()), to_arrow_type(rows.sparkSession.createDataFrame([], f"q {id_type}").schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, at = batch.column(1), [], []
            _, row, code, _ = _known(batch.column(2), vocabulary)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            code = code.tolist()
            for i in range(batch.num_rows):
                if cut[i] == cut[i + 1] and not plain:
                    continue
                whole = text[i].as_py()
                if whole is None:
                    continue
                for group in [plain, *(by_code[c] for c in code[cut[i] : cut[i + 1]])]:
                    for q, low in group:
                        if low in whole:
                            ids.append(q)
                            at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds), batch.column(0).take(pa.array(at, pa.int64()))], names=["query_id", "doc"])

    return rows.select("doc", "text", "t").mapInArrow(run, f"query_id {id_type}, doc {kind}")


def keywords(rows: DataFrame, df: pa.Table, n: int, k: int) -> DataFrame:
    """(doc, t) with a key of its own in every row, and (term, df) of all terms -> (doc, term, score, rank): the best k of each row by tf * ln(n / df), then by term."""
    kind = rows.schema["doc"].dataType.simpleString()
    df = df.take(pc.sort_indices(df, [("term", "ascending")])).combine_chunks()
    held = rows.sparkSession.sparkContext.broadcast((df.column("term").combine_chunks(), np.log(n / np.asarray(df.column("df"), dtype=np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = held.value
        for batch in batches:
            _, row, code, times = _known(batch.column(1), vocabulary)
            score = np.floor(times * idf[code] * 1e6 + 0.5) / 1e6
            order = np.lexsort((code, -score, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            order, nth = order[nth < k], nth[nth < k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[order])), vocabulary.take(pa.array(code[order])), pa.array(score[order]), pa.array(nth + 1, pa.int32())], names=["doc", "term", "score", "rank"])

    return rows.select("doc", "t").mapInArrow(run, f"doc {kind}, term string, score double, rank int")
