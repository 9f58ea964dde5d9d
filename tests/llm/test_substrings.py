import collections
import hashlib
import random
import re

import pytest

from sparkweft.llm import substrings as S


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        spans = S.merged([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        out.append((d, len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_edge_cases(edge, edge_rows):
    assert result(S.repeated_substrings(edge)) == brute([(r[0], r[1]) for r in edge_rows], 400)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_random_texts(spark, hot):
    rng = random.Random(3)
    base = "".join(rng.choices("abc", k=400))
    rows = [(0, base), (1, base[30:200] + "x" + base[150:260]), (2, "a" * 150), (3, "é" * 60), (4, base)]
    for i in range(5, 40):
        a = rng.randrange(300)
        rows.append((i, "".join(rng.choices("abc", k=rng.randrange(60))) + base[a : a + rng.randrange(120)] + "".join(rng.choices("abc", k=20))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(S.repeated_substrings(df, length=40, gram=8, hot=hot)) == brute(rows, 40)


def test_file_columns(monkeypatch, spark):
    monkeypatch.setattr(S, "IN_MEMORY", 0)
    import numpy as np

    segs = [b"abcdefgh" * 3, b"abcdefgh" * 3, b"abcdefgX" * 3]
    found = S.repeated_windows(segs, np.zeros(3, dtype=np.int64), np.zeros(3, dtype=np.int64), 16, 9)
    assert found[:2, 8].all() and not found[2].any()


def test_empty(empty):
    assert S.repeated_substrings(empty).count() == 0


def passages(rows, width):
    """Words and maximal runs of words in windows of ``width`` words that another document has too."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))) for d, t in rows]
    where = collections.defaultdict(set)
    for n, (_, w) in enumerate(told):
        for i in range(len(w) - width + 1):
            where[tuple(w[i : i + width])].add(n)
    out = []
    for d, w in told:
        spans = S.merged([(i, i + width) for i in range(len(w) - width + 1) if len(where[tuple(w[i : i + width])]) > 1])
        out.append((d, len(w), sum(b - a for a, b in spans), len(spans)))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_passage_words", "n_passages").collect())


@pytest.mark.parametrize("hot", [20_000, 3])
def test_passages_across_documents(spark, hot):
    """Passages below and above 400 bytes, one common line, repeats within one document, copies and blank changes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, rows = text(60), []
    for size in (49, 50, 51, 70, 120):
        p = text(size)
        rows += [text(30) + " " + p + " " + text(25), text(10) + "\n" + p.upper().replace(" ", "\t ", 3), p]
    rows += [text(20) + "\n" + line + "\n" + text(20) for _ in range(12)]
    own = text(55)
    rows += [own + " . " + own, text(300), "w " * 200, "w " * 120 + "v", text(20), None, rows[0], line]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeated_substrings(df, hot=hot)
    assert told(got) == passages(rows, 50)
    assert result(got) == brute(rows, 400)


def test_passages_of_edge_cases(edge, edge_rows):
    assert told(S.repeated_substrings(edge)) == passages([(r[0], r[1]) for r in edge_rows], 50)
