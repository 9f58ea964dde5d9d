import random
import re

import numpy as np

from sparkweft.llm import near_dedup as N


def brute(rows):
    sets = []
    for doc, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_edge_cases(edge, edge_rows):
    assert result(N.near_duplicates(edge)) == brute([(r[0], r[1]) for r in edge_rows])


def test_large_nodes_and_depth(spark):
    """Small leaves send groups through the representative, the branches and the block pairs."""
    import random

    rng = random.Random(1)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(df, leaf=8, depth=2)) == brute(rows)


def test_empty(empty):
    assert N.near_duplicates(empty).count() == 0


def shifted(seed):
    """Two texts of eleven words that share ten of them in a row: 6 of 8 shingles, exactly 0.75."""
    rng = random.Random(seed)
    w = [f"w{rng.randrange(10**9)}" for _ in range(12)]
    return " ".join(w[:11]), " ".join(w[1:])


def agreement(a, b):
    return int((N.minwise(N.shingle_set(a)) == N.minwise(N.shingle_set(b))).sum())


def test_pair_of_low_agreement(spark):
    """A pair at 0.75 whose minwise values agree in 72 to 77 of 128 places is linked."""
    a, b = shifted(49413)
    assert 72 <= agreement(a, b) < 78
    rows = [(1, a), (2, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(df)) == brute(rows) == [(1, 7, 1, True), (2, 7, 1, False)]


def linked(sets):
    u = N.Union(len(sets))
    N._links(sets, u)
    return [u.find(i) for i in range(len(sets))]


def test_links_do_not_depend_on_the_sketch(monkeypatch):
    """Within a group every pair of fitting size is counted, however few minwise values agree."""
    monkeypatch.setattr(N, "MAYBE", 1.0)
    assert linked([N.shingle_set(t) for t in shifted(1)]) == [0, 0]


def test_links_against_brute_force():
    """Groups of like and unlike sets, of many and few shared shingles: both ways of counting."""
    rng = np.random.default_rng(2)
    for trial in range(60):
        pool = rng.integers(0, 1 << 62, size=(200, 40)[trial % 2], dtype=np.uint64)
        base = pool[: rng.integers(8, 30)]
        sets = []
        for _ in range(rng.integers(2, 40)):
            drop = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.4])
            extra = rng.choice(pool, rng.integers(0, 8))
            sets.append(np.unique(np.concatenate([base[~drop], extra, pool[-1:]])))
        up = N.Union(len(sets))
        for i, x in enumerate(sets):
            for j in range(i):
                c = len(np.intersect1d(x, sets[j]))
                if 100 * c >= 75 * (len(x) + len(sets[j]) - c):
                    up.join(i, j)
        assert linked(sets) == [up.find(i) for i in range(len(sets))]
