"""Operators on small fixtures, where the right answer is plain."""

import math

from pyspark.sql import functions as F

from sparkweft.functions import code as K
from sparkweft.functions import paths as P
from sparkweft.operators import cochange as C
from sparkweft.operators import evaluate as E
from sparkweft.operators import feedback as B
from sparkweft.operators import graph as G
from sparkweft.operators import retrieval as R


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_pair_weights(spark):
    baskets = spark.createDataFrame([(1, 10, "feature"), (2, 20, "bump deps"), (3, 5, "one")], "basket_id long, ts long, subject string")
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 9)], "basket_id long, item_id long")
    got = C.cochange_edges(baskets, items).collect()
    assert len(got) == 1 and got[0]["n"] == 2 and got[0]["last_seen"] == 20
    assert abs(got[0]["weight"] - 1.25 / math.log(3)) < 1e-6


def test_decay_ratio(spark):
    e = spark.createDataFrame([(1, 2, 10.0, 335 * 86400), (3, 4, 10.0, 0)], "src long, dst long, weight double, last_seen long")
    w = {r["src"]: r["weight"] for r in C.decayed(e, 365 * 86400).collect()}
    assert abs(w[1] / w[3] - math.exp(-30 / 180) / math.exp(-365 / 180)) < 1e-9


def test_multi_hop_and_cap(spark):
    e = edges(spark, [(1, 2, 10.0), (1, 3, 10.0), (2, 4, 10.0), (4, 5, 10.0)])
    seeds = spark.createDataFrame([(0, 1)], "request_id long, item_id long")
    got = {r["item_id"]: r["depth"] for r in G.blast_radius(e, seeds, max_depth=2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    assert G.blast_radius(e, seeds, max_depth=2, max_results=2).count() == 2


def test_walk_prefers_the_heavier(spark):
    e = edges(spark, [(1, 2, 10.0), (2, 3, 5.0)])
    seeds = spark.createDataFrame([(0, 1)], "request_id long, item_id long")
    got = {r["item_id"]: r["score"] for r in G.walk_scores(e, seeds).collect()}
    assert got[2] > got[3] and abs(sum(got.values()) - 1) < 1e-9


def test_components(spark):
    e = edges(spark, [(1, 2, 5.0), (2, 3, 4.0), (4, 5, 5.0), (5, 6, 0.5)])
    got = {r["item_id"]: r["component"] for r in G.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r["size"] for r in G.communities(G.connected_components(e), max_size=2).collect()} == {2}


def test_mmr_takes_the_diverse(spark):
    rows = [(0, f"spec/models/user_spec_{i}.rb", 1.0) for i in range(10)] + [(0, p, 1.0) for p in ("a.py", "b/c.py", "d/e/f.go")]
    got = R.mmr(spark.createDataFrame(rows, "request_id long, path string, relevance double"), protect=0, limit=8).collect()
    assert {"a.py", "b/c.py", "d/e/f.go"} <= {r["path"] for r in got}


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(0, 1, 40), (0, 2, 70), (0, 3, 5)], "request_id long, rank int, tokens int")
    assert [r["rank"] for r in R.budget_pack(rows, "request_id", "tokens", 100).collect()] == [1]


def test_feedback_labels(spark):
    ev = spark.createDataFrame([(1, "r", "auth.py", "accept", 1, 0.0), (2, "r", "noise.py", "reject", 2, 0.0), (3, "r", "short.py", "dwell", 3, 5.0), (4, "r", "long.py", "dwell", 4, 45.0)], "event_id long, request_id string, path string, kind string, ts long, dwell_seconds double")
    assert {r["path"]: r["used"] for r in B.fold(ev).collect()} == {"auth.py": 1, "noise.py": 0, "long.py": 1}


def test_metrics(spark):
    ranked = spark.createDataFrame([("c", "a", 2), ("c", "z", 1)], "case_id string, doc string, rank int")
    expected = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "case_id string, doc string, position int")
    r = E.case_metrics(ranked, expected).first()
    assert (r["recall"], r["mrr"]) == (0.5, 0.5) and abs(r["ndcg"] - (2 / math.log2(3)) / (2 + 1 / math.log2(3))) < 1e-6


def test_paths(spark):
    rows = spark.createDataFrame([("src/app/test_x.py",), ("spec/a.rb",), ("x/migrations/1.py",), ("README.md",), ("lib/a.lock",)], "p string")
    got = [tuple(r) for r in rows.select(P.file_class(F.col("p")), P.is_test(F.col("p")), P.is_structural_test(F.col("p"))).collect()]
    assert got == [("source", False, True), ("test", True, True), ("migration", False, False), ("doc", False, False), ("generated", False, False)]


def test_code():
    text = "class A:\n    def run(self):\n        return 1\n\ndef main():\n    pass"
    assert K.symbols_of(text) == [("A", "class", 1, None), ("run", "function", 2, "A"), ("main", "function", 5, "A")]
    assert [(c[0], c[1], c[2]) for c in K.chunks_of(text)] == [("A", 1, 4), ("run", 2, 4), ("main", 5, 6)]
    assert K.normalized("a/./b/../c.py") == "a/c.py"
    assert K.pruned("\n".join(f"line {i}" for i in range(100)), ["line 7"]).split("\n")[:2] == ["line 0", "line 1"]


def test_imports_of_long_texts(spark):
    """Imports far down a text are found."""
    text = "import a\n" + "x = 1\n" * 5000 + "from b.c import d\n"
    rows = spark.createDataFrame([(text,)], "t string").select(K.imports(F.col("t"))).collect()
    assert rows[0][0] == ["a", "b.c"]
