"""What keeps the work and memory of a query in step with its input, on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkweft.operators import cochange as C
from sparkweft.operators import graph as G
from sparkweft.operators import retrieval as R
from sparkweft.operators import scan
from sparkweft.operators import selection as S
from sparkweft.operators import semantic as M
from sparkweft.operators import structure as X
from sparkweft.operators import tree as W

TEXTS = ["alpha beta gamma", "alpha alpha delta", "beta Beta", None, "", "gamma delta epsilon alpha", "zeta_one AlphaBeta"] * 30


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_task_keeps_its_best(spark):
    found = scan.best(R.doc_terms(docs(spark).coalesce(1)), [("alpha", 7, 1.5), ("beta", 7, 0.5), ("beta", 8, 1.0)], "long", k=3)
    got = rows(found)
    assert len(got) == 6 and [r[2] for r in got if r[0] == 7] == [3.0] * 3 and [r[1] for r in got if r[0] == 8] == [2, 9, 16]


def test_scans_agree_with_the_index(spark):
    d, q = docs(spark), queries(spark, "alpha beta alpha", "delta", "nothing here", "epsilon gamma")
    wanted = R.all_terms(q)
    assert rows(R.bm25_of(d, q)) == rows(R.bm25(R.postings(d, wanted=wanted), R.corpus_size(d), q))
    assert rows(R.tfidf_search(d, q)) == rows(R.tfidf(R.postings(d, wanted=wanted), d.count(), q))
    twice = d.union(d.limit(5))  # keys that come twice are counted together, as an index does
    assert rows(R.tfidf_search(twice, q)) == rows(R.tfidf(R.postings(twice, wanted=wanted), twice.count(), q))
    assert not R.bm25_of(d, queries(spark, "")).count()


def test_a_text_is_searched_once(spark):
    q = queries(spark, "a b", "c", "a b", None, None)
    seen = []

    def search(texts):
        seen.append(texts.count())
        return texts.select("query_id", F.length("query").alias("n"))

    assert rows(R.by_text(q, search).where("n is not null")) == [(0, 3), (1, 1), (2, 3)] and seen == [3]


def test_paths_that_score_alike_are_compared_first(spark):
    names = [f"{a}/{b}_{i}.py" for a in ("blue", "hot") for b in ("ring", "gear") for i in range(40)]
    paths = spark.createDataFrame(list(enumerate(names)), "item_id long, path string")
    got = rows(S.path_hits(paths, queries(spark, "blue ring", "gear", "blue ring"), 5).select("query_id", "path", "score"))
    for i, words in enumerate((["blue", "ring"], ["gear"], ["blue", "ring"])):
        score = {n: sum(w in n.replace("/", "_").split("_") for w in words) for n in names}
        best = sorted((n for n in names if score[n]), key=lambda n: (-score[n], n))[:5]
        assert [r[1:] for r in got if r[0] == i] == sorted((n, score[n]) for n in best)


def test_symbols_by_a_part_of_their_name(spark):
    symbols = spark.createDataFrame([(f"p{i:02}", "BlueRing", "class", 2) for i in range(60)] + [("q", "ringer", "class", 1)], "path string, symbol string, kind string, line int")
    got = rows(M.symbol_bm25(symbols, queries(spark, "ring"), k=4).select("rank", "path", "symbol", "score"))
    assert got == [(1, "q", "ringer", 5.0), (2, "p00", "BlueRing", 5.0), (3, "p01", "BlueRing", 5.0), (4, "p02", "BlueRing", 5.0)]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).round(2).tolist() + [[0.0] * 8, [1.0] * 3]
    table = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in R.vector_topk(table, asked, 4).collect()}
    for q in range(0, 61, 10):
        norm = lambda x: math.sqrt(sum(y * y for y in x)) or 1.0
        score = {i: round(sum(a * b for a, b in zip(v[q], x, strict=True)) / norm(v[q]) / norm(x), 6) for i, x in enumerate(v) if len(x) == 8}
        best = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert sorted(i for p, i in got if p == q) == sorted(best) and all(abs(got[q, i] - score[i]) < 2e-6 for i in best)
    few = scan.nearest(table.select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("t")).coalesce(1), asked.withColumn("embedding", F.col("embedding").cast("array<double>")).toArrow(), "long", k=2)
    assert few.count() == 14


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_do_not_send_baskets_out(spark):
    baskets = spark.createDataFrame([(i, i, "s") for i in range(50)], "basket_id long, ts long, subject string")
    items = spark.createDataFrame([(i, j) for i in range(50) for j in (i, i + 1, i + 1, i + 2)], "basket_id long, item_id long")
    plain = C.cochange_edges(baskets, items.distinct())
    many = C.cochange_edges(baskets, items, size=10_000_000)
    assert "BroadcastHashJoin" not in joins(many) and rows(plain) == rows(many)
    assert "REPARTITION_BY_NUM" in joins(many) and "REPARTITION_BY_NUM" not in joins(plain)


def test_components_and_imports_are_merged(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (4, 5, 5.0)], "src long, dst long, weight double")
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "item_id long")
    got = G.connected_components(e, items)
    assert "BroadcastHashJoin" not in joins(got) and rows(got) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    files = spark.createDataFrame([("a/b.py",), ("b.py",), ("c/d.py",)], "path string")
    refs = spark.createDataFrame([("c/d.py", "b")], "path string, ref string")
    found = X.resolve_imports(refs, files)
    assert "BroadcastHashJoin" not in joins(found) and rows(found) == [("c/d.py", "b.py")]


def test_a_walk_looks_where_it_comes(spark, monkeypatch):
    asked = []
    shares = G._shares
    monkeypatch.setattr(G, "_shares", lambda edges, k, of, rest: asked.append((of and sorted(r[0] for r in of.collect()), rest)) or shares(edges, k, of, rest))
    e = spark.createDataFrame([(1, 2, 10.0), (2, 3, 5.0), (8, 9, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(0, 1)], "request_id long, item_id long")
    few = {r["item_id"]: round(r["score"], 9) for r in G.walk_scores(e, seeds).collect()}
    assert [a for a, _ in asked] == [[1], [2], [3]] and not any(rest for _, rest in asked)
    for first in (1, 0):  # from the second step on, or from the first: all that are left
        asked.clear()
        monkeypatch.setattr(G, "is_small", lambda df, first=first: len(asked) < first)
        assert {r["item_id"]: round(r["score"], 9) for r in G.walk_scores(e, seeds).collect()} == few
        assert len(asked) == first + 1 and asked[-1][1]
    assert not G.walk_scores(e, seeds.limit(0)).count()


def test_numbers_by_ranges(spark):
    names = [f"{i:04}" for i in range(500)]
    got = sorted((r["path"], r["n"], r["next"]) for r in X.numbered(spark.createDataFrame([(n,) for n in names], "path string").repartition(7), "path").collect())
    assert got == [(n, i + 1, names[i + 1] if i < 499 else None) for i, n in enumerate(names)]


def test_twins_of_plain_stems(spark):
    names = ["test.py", "test_test.py", "u.py", "a/u_spec.rb", "b/test_u.py", "u_controller.rb", "u_model.rb", "u_controller_spec.rb", "_spec.py"]
    got = rows(W.naming_variants(spark.createDataFrame([(n,) for n in names], "path string")))
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    want = []
    for p in names:
        base = stem(p).replace("_controller", "").replace("_service", "").replace("_helper", "")
        forms = {f.replace("{0}", stem(p)) for f in W.TWIN_FORMS} | {f.replace("{0}", base) for f in W.ROLE_FORMS}
        want += [(p, t) for t in names if t != p and stem(t) in forms]
    assert got == sorted(want)


def test_targets_do_not_depend_on_the_dealing(spark):
    files = spark.createDataFrame([(f"{d}{n}",) for d in ("", "src/", "a/") for n in ("m.py", "test_m.py", "m_test.go", "m.go")], "path string")
    assert rows(W.test_targets(files)) == rows(W.test_targets(files, size=1_000_000)) != []


def test_keywords_and_identifiers_where_they_are_read(spark):
    d = docs(spark)
    assert "Exchange" not in joins(R.keywords(d)) and rows(R.keywords(d)) == rows(R.doc_keywords(R.postings(d), d.count()))
    twice = d.union(d.limit(3))
    assert rows(R.keywords(twice)) == rows(R.doc_keywords(R.postings(twice), twice.count()))
    some = M.identifier_postings(d, "doc_id")
    assert "Exchange" not in joins(some) and rows(some) == rows(M.identifier_postings(d, "doc_id", wanted=some))
    q = queries(spark, "alpha zeta", "AlphaBeta", "one")
    found = M.identifier_search(d, q)
    n = d.where(F.regexp_count("text", F.lit(R.TERM)) > 0).count()
    tf = {(r["term"], r["doc"]): r["tf"] for r in some.collect()}
    df = {t: sum(1 for u, _ in tf if u == t) for t, _ in tf}
    score = round(sum(tf.get((t, 6), 0) * math.log(n / df[t]) for t in ("alpha", "zeta")), 6)
    assert found.where("query_id = 0 and doc = 6").first()["score"] == score


def test_seeds_go_to_the_edges(spark):
    e = spark.createDataFrame([(1, 2, 5.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(i, i) for i in range(500)], "request_id long, item_id long")
    got = C.neighbours(e, seeds, 0.0)
    assert "BuildRight" in joins(got) and "BuildLeft" not in joins(got) and rows(got) == [(1, 1, 2, 5.0), (2, 2, 1, 5.0)]
