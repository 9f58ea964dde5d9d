"""Stores, learning, communities, diversity and streams on small fixtures, where the right answer is plain."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from sparkweft.api import Engine
from sparkweft.functions import paths as P
from sparkweft.operators import learning as Z
from sparkweft.operators import ranking as Q
from sparkweft.operators import retrieval as R
from sparkweft.operators import tree as W
from sparkweft.sources import index as X
from sparkweft.sources import records as O
from sparkweft.sources import stores
from sparkweft.streaming import watch


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def docs(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_index_is_resumed_and_pruned(spark, folder):
    rows = [(f"p{i}", f"alpha word{i} " * 3) for i in range(7)]
    assert X.catch_up(docs(spark, rows), folder, step=2, most=4) == {"pending_before": 7, "synced": 4, "pending_after": 3}
    assert X.catch_up(docs(spark, rows), folder, step=2)["synced"] == 3
    assert X.pending(docs(spark, rows), folder).count() == 0
    rows = [("p0", "beta only")] + rows[1:5]  # one changed, two gone
    assert X.catch_up(docs(spark, rows), folder) == {"pending_before": 1, "synced": 1, "pending_after": 0}
    assert {r[0] for r in X.read_index(spark, folder, "files").select("path").collect()} == {f"p{i}" for i in range(5)}
    q = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "word6")], "query_id long, query string")
    got = {(r["query_id"], r["doc"]) for r in X.search(spark, folder, q).collect()}
    assert got == {(1, f"p{i}") for i in range(1, 5)} | {(2, "p0")}
    X.delete_paths(spark, folder, docs(spark, rows[:1]))
    assert X.read_index(spark, folder, "postings").where("term = 'beta'").count() == 0
    X.clear(spark, folder)
    assert X.read_index(spark, folder, "files").count() == 0


def test_cases_transcripts_and_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "c", "query": "q", "expected_top_files": ["a"]}]))
    r = stores.read_cases(spark, f"file://{tmp_path}/cases.json").first()
    assert (r["tier"], r["token_budget"], r["max_depth"], r["min_weight"]) == (1, 50_000, 2, 2)
    (tmp_path / "t").mkdir()
    lines = [{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Read"}, {"type": "text"}], "usage": {"input_tokens": 3, "output_tokens": 4}}}, {"type": "result", "num_turns": 2, "total_cost_usd": 0.5}]
    (tmp_path / "t" / "run.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    got = stores.read_transcripts(spark, f"file://{tmp_path}/t").orderBy("type").collect()
    assert [(r["type"], r["tools"], r["input_tokens"], r["num_turns"]) for r in got] == [("assistant", ["Read"], 3, None), ("result", None, None, 2)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "src" / "big.py").write_text("y" * 100)
    got = stores.read_source_files(spark, f"file://{tmp_path}/src", [".py", ".rb"], max_bytes=50).collect()
    assert [r["text"] for r in got] == ["x = 1"]


def test_snapshots_are_signed(spark, folder):
    df = docs(spark, [("a", "1"), ("b", "2")])
    mark = stores.export_snapshot({"docs": df}, folder, b"key")
    assert stores.import_snapshot(spark, folder, ["docs"], b"key", mark)["docs"].count() == 2
    docs(spark, [("a", "1"), ("b", "3")]).write.mode("overwrite").parquet(f"{folder}/docs")
    with pytest.raises(ValueError):
        stores.import_snapshot(spark, folder, ["docs"], b"key", mark)
    stores.store_payloads(spark.createDataFrame([("x",), ("x",)], "payload string"), f"{folder}/p")
    key = spark.read.parquet(f"{folder}/p").select("key")
    assert [r["payload"] for r in stores.retrieve_payloads(spark, f"{folder}/p", key).collect()] == ["x"]


def test_records(spark, tmp_path, folder):
    flow = {"flow_id": "f", "question": "q", "call_path": [{"symbol": "A.run", "file": "a.py", "line": 2}, {"symbol": "x", "file": "none.py", "line": 1}]}
    (tmp_path / "flows.json").write_text(json.dumps({"flows": [flow]}))
    steps = O.read_flows(spark, f"file://{tmp_path}/flows.json")
    got = {r["step"]: r["problem"] for r in O.checked_steps(steps, docs(spark, [("a.py", "\ndef run():\n  pass")])).collect()}
    assert got == {0: None, 1: "missing file"}
    row = lambda k, t, v: spark.createDataFrame([(k, t, v)], "repo_key string, built_at int, v int")
    O.merge_results(spark, folder, row("a", 1, 1))
    O.merge_results(spark, folder, row("b", 1, 2))
    assert {(r["repo_key"], r["v"]) for r in O.merge_results(spark, folder, row("a", 2, 3)).collect()} == {("a", 3), ("b", 2)}
    counters = spark.createDataFrame([("hits", "", 2.0), ("hits", "", 1.0)], "name string, labels string, value double")
    samples = spark.createDataFrame([("lat", 'phase="rank"', float(v)) for v in range(1, 101)], "name string, labels string, value double")
    text = O.metrics_text(counters, samples)
    assert "# TYPE hits counter\nhits 3\n" in text and 'lat{phase="rank",quantile="0.95"} 95' in text and 'lat_count{phase="rank"} 100' in text
    assert O.filled("a {{x}} b {{ y }}", {"x": "1", "y": "2"}) == "a 1 b 2"
    with pytest.raises(KeyError):
        O.filled("{{x}}", {})
    assert O.registry(["a=/x", "b=/y"]) == {"a": "/x", "b": "/y"}
    with pytest.raises(ValueError):
        O.registry(["a=/x", "a=/y"])
    docs(spark, [("a", "1")]).write.parquet(f"{folder}-r/docs")
    assert O.read_registry(spark, [f"k={folder}-r"], "docs").first()["repo_key"] == "k"
    (tmp_path / "s.json").write_text('{"top_k": 9}')
    assert Q.engine_config(O.read_settings(spark, f"file://{tmp_path}/s.json")).top_k == 9
    with pytest.raises(ValueError):
        Q.engine_config({"nope": 1})
    O.write_snapshots(spark.createDataFrame([("r", "c")], "repo_key string, case_id string"), f"{folder}-s")
    assert spark.read.json(f"{folder}-s").count() == 1
    O.write_audit(spark.createDataFrame([("x", "")], "kind string, query string"), f"{folder}-a")
    assert O.rotate_audit(spark, f"{folder}-a") == 0 and O.rotate_audit(spark, f"{folder}-a", most_bytes=0) >= 1


def test_policy_layers():
    a = {"hooks": {"allowed_sha256": ["1"], "x": 1}, "default_tier": 1}
    b = {"hooks": {"allowed_sha256": ["2", "1"], "y": 2}, "default_tier": 2}
    assert Q.merged_policy(a, b) == {"hooks": {"allowed_sha256": ["1", "2"], "x": 1, "y": 2}, "default_tier": 2}


def samples(spark):
    rows = [(r, f"p{i}", int(i % 3 == 0), float(i % 3 == 0) * 2 + i / 10, float((i * 7 + r) % 5)) for r in range(6) for i in range(9)]
    return spark.createDataFrame(rows, "request_id long, path string, label int, good double, noise double")


@pytest.mark.parametrize("prefer", ["lambdamart", "logistic"])
def test_rankers_find_the_signal(spark, folder, prefer):
    rows = samples(spark)
    model = Z.train_best(rows, ["good", "noise"], prefer=prefer, **({"trees": 3, "leaves": 4} if prefer == "lambdamart" else {}))
    expected = rows.where("label = 1").select("request_id", "path")
    assert Z.mean_mrr(Z.ranked_by(model, rows, ["good", "noise"]), expected) == 1.0
    Z.save_ranker(spark, model, folder)
    again = Z.load_ranker(spark, folder)
    assert Z.ranked_by(again, rows, ["good", "noise"]).exceptAll(Z.ranked_by(model, rows, ["good", "noise"])).count() == 0


def test_too_few_samples_train_nothing(spark):
    few = samples(spark).where("request_id = 0")
    assert Z.train_lambdamart(few, ["good"]) is None and Z.train_logistic(few.where("label = 1"), ["good"]) is None


def test_replay_saves_only_what_helps(spark):
    rows = samples(spark)
    expected = rows.where("label = 1").select("request_id", "path")
    held = spark.createDataFrame([(0,), (1,)], "request_id long")
    out = Z.replay(rows, expected, held, ["good", "noise"], "noise", prefer="logistic")
    assert out["after_mrr"] == 1.0 and out["saved"] and out["passed"] == (out["delta"] >= 0.03)
    ev = rows.select(F.monotonically_increasing_id().alias("event_id"), F.col("request_id").cast("string").alias("request_id"), "path", F.when(F.col("label") == 1, "accept").otherwise("reject").alias("kind"), F.lit(1).cast("long").alias("ts"), F.lit(0.0).alias("dwell_seconds"))
    text = rows.withColumn("request_id", F.col("request_id").cast("string")).drop("label")
    learned = Z.apply_learn(ev, text, expected.withColumn("request_id", F.col("request_id").cast("string")), held.select(F.col("request_id").cast("string")), ["good"], "noise", prefer="logistic")
    assert learned["ranker"] is not None and learned["weights"].count() == 9


def test_communities_of_two_cliques(spark):
    clique = lambda a: [(i, j, 5.0) for i in range(a, a + 5) for j in range(i + 1, a + 5)]
    e = spark.createDataFrame(clique(0) + clique(10) + [(4, 10, 1.0)], "src long, dst long, weight double")
    got = {}
    for r in W.modularity_communities(e).collect():
        got.setdefault(r["community"], set()).add(r["item_id"])
    assert sorted(map(sorted, got.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_mmr_against_plain(spark):
    rows = [(0, f"a/b{i % 3}/f{i}.py", round(1 - i / 20, 3), [f"s{i % 4}", f"t{i % 2}"]) for i in range(14)]
    got = [r["path"] for r in R.mmr(spark.createDataFrame(rows, "request_id long, path string, relevance double, symbols array<string>"), protect=2, limit=9).orderBy("position").collect()]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    sim = lambda x, y: 0.7 * jac(set(x[1].split("/")), set(y[1].split("/"))) + 0.3 * jac(set(x[3]), set(y[3]))
    chosen, left = rows[:2], rows[2:]
    while len(chosen) < 9:
        best = max(left, key=lambda x: 0.7 * x[2] - 0.3 * max(sim(x, c) for c in chosen))
        chosen.append(best)
        left.remove(best)
    assert got == [c[1] for c in chosen]


def test_globs(spark):
    p = spark.createDataFrame([("a/x_test.go",), ("src/deep/m.py",), ("docs",), (".git/x",), ("my/target",)], "p string")
    got = [tuple(r) for r in p.select(W.matches_glob(F.col("p"), W.TEST_GLOBS), W.in_subsystem(F.col("p"), "src/**/*.py"), P.excluded(F.col("p"))).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, False), (False, False, True), (False, False, True)]


def test_report(spark):
    sub = spark.createDataFrame([("src", 3), ("lib", 9)], "subsystem string, files int")
    text = W.report("T", sub, spark.createDataFrame([("a", 2)], "path string, degree int"), spark.createDataFrame([(5,)], "items int"))
    assert text.index("| lib | 9 |") < text.index("| src | 3 |") and "- items: 5" in text


def test_events_fold_as_a_stream(spark, tmp_path):
    rows = [(1, "r", "a", "accept", 10, 0.0), (2, "r", "a", "accept", 11, 0.0), (3, "s", "a", "reject", 12, 0.0), (4, "s", "b", "dwell", 13, 60.0)]
    ev = spark.createDataFrame(rows, "event_id long, request_id string, path string, kind string, ts long, dwell_seconds double").withColumn("ts", F.timestamp_seconds("ts"))
    ev.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"file://{tmp_path}/ev")
    q = watch.folding(stream).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["path"], r["used"], r["total"]) for r in spark.table("folded").collect()} == {("a", 1, 2), ("b", 1, 1)}


def test_files_are_indexed_as_they_come(spark, tmp_path, folder):
    (tmp_path / "in").mkdir()
    health = watch.Health()
    spark.streams.addListener(health)
    for turn in (1, 2):
        (tmp_path / "in" / f"f{turn}.py").write_text(f"turn{turn} word")
        watch.watch_files(spark, f"file://{tmp_path}/in", folder, f"file://{tmp_path}/state").awaitTermination()
    assert X.read_index(spark, folder, "files").count() == 2
    spark.streams.removeListener(health)


def test_deadline_marks_what_it_cut(spark):
    now = [0.0]
    d = watch.Deadline(10, clock=lambda: now[0])
    rows = spark.range(3)

    def slow(df):
        now[0] += 11
        return df.where("id < 2")

    out = d.run("rank", d.run("retrieve", rows, slow), lambda df: df.limit(0))
    assert out.count() == 2 and d.truncated == "rank" and d.profile() == [("retrieve", 11.0, 100.0)]


def test_engine_verbs_and_hooks(spark):
    items = spark.createDataFrame([(i, f"src/m{i}.py") for i in range(1, 6)], "item_id long, path string")
    baskets = spark.createDataFrame([(b, b * 10, "feature") for b in range(4)], "basket_id long, ts long, subject string")
    pairs = spark.createDataFrame([(b, i) for b in range(4) for i in (1, 2, 3 + b % 3)], "basket_id long, item_id long")
    engine = Engine.build(items, baskets, pairs)
    seen = []
    engine.hook("pre_context", lambda df: seen.append("pre") or df)
    engine.hook("post_update", lambda df: seen.append("update") or df)
    seeds = spark.createDataFrame([(0, 1)], "request_id long, item_id long")
    assert engine.blast(seeds).count() >= 2 and engine.explore(seeds).count() >= 2 and engine.stats().first()["edges"] > 0
    more = engine.update(baskets.where("basket_id = 0"), pairs.where("basket_id = 0"))
    was = engine.edges.agg(F.sum("weight")).first()[0]
    assert more.edges.agg(F.sum("weight")).first()[0] > was and seen == ["update"]
    assert engine.decay_sweep(10**9).edges.count() == 0
    got = engine.context(seeds, 10_000, F.lit(1)).collect()
    assert got and "pre" in seen
    built = []
    Engine.build(items, baskets, pairs, hooks={"post_build": [lambda df: built.append(1) or df]})
    assert built == [1] and math.isfinite(was)
