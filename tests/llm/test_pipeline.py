import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from sparkweft.llm import decontaminate, stages
from test_corpus_operators import plain_profiles
from test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def raked(rows, rounds=300):
    """doc_ids kept of (doc_id, text, source, lang), by plain iterative proportional fitting."""
    cell, cells = {}, Counter()
    for d, text, source, lang in rows:
        n, lines = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), (text or "").count("\n") + 1
        topic = "note" if n < 60 else "list" if n < 12 * lines else "essay" if n < 600 else "article"
        cell[d] = (source or "(none)", lang or "(none)", topic)
        cells[cell[d]] += n
    cells = {c: n for c, n in cells.items() if n}
    goals = []
    for k, power in enumerate((0.5, 0.7, 1.0)):
        sums = Counter()
        for c, n in cells.items():
            sums[c[k]] += n
        total = sum(v**power for v in sums.values())
        goals.append({x: v**power / total for x, v in sums.items()})
    w = dict(cells)
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            sums = Counter()
            for c, v in w.items():
                sums[c[k]] += v
            w = {c: v * goal[c[k]] / sums[c[k]] for c, v in w.items()}
    top = max(w[c] / cells[c] for c in cells)
    draw = lambda d: int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32
    return sorted(d for d, c in cell.items() if c in cells and draw(d) < w[c] / cells[c] / top)


def test_pipeline(spark):
    """run() keeps the documents a plain version keeps, stage by stage."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    predict = plain_profiles([r[:3] for r in rows])
    told = {d: (text, source, predict(text)) for d, text, _, source in rows}
    left = {d: r for d, r in told.items() if r[2] != "und"}
    left = {d: left[d] for d, _, c, k in brute([(i, r[0]) for i, r in left.items()]) if k}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r["text"])
        windows |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = words_of(text)
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    want = raked([(d, text, source, lang) for d, (text, source, lang) in left.items() if not leaks(text)])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text = told[r["doc_id"]][0] or ""
        assert (r["size"], r["law"]) == (len(text.encode()) + 16, "bytes")
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_language_stage_tells_languages(spark):
    """Documents get the language that a plain version predicts, whatever they were labelled; texts in no learned language go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    predict = plain_profiles(rows)
    got = {r["doc_id"]: r["lang"] for r in stages.language_id(spark, docs, SF).collect()}
    assert got == {d: predict(t) for d, t, _ in rows if predict(t) != "und"}
    alien = " ".join(chr(0x430 + i % 30) * 2 + chr(0x430 + i // 3 % 30) for i in range(300))
    more = docs.union(spark.createDataFrame([(10**6, alien, "en", "x", len(alien)), (10**6 + 1, rows[0][1], None, None, None)], docs.schema))
    kept = {r["doc_id"]: r["lang"] for r in stages.language_id(spark, more, SF).collect()}
    assert 10**6 not in kept and kept[10**6 + 1] == predict(rows[0][1])


def test_stages_take_the_edge_cases(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sharding":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_near_dedup_stage_keeps_texts_without_or_under_one_id(spark):
    """Clean texts stay whatever their ids; near copies go, with or without an id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " end"
    rows = [(None, text(1)), (None, text(2)), (None, near(2)), (5, text(3)), (5, text(4)), (5, text(5)), (5, text(3)), (7, near(4)), (9, text(6)), (None, near(6)), (2, near(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in stages.near_dedup_stage(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) == 6
    groups = [{text(1)}, {text(2), near(2)}, {text(3)}, {text(4), near(4)}, {text(5), near(5)}, {text(6), near(6)}]
    assert all(sum(t in g for _, t in got) == 1 for g in groups)
    assert (9, text(6)) in got and (2, near(5)) in got


def test_decontamination_holds_one_batch_of_the_benchmark(spark, tmp_path, monkeypatch):
    """However many batches the benchmark makes, a task searches for one, and no leak is lost between them."""
    text = lambda k: " ".join(f"b{k}x{i}" for i in range(12))
    spark.createDataFrame([(k, text(k)) for k in range(30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"before {text(k)} after" if k < 30 else f"clean {k}") for k in range(40)] + [(40, None), (41, "clean"), (41, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PATTERN_WORDS", 400)
    assert len(list(decontaminate._batches(spark.read.parquet(f"{tmp_path}/benchmark.parquet"), 400))) > 2
    out = stages.decontamination(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30, 41), 41, 41]
