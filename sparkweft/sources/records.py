"""Small records: flows, settings, registries, audit lines, bench results, metrics text and message templates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import merged_results

FLOWS = "flow_id string, repo_key string, repo_sha string, question string, size string, must_hit_symbols array<string>, call_path array<struct<symbol:string,file:string,line:int,note:string>>"
# Tools by what they do, lines around a cited one that are searched.
TOOLS = {"read": ["Read", "NotebookRead", "View", "cat"], "search": ["Grep", "Glob", "Search", "find", "rg"], "exec": ["Bash", "Shell", "Execute"], "explore": ["Task", "Agent", "Explore"]}
LINE_TOLERANCE = 5


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """{"flows": [...]} -> (flow_id, question, step, symbol, file, line), one row a step."""
    rows = spark.read.schema(f"flows array<struct<{', '.join(_field(f) for f in _split(FLOWS))}>>").option("multiLine", True).json(path)
    flows = rows.select(F.explode("flows").alias("f"))
    return flows.select("f.flow_id", "f.question", F.posexplode("f.call_path").alias("step", "s")).select("flow_id", "question", "step", "s.symbol", "s.file", "s.line")


def _split(schema: str) -> list[str]:
    return re.split(r", (?![^<]*>)", schema)


def _field(text: str) -> str:
    name, kind = text.split(" ", 1)
    return f"{name}:{kind}"


def checked_steps(steps: DataFrame, files: DataFrame) -> DataFrame:
    """Steps (flow_id, step, symbol, file, line) against (path, text) -> problem: missing, out of range, not near its line, or null if all is well."""
    name = F.regexp_extract("symbol", r"([^.]*)$", 1)
    rows = steps.join(files.select(F.col("path").alias("file"), F.split("text", "\n").alias("lines")), "file", "left")
    n = F.size("lines")
    first = F.greatest(F.lit(1), F.col("line") - LINE_TOLERANCE)
    window = F.slice("lines", first, F.col("line") + LINE_TOLERANCE - first + 1)
    near = F.exists(window, lambda x: F.contains(x, name))
    problem = F.when(F.col("lines").isNull(), "missing file").when((F.col("line") < 1) | (F.col("line") > n), "out of range").when(~near, "symbol not found")
    return rows.select("flow_id", "step", "symbol", "file", "line", problem.alias("problem"))


def tool_bucket(name: Column, own: str = "context") -> Column:
    """What a tool does: the engine's own server, reading, searching, running, exploring, or other."""
    out = F.lit("other")
    for bucket, names in reversed(TOOLS.items()):
        out = F.when(name.isin(names), bucket).otherwise(out)
    return F.when(F.lower(name).rlike(f"^mcp__.*{re.escape(own)}"), "own").otherwise(out)


def run_metrics(calls: DataFrame, usage: DataFrame) -> DataFrame:
    """(run_id, tool) calls and (run_id, arm, input_tokens, output_tokens, num_turns, cost) -> one row a run: calls by bucket, tokens, turns, cost."""
    kind = tool_bucket(F.col("tool"))
    n = lambda b: F.count(F.when(F.col("kind") == b, 1)).alias(f"{b}_calls")
    per = calls.withColumn("kind", kind).groupBy("run_id").agg(F.count("*").alias("total_calls"), *[n(b) for b in ("own", "read", "search", "exec", "explore", "other")])
    use = usage.groupBy("run_id", "arm").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("num_turns").alias("num_turns"), F.max("cost").alias("cost"))
    rows = use.join(per, "run_id", "left").fillna(0).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return rows


def write_audit(events: DataFrame, folder: str) -> None:
    """Audit lines as JSON, a query by the first 16 hex digits of its hash."""
    key = F.when(F.col("query") != "", F.substring(F.sha2(F.col("query").cast("binary"), 256), 1, 16)).otherwise("")
    events.withColumn("query_hash", key).drop("query").write.mode("append").json(folder)


def rotate_audit(spark: SparkSession, folder: str, *, most_bytes: int = 10 << 20, most_files: int = 5) -> int:
    """Deletes the oldest files beyond the size that so many files of so many bytes would have; returns how many went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(path) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: (-f.getModificationTime(), f.getPath().getName()))
    total, gone = 0, 0
    for f in files:
        total += f.getLen()
        if total > most_bytes * most_files:
            fs.delete(f.getPath(), False)
            gone += 1
    return gone


def write_snapshots(cases: DataFrame, folder: str) -> None:
    """(repo_key, case_id, ...) one folder of JSON lines a repository."""
    cases.write.mode("overwrite").partitionBy("repo_key").json(folder)


def merge_results(spark: SparkSession, folder: str, new: DataFrame, key: str = "repo_key", when: str = "built_at") -> DataFrame:
    """Results by key in a folder of JSON, the latest of each; the merged table replaces the old one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    old = spark.read.schema(new.schema).json(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else new.limit(0)
    from ..session import checkpointed

    rows = checkpointed(merged_results(old, new, key, when))
    rows.write.mode("overwrite").json(folder)
    return rows


def metrics_text(counters: DataFrame, samples: DataFrame) -> str:
    """Counters (name, labels, value) and samples (name, labels, value) in the text form of a metrics endpoint; a line each series, so few.

    Quantiles are at index int((n - 1) * p) of the sorted samples.
    """
    lines: list[str] = []
    full = lambda n, l: f"{n}{{{l}}}" if l else n  # noqa: E731, E741
    for r in counters.groupBy("name", "labels").agg(F.sum("value").alias("value")).orderBy("name", "labels").collect():
        lines += [f"# TYPE {r['name']} counter", f"{full(r['name'], r['labels'])} {r['value']:g}"]
    at = lambda p: F.get("v", F.floor((F.size("v") - 1) * p).cast("int"))
    per = samples.groupBy("name", "labels").agg(F.sort_array(F.collect_list("value")).alias("v"), F.count("*").alias("n"), F.sum("value").alias("s"))
    for r in per.select("name", "labels", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "n", "s").orderBy("name", "labels").collect():
        lines.append(f"# TYPE {r['name']} summary")
        for q in ("0.5", "0.95", "0.99"):
            label = ",".join(x for x in (r["labels"], f'quantile="{q}"') if x)
            lines.append(f"{r['name']}{{{label}}} {r['p' + q[2:].ljust(2, '0')]:g}")
        lines += [full(f"{r['name']}_count", r["labels"]) + f" {r['n']}", full(f"{r['name']}_sum", r["labels"]) + f" {r['s']:g}"]
    return "\n".join(lines) + ("\n" if lines else "")


def filled(template: str, values: dict[str, str]) -> str:
    """A message template with its {{name}} places filled; a place without a value is an error."""
    missing = sorted({n for n in re.findall(r"\{\{\s*(\w+)\s*\}\}", template)} - set(values))
    if missing:
        raise KeyError(", ".join(missing))
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values[m[1]], template)


def read_settings(spark: SparkSession, path: str) -> dict:
    """One JSON object of settings."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def registry(entries: list[str]) -> dict[str, str]:
    """KEY=PATH entries by key; a key twice, or none, is an error."""
    out: dict[str, str] = {}
    for e in entries:
        key, sep, path = e.partition("=")
        if not sep or not key.strip() or not path.strip() or key.strip() in out:
            raise ValueError(f"bad entry {e!r}")
        out[key.strip()] = path.strip()
    return out


def read_registry(spark: SparkSession, entries: list[str], name: str) -> DataFrame:
    """The table of that name of every registered folder, with its key."""
    frames = [spark.read.parquet(f"{path}/{name}").withColumn("repo_key", F.lit(key)) for key, path in sorted(registry(entries).items())]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
