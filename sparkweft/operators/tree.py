"""A tree of files: globs, subsystems, specs, references, pairs, affected tests, staleness and communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import checkpointed, dealt, sorted_side
from . import graph as G
from . import structure as X
from .cochange import symmetric

# Globs of tests, roots whose second part names a subsystem, suffixes and names of specs, parts of twins, anchors of the estimate.
TEST_GLOBS = ["*_test.go", "test_*.py", "tests/test_*.py", "*_test.py", "*.spec.ts", "*.test.ts", "*.spec.js", "*.test.js"]
SUBSYSTEM_ROOTS = ["src", "lib", "pkg", "tests", "test", "cmd", "internal", "api", "apps", "packages"]
SPEC_SUFFIX = r"\.(md|mdc|txt|rst)$"
SPEC_ROOTS = ["AGENTS.md", "CLAUDE.md", "README.md", "CONTRIBUTING.md", "CHANGELOG.md", ".cursorrules"]
SPEC_DIRS = r"^(docs/|doc/|\.cursor/rules/|\.github/)"
MOST_SPECS = 300
TWIN_FORMS = ["{0}_spec", "{0}_test", "test_{0}", "{0}.spec", "{0}.test"]
ROLE_FORMS = ["{0}_controller", "{0}_service", "{0}_helper", "{0}_model", "{0}_serializer", "{0}_decorator"]
ANCHORS = [(5_000, 3_500, 17.0, 24.0), (5_150, 10_500, 792.0, 289.0), (100_000, 40_000, 37_877.0, 1_200.0)]
EDGE_KINDS = ["calls", "inherits", "tests"]


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last part matches one of the patterns."""
    tests = [side.rlike(P.glob_regex(p)) for p in patterns for side in (P.basename(path), path)]
    return reduce(lambda a, b: a | b, tests)


def in_subsystem(path: Column, pattern: str) -> Column:
    """A path under a pattern, where ``**`` splits it into a prefix of the path and an end of it or of its last part."""
    if "**" not in pattern:
        return path.rlike(P.glob_regex(pattern))
    prefix, suffix = pattern.split("**", 1)
    prefix, suffix = prefix.rstrip("/"), suffix.lstrip("/")
    under = F.startswith(path, F.lit(prefix)) if prefix else F.lit(True)
    ends = (path.rlike(P.glob_regex(f"*{suffix}")) | P.basename(path).rlike(P.glob_regex(suffix))) if suffix else F.lit(True)
    return under & ends


def root_prefix(path: Column) -> Column:
    """The part of a path that names its subsystem: two parts below the usual roots, else one."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 3) & F.get(parts, 0).isin(SUBSYSTEM_ROOTS), F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0))


def assigned_subsystems(files: DataFrame, manual: dict[str, list[str]], *, least: int = 5, most: int = 40) -> DataFrame:
    """(path) -> (subsystem, source, path): named globs first, what they leave by prefix, the largest groups of some size."""
    path = F.col("path")
    names = [F.when(reduce(lambda a, b: a | b, [in_subsystem(path, g) for g in globs]), F.lit(k)) for k, globs in sorted(manual.items())]
    rows = files.select("path", (F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")).alias("own"))
    named = rows.select(F.explode("own").alias("subsystem"), F.lit("manual").alias("source"), "path")
    rest = rows.where(F.size("own") == 0).select(root_prefix(path).alias("subsystem"), "path")
    sizes = rest.groupBy("subsystem").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~F.col("subsystem").isin(sorted(manual)))
    top = sizes.orderBy(F.desc("n"), "subsystem").limit(most)
    return named.union(rest.join(F.broadcast(top), "subsystem").select("subsystem", F.lit("auto").alias("source"), "path"))  # at most `most` rows


def is_spec(path: Column) -> Column:
    return path.rlike("(?i)" + SPEC_SUFFIX) & (path.rlike(SPEC_DIRS) | P.basename(path).isin(SPEC_ROOTS)) | path.isin(SPEC_ROOTS)


def discovered_specs(files: DataFrame, most: int = MOST_SPECS) -> DataFrame:
    """(path, mapped, tracked, present) -> (path, place): specs named by the map or tracked; what is merely present only if there is none.

    Beyond ``most``, those of the map and the root files come first.
    """
    spec = is_spec(F.col("path"))
    rows = files.withColumn("found", (F.col("mapped") & F.col("present")) | (F.col("tracked") & spec)).withColumn("spare", F.col("present") & spec)
    some = rows.agg(F.coalesce(F.max("found"), F.lit(False)).alias("some"))
    rows = rows.crossJoin(F.broadcast(some)).where(F.col("found") | (~F.col("some") & F.col("spare")))  # one row
    first = F.when(F.col("mapped") | F.col("path").isin(SPEC_ROOTS), 0).otherwise(1)
    top = rows.select("path", first.alias("late")).orderBy("late", "path").limit(most + 1)
    place = F.row_number().over(Window.orderBy("late", "path"))
    few = top.withColumn("place", place)  # at most `most` + 1 rows
    return few.where(F.col("place") <= most).select("path", "place")


def model_refs(text: Column) -> Column:
    """Distinct models named in {{ ref('model') }} and {{ source('schema', 'model') }}."""
    ref = F.regexp_extract_all(text, F.lit(r"""\{\{\s*ref\s*\(\s*['"]([^'"]+)['"]\s*\)\s*\}\}"""), F.lit(1))
    source = F.regexp_extract_all(text, F.lit(r"""\{\{\s*source\s*\(\s*['"][^'"]+['"]\s*,\s*['"]([^'"]+)['"]\s*\)\s*\}\}"""), F.lit(1))
    return F.array_distinct(F.concat(ref, source))


def model_edges(models: DataFrame) -> DataFrame:
    """(path, text) of SQL templates -> (src, dst, how): a reference goes to the file of that stem, else to one whose stem ends in __stem."""
    known = models.select(F.col("path").alias("dst"), F.lower(P.stem(F.col("path"))).alias("stem"))
    ends = known.where(F.contains("stem", F.lit("__"))).select("dst", F.regexp_extract("stem", r"__([^_].*)$", 1).alias("name"), F.lit("suffix").alias("how"))
    keys = known.select("dst", F.col("stem").alias("name"), F.lit("stem").alias("how")).union(ends)
    want = models.select(F.col("path").alias("src"), F.explode(model_refs(F.col("text"))).alias("ref")).withColumn("name", F.lower("ref"))
    hit = want.join(keys, "name").where("src <> dst")
    first = F.row_number().over(Window.partitionBy("src", "ref").orderBy(F.when(F.col("how") == "stem", 0).otherwise(1), "dst"))
    return hit.withColumn("nth", first).where("nth = 1").select("src", "dst", "how")


def reverse_models(models: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path) seeds -> (seed, path): templates that refer to the seed by its stem; references are keys, so no text is searched twice."""
    said = models.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"""ref\(['"]([^'"]+)['"]\)"""), F.lit(1)))).alias("stem"))
    return seeds.select(F.col("path").alias("seed"), P.stem(F.col("path")).alias("stem")).join(said, "stem").where("seed <> path").select("seed", "path")


def normalized(path: Column) -> Column:
    """A path without '.' and '..' parts; '..' takes the part before it away."""
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_candidates(ref: Column, source: Column) -> Column:
    """Paths that a relative or scoped reference may mean, the likeliest first."""
    base = normalized(F.concat_ws("/", P.parent(source), ref))
    relative = F.array(base, *[F.concat(base, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")])
    bare = F.regexp_replace(ref, "^@", "")
    sub = F.regexp_replace(bare, "^[^/]*/", "")
    forms = ["node_modules/@{0}", "node_modules/@{0}/index.ts", "node_modules/@{0}/index.js", "packages/{0}", "packages/{0}/src/index.ts", "packages/{0}/src/index.tsx"]
    fill = lambda form, x: F.concat(F.lit(form.split("{0}")[0]), x, F.lit(form.split("{0}")[1]))
    scoped = F.array(*[fill(f, bare) for f in forms])
    inner = F.array(*[fill(f, sub) for f in ("packages/{0}/src/index.ts", "libs/{0}/src/index.ts")])
    scoped = F.when(F.contains(bare, F.lit("/")), F.concat(scoped, inner)).otherwise(scoped)
    return F.when(F.startswith(ref, F.lit("@")), scoped).otherwise(relative)


def naming_variants(files: DataFrame, cap: int = 10) -> DataFrame:
    """(path) -> (path, twin): files whose stem is a test form or a role form of the path's stem, the first ``cap``."""
    stem = P.stem(F.col("path"))
    base = F.replace(F.replace(F.replace(stem, F.lit("_controller"), F.lit("")), F.lit("_service"), F.lit("")), F.lit("_helper"), F.lit(""))
    put = lambda form, x: F.concat(F.lit(form.split("{0}")[0]), x, F.lit(form.split("{0}")[1]))
    # a twin is asked what it is a form of, as few names are: of a stem (0), or of a base (1); what it is not is null
    def made(x, key, i):
        head, tail = key.split("{0}")
        body = F.substring(x, len(head) + 1, F.length(x) - len(head) - len(tail))
        fits = (F.length(x) >= len(head) + len(tail)) & F.startswith(x, F.lit(head)) & F.endswith(x, F.lit(tail))
        return F.when(fits, F.struct(F.lit(i).alias("of"), body.alias("name")))

    forms = F.array_distinct(F.array_compact(F.array(*[made(F.col("stem"), f, 0) for f in TWIN_FORMS], *[made(F.col("stem"), f, 1) for f in ROLE_FORMS])))
    known = files.select(F.col("path").alias("twin"), stem.alias("stem")).select("twin", "stem", F.explode(forms).alias("form")).select("twin", "stem", "form.*")
    # the first of each stem will do, one more than the cap as a path may be among them
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("of", "name", "stem").orderBy("twin"))).where(F.col("nth") <= cap + 1)
    asked = files.select("path", F.explode(F.array(F.struct(F.lit(0).alias("of"), stem.alias("name")), F.struct(F.lit(1).alias("of"), base.alias("name")))).alias("form"))
    pairs = asked.select("path", "form.*").join(sorted_side(known.select("of", "name", "twin")), ["of", "name"]).where("path <> twin")
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("twin"))).where(F.col("nth") <= cap).select("path", "twin")


def test_targets(files: DataFrame, *, size: int = 0) -> DataFrame:
    """(path) -> (test, impl): a test's file beside it, above it or in src, else the first of its stem that is no test.

    With ``size``, about how many files there are, no task has more of them as they grow.
    """
    path = F.col("path")
    stem = F.regexp_replace(F.regexp_replace(F.lower(P.stem(path)), r"(_test|_spec)$", ""), "^test_", "")
    suffix = F.regexp_extract(P.basename(path), r"(\.[^.]+)$", 1)
    join = lambda folder: F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), stem, suffix)
    tests = files.where(P.is_structural_test(path) | matches_glob(path, TEST_GLOBS))
    wanted = F.array(*[F.struct(F.lit(i).alias("order"), c.alias("impl")) for i, c in enumerate((join(P.parent(path)), join(P.parent(P.parent(path))), F.concat(F.lit("src/"), stem, suffix)))])
    asked = dealt(tests.select(path.alias("test"), F.explode(wanted).alias("w")).select("test", "w.*"), 3 * size, "impl")
    beside = asked.join(sorted_side(dealt(files.select(path.alias("impl")), 3 * size, "impl")), "impl").select("test", "order", "impl")
    plain = dealt(files.where(~P.is_structural_test(path)).select("path", F.lower(P.stem(path)).alias("stem")), size, "stem").groupBy("stem").agg(F.min("path").alias("impl"))
    named = dealt(tests.select(path.alias("test"), stem.alias("stem")), size, "stem").join(sorted_side(plain), "stem").select("test", F.lit(9).alias("order"), "impl")
    first = F.row_number().over(Window.partitionBy("test").orderBy("order", "impl"))
    return dealt(beside.union(named).where("test <> impl"), 2 * size, "test").withColumn("nth", first).where("nth = 1").select("test", "impl")


def affected_tests(files: DataFrame, links: DataFrame, changed: DataFrame, *, depth: int = 3, size: int = 0) -> DataFrame:
    """Files, links (src depends on dst, kind) and changed paths -> (path, depth, is_test): the reverse walk over the kinds that bind, with tests by name."""
    near = G.affected(links.where(F.col("kind").isin(EDGE_KINDS)), changed.join(sorted_side(files), "path", "left_semi"), depth=depth)
    walked = near.select("path", "depth", (P.is_structural_test(F.col("path")) | matches_glob(F.col("path"), TEST_GLOBS)).alias("is_test"))
    named = test_targets(files, size=size).join(sorted_side(near.withColumnRenamed("path", "impl")), "impl").select(F.col("test").alias("path"), "depth", F.lit(True).alias("is_test"))
    return walked.union(named).groupBy("path").agg(F.min("depth").alias("depth"), F.max("is_test").alias("is_test"))


def surprise(results: DataFrame, changed: DataFrame) -> DataFrame:
    """(request_id, path, weight) and (request_id, seed) -> surprise: the weight times the farthest a seed's directory is."""
    far = results.join(changed, "request_id").groupBy("request_id", "path", "weight").agg(F.max(P.dir_distance(F.col("path"), F.col("seed"))).alias("far"))
    return far.select("request_id", "path", F.round(F.col("far") * F.col("weight"), 6).alias("surprise"))


def staleness(state: DataFrame, now: DataFrame, *, sample: int = 8) -> DataFrame:
    """One row: how many paths are to be indexed again, the first few of them, and a line that says so."""
    pending = X.changed_since(state, now).select("path")
    few = pending.orderBy("path").limit(sample).agg(F.sort_array(F.collect_list("path")).alias("sample"))
    rows = pending.agg(F.count("*").alias("pending")).crossJoin(few)  # one row each
    more = F.col("pending") - F.size("sample")
    listed = F.concat(F.array_join("sample", ", "), F.when(more > 0, F.concat(F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return rows.select("pending", "sample", F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" file(s) edited since the last index: "), listed)).otherwise("").alias("banner"))


def build_estimate(commits: Column, files: Column) -> dict[str, Column]:
    """Seconds and megabytes that a build is likely to take, scaled from the nearest anchor, with a band and how sure that is."""
    c, f = F.greatest(commits, F.lit(1)).cast("double"), F.greatest(files, F.lit(50)).cast("double")
    large, small = (c > 30_000) | (f > 25_000), (c < 8_000) & (f < 6_000)
    pick = lambda i: F.when(large, F.lit(ANCHORS[2][i])).when(small, F.lit(ANCHORS[0][i])).otherwise(F.lit(ANCHORS[1][i])).cast("double")
    scale = F.pow(c / pick(0), F.lit(0.85)) * F.pow(f / pick(1), F.lit(0.55))
    seconds, mb = pick(2) * scale, pick(3) * F.pow(scale, F.lit(0.92))
    tiny = seconds < 2.0
    seconds, mb = F.when(tiny, F.greatest(F.lit(0.5), c * 0.015 + f * 0.08)).otherwise(seconds), F.when(tiny, F.greatest(F.lit(0.5), f * 0.006 + c * 0.001)).otherwise(mb)
    far = F.abs(F.log10(c / pick(0))) + F.abs(F.log10(f / pick(1))) * 0.5
    spread = F.least(F.lit(0.45), 0.12 + far * 0.08)
    sure = F.when((commits == 0) | (files == 0), "low").when(far > 0.6, "medium").otherwise("high")
    return {
        "seconds_low": F.round(seconds * (1 - spread), 1), "seconds_mid": F.round(seconds, 1), "seconds_high": F.round(seconds * (1 + spread), 1),
        "mb_low": F.round(mb * (1 - spread * 0.7), 1), "mb_mid": F.round(mb, 1), "mb_high": F.round(mb * (1 + spread * 0.7), 1), "confidence": sure,
    }


def _shown(value: Column, digits: int) -> Column:
    return F.bround(value, digits).cast(f"decimal(20,{digits})").cast("string")


def human_duration(seconds: Column) -> Column:
    return F.when(seconds < 90, F.concat(_shown(seconds, 0), F.lit("s"))).when(seconds < 7200, F.concat(_shown(seconds / 60, 1), F.lit(" min"))).otherwise(F.concat(_shown(seconds / 3600, 1), F.lit(" h")))


def human_size(mb: Column) -> Column:
    return F.when(mb < 1, "<1 MB").when(mb < 1024, F.concat(F.lit("~"), _shown(mb, 0), F.lit(" MB"))).otherwise(F.concat(F.lit("~"), _shown(mb / 1024, 1), F.lit(" GB")))


def hub_seed(degrees: DataFrame, items: DataFrame) -> DataFrame:
    """One row: the item of most links, the first by path of equals."""
    return degrees.join(items, "item_id").orderBy(F.desc("degree"), "path").limit(1).select("item_id", "path", "degree")


def modularity_communities(edges: DataFrame, *, min_weight: float = 1.0, resolution: float = 1.0, max_size: int = 50, rounds: int = 2) -> DataFrame:
    """(item_id, community, size) of two and more by local moves of nodes towards higher modularity; larger ones are split once more at 1.2 times the resolution.

    Two rounds, as many as the usual refinement; in each, half of the nodes (by hash), then the other half, move to the community of their neighbours that gains most, so that neighbours do not
    swap places for ever; labels are checkpointed each time.  Equal gains go to the least label.
    """
    strong = checkpointed(edges.where(F.col("weight") >= min_weight).select("src", "dst", "weight"))
    first = _local_moves(strong, resolution, rounds)
    size = F.count("*").over(Window.partitionBy("community"))
    sized = checkpointed(first.withColumn("size", size))
    large = sized.where(F.col("size") > max_size).select("item_id", "community")
    fine = sized.where(F.col("size") <= max_size).select("item_id", F.col("community").cast("string").alias("community"))
    a, b = large.select(F.col("item_id").alias("src"), F.col("community").alias("ca")), large.select(F.col("item_id").alias("dst"), F.col("community").alias("cb"))
    inner = strong.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "weight")
    again = _local_moves(checkpointed(inner), resolution * 1.2, rounds)
    split = again.join(large.withColumnRenamed("community", "outer"), "item_id").select("item_id", F.concat_ws(":", "outer", "community").alias("community"))
    return fine.union(split).withColumn("size", F.count("*").over(Window.partitionBy("community"))).where("size >= 2")


def _local_moves(edges: DataFrame, resolution: float, rounds: int) -> DataFrame:
    sym = symmetric(edges)
    degree = checkpointed(sym.groupBy(F.col("src").alias("item_id")).agg(F.sum("weight").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    labels = checkpointed(degree.select("item_id", F.col("item_id").alias("community")))
    still = 0
    for turn in range(2 * rounds):
        mass = degree.join(labels, "item_id").groupBy("community").agg(F.sum("k").alias("mass"))
        near = sym.join(labels.withColumnRenamed("item_id", "dst"), "dst").groupBy(F.col("src").alias("item_id"), "community").agg(F.sum("weight").alias("w"))
        own = labels.withColumnRenamed("community", "own")
        stay = own.select("item_id", F.col("own").alias("community"), F.lit(0.0).alias("w"))
        every = near.union(stay).groupBy("item_id", "community").agg(F.sum("w").alias("w")).join(mass, "community").join(degree, "item_id").join(own, "item_id")
        rest = F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(total), 9)
        best = every.groupBy("item_id").agg(F.min(F.struct((-gain).alias("g"), (F.col("community") != F.col("own")).alias("leaves"), "community")).alias("b"), F.first("own").alias("own"))
        mine = F.pmod(F.xxhash64("item_id"), F.lit(2)) == turn % 2
        moved = checkpointed(best.select("item_id", F.when(mine, F.col("b.community")).otherwise(F.col("own")).alias("community"), (mine & (F.col("b.community") != F.col("own"))).alias("moved")))
        still = 0 if moved.where("moved").take(1) else still + 1
        labels = moved.select("item_id", "community")
        if still == 2:
            break
    return labels


def report(title: str, subsystems: DataFrame, hubs: DataFrame, stats: DataFrame) -> str:
    """A markdown page from three small results: (subsystem, files), (path, degree), one row of counts; the first 40 and 20 rows are shown."""
    lines = [f"# {title}", ""]
    for name, value in sorted(stats.first().asDict().items()):
        lines.append(f"- {name}: {value}")
    lines += ["", "## Subsystems", "", "| subsystem | files |", "|-|-|"]
    lines += [f"| {r[0]} | {r[1]} |" for r in subsystems.orderBy(F.desc(subsystems.columns[1]), subsystems.columns[0]).limit(40).collect()]
    lines += ["", "## Hubs", "", "| path | degree |", "|-|-|"]
    lines += [f"| {r[0]} | {r[1]} |" for r in hubs.orderBy(F.desc(hubs.columns[1]), hubs.columns[0]).limit(20).collect()]
    return "\n".join(lines) + "\n"
