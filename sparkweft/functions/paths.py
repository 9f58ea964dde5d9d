"""Path predicates, classes and distances, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term lists and patterns of the path and query taxonomy.
INTENT_TERMS = {
    "test": ["test", "spec", "assert", "coverage", "mock", "fixture", "factory", "rspec", "pytest", "jest"],
    "endpoint": ["endpoint", "route", "routes", "controller", "api", "request", "response"],
    "schema": ["schema", "migration", "migrate", "column", "table", "db", "database"],
    "docs": ["doc", "docs", "readme", "guide", "documentation"],
    "openapi": ["openapi", "swagger"],
}
TEST_TERMS = ["test", "spec", "mock", "stub", "fixture", "factory", "rspec", "jest", "pytest", "minitest", "coverage", "assert"]
CONCEPT_HINTS = "how|what|where|why|authentication|authorize|middleware|openapi|security|dependency|routing"
TEST_PATH = r"(?i)(^|/)(spec|test|tests|__tests__)/|_(spec|test)\.|\.(spec|test)\."
STRUCTURAL_TEST = r"(^|/)test_[^/]*$"
NOISE_PREFIX = r"^(docs_src/|docs/|scripts/)"
CLASS_RULES = [
    ("generated", r"\.lock$|\.pb\.go$|\.min\.js$|/dist/|/build/"),
    ("test", r"(^|/)(spec|test|tests|__tests__)(/|$)|(_spec|_test|\.spec|\.test)\."),
    ("fixture", r"/fixtures/|/factory/|/factories/"),
    ("migration", r"/db/migrate/|/migrations/"),
    ("route", r"routes\.rb$|/routes/|/templates/"),
    ("doc", r"\.(md|rst|txt)$|/docs/"),
    ("config", r"/config/|(^|/)(dockerfile|makefile)$|\.(yaml|yml|toml|ini|json)$"),
]
TOKENS_PER_BYTE = {".py": 0.28, ".rb": 0.27, ".js": 0.28, ".ts": 0.28, ".tsx": 0.29, ".jsx": 0.29, ".java": 0.25, ".go": 0.25, ".rs": 0.26, ".sql": 0.24, ".yml": 0.31, ".yaml": 0.31, ".json": 0.35, ".md": 0.25, ".txt": 0.24}
EXCLUDED_DIRS = ["node_modules", "vendor", "dist", "build", "target", ".venv", "venv", "Pods", ".next", "__pycache__", ".git"]


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_structural_test(path: Column) -> Column:
    return is_test(path) | path.rlike(STRUCTURAL_TEST)


def is_noise(path: Column) -> Column:
    return is_test(path) | path.rlike(NOISE_PREFIX)


def excluded(path: Column, dirs: list[str] = EXCLUDED_DIRS, *, tests: bool = False, patterns: list[str] | None = None) -> Column:
    """Whether a path is in, or is, one of the directories, in a test directory (if so asked), or under one of the caller's globs or prefixes."""
    out = (path == "") | path.rlike("(^|/)(" + "|".join(re.escape(d) for d in dirs) + ")(/|$)")
    if tests:
        out = out | path.rlike("(^|/)tests?(/|$)")
    for p in patterns or []:
        bare = re.sub("^[./]+", "", p)
        out = out | path.rlike(glob_regex(bare)) | path.rlike(glob_regex(bare.rstrip("/"))) | F.startswith(path, F.lit(bare.rstrip("/") + "/"))
    return out


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over a whole name; ``*`` crosses directories."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def file_class(path: Column) -> Column:
    low, out = F.lower(path), F.lit("source")
    for name, pattern in reversed(CLASS_RULES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def query_intent(query: Column) -> Column:
    low = F.lower(query)
    terms = F.array_distinct(F.split(F.trim(low), r"\s+"))
    hits = {k: F.size(F.array_intersect(terms, F.array(*map(F.lit, v)))) for k, v in INTENT_TERMS.items()}
    most, out = F.greatest(*hits.values()), F.lit("default")
    for k in reversed(list(INTENT_TERMS)):
        out = F.when((hits[k] == most) & (most > 0), k).otherwise(out)
    return F.when(low.contains("openapi") | low.contains("swagger"), "openapi").otherwise(out)


def looks_like_symbol(query: Column) -> Column:
    terms = F.regexp_extract_all(query, F.lit(r"([a-zA-Z][\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.exists(terms, lambda t: t.rlike("^[A-Z]")) | ((F.size(terms) == 1) & F.coalesce(F.get(terms, 0).contains("_"), F.lit(False)))


def is_concept(query: Column) -> Column:
    return (F.size(F.split(F.trim(query), r"\s+")) >= 4) | F.lower(query).rlike(CONCEPT_HINTS)


def is_test_focused(query: Column) -> Column:
    return F.arrays_overlap(F.split(F.trim(F.lower(query)), r"\s+"), F.array(*map(F.lit, TEST_TERMS)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def mirror_key(path: Column) -> Column:
    """The stem that a file and its test share."""
    s = F.regexp_replace(F.lower(stem(path)), r"(_spec|_test|\.spec|\.test)$", "")
    return F.regexp_replace(s, "^test_", "")


def shared_dirs(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = F.split(parent(a), "/"), F.split(parent(b), "/")
    same = F.zip_with(x, y, lambda p, q: (p == q) & p.isNotNull() & (p != ""))
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s.on & F.coalesce(e, F.lit(False))).alias("on"), (s.n + F.when(s.on & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n")), lambda s: s.n)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def locality(seed: Column, path: Column) -> Column:
    shared = shared_dirs(seed, path)
    gap = depth(seed) - shared
    return F.when(shared == 0, 1.0).when(gap <= 0, 3.0).when(gap == 1, 1.8).otherwise(1.3)


def dir_distance(a: Column, b: Column) -> Column:
    return depth(a) + depth(b) - 2 * shared_dirs(a, b)


def auto_prefix(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).when(F.size(parts) == 2, F.get(parts, 0)).otherwise(".")


def token_estimate(path: Column, text: Column) -> Column:
    low, out = F.lower(path), F.floor(F.octet_length(text) / 4)
    for suffix, ratio in TOKENS_PER_BYTE.items():
        out = F.when(low.endswith(suffix), F.floor(F.octet_length(text) * ratio)).otherwise(out)
    return F.greatest(out, F.lit(1)).cast("long")


def hub_penalty(degree: Column, strength: float = 1.0, floor: int = 80) -> Column:
    return F.greatest(F.lit(1.0), F.log2(2 + F.greatest(degree - floor, F.lit(0))) * strength)


def tie_break(degree: Column, eps: float = 0.1) -> Column:
    return eps * F.log2(2 + degree)


def file_class_weight(kind: Column, intent: Column, path: Column) -> Column:
    """Multiplier of a file class under a query intent."""
    low = F.lower(path)
    # What each class counts for, the first that fits.
    table = [
        (kind == "generated", 0.01),
        (kind == "fixture", 0.1),
        ((intent == "endpoint") & (kind == "route"), 2.5),
        ((intent == "endpoint") & (kind == "source") & low.rlike("controller|model|service|serializer|patient"), 1.4),
        ((intent == "endpoint") & (kind == "doc"), 0.2),
        ((intent == "schema") & (kind == "migration"), 2.0),
        ((intent == "schema") & (kind == "route"), 0.5),
        ((intent == "docs") & (kind == "doc"), 2.0),
        ((intent == "openapi") & low.contains("/openapi/") & low.endswith("openapi/models.py"), 4.5),
        ((intent == "openapi") & low.contains("/openapi/"), 3.5),
        ((intent == "openapi") & low.rlike(r"^fastapi/([^/]+|_compat/[^/]+)$"), 0.35),
        ((intent == "openapi") & (low.endswith("routing.py") | (kind == "route")), 0.5),
        ((intent == "test") & (kind == "test"), 2.0),
        (kind == "doc", 0.5),
    ]
    out = F.lit(1.0)
    for test, weight in reversed(table):
        out = F.when(test, weight).otherwise(out)
    return out


def adaptive_cap(query: Column, high_fanout: Column, profile_cap: int = 100) -> Column:
    q = F.trim(F.coalesce(query, F.lit("")))
    n = F.size(F.regexp_extract_all(q, F.lit(r"([a-zA-Z][\p{L}\p{N}_]{2,})"), F.lit(1)))
    cap = F.when(high_fanout, 75).when(q == "", 25).when((n <= 2) & (F.length(q) < 48), 25).when((n >= 5) | (F.length(q) >= 80), 75).otherwise(50)
    return F.least(cap, F.lit(profile_cap))


def confidence(sparse: Column, truncated: Column, query_only: Column, hits: Column, files: Column) -> Column:
    score = F.lit(1.0)
    for test, cost in ((sparse, 0.18), (truncated, 0.28), (query_only & (hits == 0), 0.35), (files < 2, 0.10)):
        score = score - F.when(test, cost).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, "AKIA[0-9A-Z]{16}", "***REDACTED***")
    return F.regexp_replace(out, r"""(?i)(api|secret)_?key["']?\s*[:=]\s*["'][^"']+["']""", "***REDACTED***")
