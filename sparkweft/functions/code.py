"""Source text to symbols, chunks, imports and pruned bodies.

Line-wise expressions stay in the engine; what needs a scan with memory (where a block ends, which
container a symbol is in) runs over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A declaration: keyword, then name.
DECLARE = r"^\s*(?:export\s+)?(?:public\s+|private\s+|static\s+|async\s+)*(class|module|interface|struct|enum|trait|def|fn|func|function)\s+([A-Za-z_][A-Za-z0-9_]*)"
# Forms of imports, symbol definitions with their kinds, names that are no symbols.
IMPORT_FORMS = [
    r"""^\s*(?:from|import)\s+['".]?(\S+)""",
    r"""^\s*(?:require|require_relative)\s+['"]([^'"]+)""",
    r"""^\s*(?:import|export)\s.*?from\s+['"]([^'"]+)""",
    r"""^\s*(?:const|let|var)\s.*?=\s*require\s*\(\s*['"]([^'"]+)""",
    r"""^\s*#include\s+["<]([^">]+)""",
    r"""^\s*use\s+([^\s;]+)""",
    r"""^\s*package\s+(\S+)""",
    r"""^\s*import\s+"([^"]+)\"""",
]
SYMBOL_FORMS = [
    (r"[ \t]*(?:async\s+)?def\s+(\w+)", "function"),
    (r"[ \t]*(?:class|module)\s+(\w+)", "class"),
    (r"[ \t]*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
    (r"[ \t]*(?:export\s+)?class\s+(\w+)", "class"),
    (r"[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", "function"),
    (r"[ \t]*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function"),
    (r"[ \t]*(?:pub\s+)?(?:struct|trait|enum|impl)\s+(\w+)", "class"),
    (r"func\s+(?:\(\w+\s+[^)]+\)\s+)?(\w+)", "function"),
    (r"type\s+(\w+)\s+(?:struct|interface)", "class"),
]
SKIP_NAMES = set("self cls this new return if else for while try catch throw import from in not and or is None True False null undefined var let const".split())
_SYMBOLS = [(re.compile(p), kind) for p, kind in SYMBOL_FORMS]
_CONTAINER = re.compile(r"[ \t]*(?:class|module)\s+(\w+)")
KEEP_LINE = re.compile(r"\b(def|class|return|raise|import|func|fn|function|interface|struct)\b")
MAX_BODY = 5000


def imports(text: Column) -> Column:
    """Distinct import targets, in the order of their forms."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?m)" + p), F.lit(1)) for p in IMPORT_FORMS])))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def normalized(path: str) -> str:
    """A path without '.' and '..' parts."""
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def symbols_of(text: str | None) -> list[tuple[str, str, int, str | None]]:
    """(symbol, kind, line, container) of definitions in several languages; the container is the nearest class or module above."""
    out, inside = [], None
    for n, line in enumerate((text or "").split("\n"), 1):
        seen = set()
        for form, kind in _SYMBOLS:
            m = form.match(line)
            if m and m[1] not in SKIP_NAMES and m[1] not in seen:
                seen.add(m[1])
                out.append((m[1], kind, n, inside))
        m = _CONTAINER.match(line)
        if m:
            inside = m[1]
    return out


def chunks_of(text: str | None) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, body): a declaration to where its indent, or its braces, end."""
    lines, out = (text or "").split("\n"), []
    for i, line in enumerate(lines):
        m = re.match(DECLARE, line)
        if not m:
            continue
        end = i + 1
        if "{" in line:
            depth = line.count("{") - line.count("}")
            while end < len(lines) and depth > 0:
                depth += lines[end].count("{") - lines[end].count("}")
                end += 1
        else:
            indent = len(line) - len(line.lstrip())
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
                end += 1
        out.append((m[2], i + 1, end, "\n".join(lines[i:end])[:MAX_BODY]))
    return out


def pruned(text: str | None, terms: list[str], ratio: float = 0.55, least: int = 4, most: int = 50) -> str:
    """The first two lines and the best of the rest, in order: a query term scores 2, a keyword 3, a comment 1."""
    lines = (text or "").split("\n")
    if len(lines) <= least:
        return text or ""
    score = []
    for i, line in enumerate(lines):
        low = line.lower()
        s = 2 * sum(t in low for t in terms) + 3 * bool(KEEP_LINE.search(line)) + line.lstrip().startswith(("#", "//"))
        score.append((-s, i))
    count = max(least, min(most, int(len(lines) * ratio)))
    keep = sorted({0, 1} | {i for _, i in sorted(score)[:count]})
    return "\n".join(lines[i] for i in keep)


def _per_text(fn, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in fn(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def symbols(docs: DataFrame) -> DataFrame:
    """(path, text) -> (path, symbol, kind, line, container)."""
    s = pa.string()
    return docs.select("path", "text").mapInArrow(_per_text(symbols_of, ["path", "symbol", "kind", "line", "container"], [s, s, s, pa.int32(), s]), "path string, symbol string, kind string, line int, container string")


def chunks(docs: DataFrame) -> DataFrame:
    """(path, text) -> (path, name, first, last, body)."""
    s = pa.string()
    return docs.select("path", "text").mapInArrow(_per_text(chunks_of, ["path", "name", "first", "last", "body"], [s, s, pa.int32(), pa.int32(), s]), "path string, name string, first int, last int, body string")


def pruned_bodies(docs: DataFrame, terms: list[str]) -> DataFrame:
    s = pa.string()
    return docs.select("path", "text").mapInArrow(_per_text(lambda t: [(pruned(t, terms),)], ["path", "body"], [s, s]), "path string, body string")
