"""Secret scan with multipart credential linking, in DataFrame operations only.

Three kinds of secret stand on their own (assign, access, hex).  Three weaker kinds of part, account
identifiers, key-like strings and endpoints, are reported only where complementary parts meet: an
identifier or an endpoint with a secret, a key-like string with an identifier or an endpoint.  Parts
meet when one starts within ``SCOPE`` code points of the other: an interval join of candidates with
parts, on the row and the bins of the position, over parts pre-aggregated to one row for each
bin and role, so that crowded scopes make no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCOPE = 256

# The patterns of the base kinds.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
# The weak kinds.
IDENT = r"""([Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey_?[Ii][Dd]|[Uu]ser_?[Nn]ame|[Uu]ser|[Ll]ogin|[Aa]ccount)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
KEY = "[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"""[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""

KINDS = ["assign", "access", "hex", "ident", "key", "endpoint"]
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "key": "secret", "endpoint": "endpoint"}
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(df: DataFrame, kind: str, pattern: str, keep: str = "true") -> DataFrame:
    """Adds column s_<kind>: the spans of the leftmost non-overlapping matches m that satisfy ``keep``.

    The matches and the pieces between them, in turn, give the positions.
    """
    lit = lambda p: F.lit(p)
    df = df.withColumn("m", F.regexp_extract_all("body", lit(pattern), F.lit(0)))
    df = df.withColumn("p", F.when(F.size("m") > 0, F.split("body", pattern, -1)).otherwise(F.array().cast("array<string>")))
    walk = f"""aggregate(arrays_zip(slice(p, 1, size(m)), m), named_struct('at', 0L, 'out', cast(array() as {_SPAN})),
      (acc, z) -> named_struct('at', acc.at + length(z.`0`) + length(z.m), 'out',
        if({keep}, concat(acc.out, array(named_struct('start', acc.at + length(z.`0`), 'kind', {KINDS.index(kind)}, 'end', acc.at + length(z.`0`) + length(z.m)))), acc.out)),
      acc -> acc.out)"""
    return df.withColumn(f"s_{kind}", F.expr(walk)).drop("m", "p")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({spans}), s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')"


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, base, weak: the spans of each text, weak ones without those that overlap a base span."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    value = rf"length(regexp_extract(z.m, '{ASSIGN.replace(chr(39), chr(92) + chr(39)).replace(chr(92) + 'x', chr(92) * 2 + 'x')}', 2)) >= 8"
    df = _spans(df, "assign", ASSIGN, value)
    df = _spans(df, "access", ACCESS)
    df = _spans(df, "hex", HEX)
    df = _spans(df, "ident", IDENT)
    df = _spans(df, "key", "(?<![A-Za-z0-9+/_-])" + KEY, "z.m rlike '[0-9]' and z.m rlike '[A-Za-z]'")
    df = _spans(df, "endpoint", ENDPOINT)
    df = df.withColumn("base", F.concat("s_assign", "s_access", "s_hex"))
    return df.select(
        "doc_id", "base", F.expr("filter(concat(s_ident, s_key, s_endpoint), w -> not exists(base, b -> b.start < w.end and w.start < b.end))").alias("weak")
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, base, weak) -> (row, start, kind, end) of the weak spans that meet a complementary part."""
    role = "element_at(array(" + ", ".join(f"'{ROLE[k]}'" for k in KINDS) + "), s.kind + 1)"
    every = parts.where("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("s"))
    points = every.select("row", F.expr(role).alias("role"), F.expr("s.start").alias("at")).withColumn("bin", F.expr(f"at div {scope}"))
    points = points.groupBy("row", "bin", "role").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    cand = parts.where("size(weak) > 0").select("row", F.explode("weak").alias("s")).select("row", "s.*", F.expr(role).alias("own"))
    cand = cand.withColumn("bin", F.explode(F.expr(f"sequence(greatest(start - {scope}, 0) div {scope}, (end + {scope}) div {scope})")))
    met = cand.join(points, ["row", "bin"]).where(
        (F.col("last") >= F.col("start") - scope)
        & (F.col("first") <= F.col("end") + scope)
        & (F.when(F.col("own") == "secret", F.col("role") != "secret").otherwise(F.col("role") == "secret"))
    )
    return met.select("row", "start", "kind", "end").distinct()


def find_secrets(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row for each input row.

    Null and empty texts have no spans (an empty list).  Repeated rows repeat; other columns are not
    read.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    parts = scratch.keep(parts_of(docs).withColumn("row", F.monotonically_increasing_id()))
    extra = linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    out = parts.join(extra, "row", "left").withColumn("extra", F.coalesce("extra", F.expr(f"cast(array() as {_SPAN})")))
    count = lambda k: F.expr(f"cast(size(filter(base, b -> b.kind = {KINDS.index(k)})) as bigint)").alias(f"n_{k}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("concat(base, extra)")).alias("spans")
    )


def op4_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def q(p: str) -> str:
        return p.replace("'", "''")

    keep = {
        "assign": f"length(regexp_extract(m, '{q(ASSIGN)}', 2)) >= 8",
        "key": "length(m) >= 24 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "key": "[A-Za-z0-9+/_-]+", "endpoint": ENDPOINT}
    each = []
    for i, k in enumerate(KINDS):
        each.append(
            f"SELECT doc_id, {i} AS kind, '{k}' AS name, '{ROLE[k]}' AS role, pos - length(m) AS start, pos AS e FROM (SELECT doc_id, n, m, "
            f"CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS pos FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS n, unnest(ms) AS m, unnest(ps[1 : len(ms)]) AS p "
            f"FROM (SELECT doc_id, regexp_extract_all(body, '{q(pattern[k])}') AS ms, string_split_regex(body, '{q(pattern[k])}') AS ps FROM bodies))) WHERE {keep.get(k, 'true')}"
        )
    return f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS ({" UNION ALL ".join(each)}),
base AS (SELECT * FROM found WHERE kind < 3),
weak AS (SELECT * FROM found w WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.e AND w.start < b.e)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
kept AS (SELECT * FROM base UNION ALL SELECT * FROM weak w WHERE EXISTS (
  SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.start BETWEEN w.start - {SCOPE} AND w.e + {SCOPE}
  AND CASE WHEN w.role = 'secret' THEN p.role <> 'secret' ELSE p.role = 'secret' END)),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg(name || ':' || start || ':' || e, ',' ORDER BY start, kind) AS s FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(name || ':' || start || ':' || e, ',' ORDER BY start, kind) AS s FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id"""


SQL = _sql()
