"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens
together.  Each document becomes its pre-token frequencies; each distinct pre-token of a task is
tokenised once and kept in a table of pieces; the document's count is the join of the two, summed.
The frequencies of a document are joined where they are made: dealt out over the cluster they
would be several times the corpus.  The table of pieces is emptied when it has ``KEPT`` entries,
which bounds memory and changes no count.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

KEPT, LIMIT = 1_000_000, 1024

#: The pre-token pattern of the byte-level tokenizer.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces(dict):
    """Distinct pre-token -> number of tokens, filled as asked."""

    def __init__(self, tokenizer, kept: int):
        super().__init__()
        self.tokenizer, self.kept = tokenizer, kept

    def learn(self, new: list[str]) -> None:
        if len(self) + len(new) > self.kept:
            self.clear()
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for piece, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self[piece] = len(e)

    def __missing__(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False))


def count_batch(texts: list[str | None], table_: Pieces, special: "regex.Pattern | None", pattern=regex.compile(PRE_TOKEN)) -> list[int]:
    freqs, extra = [], []
    for text in texts:
        if special is not None and text and special.search(text):
            parts = special.split(text)
            extra.append(len(parts) - 1)
            f: Counter = Counter()
            for p in parts:
                f.update(pattern.findall(p))
        else:
            extra.append(0)
            f = Counter(pattern.findall(text)) if text else Counter()
        freqs.append(f)
    distinct = set()
    for f in freqs:
        distinct.update(f)
    if len(distinct) <= table_.kept:
        table_.learn([p for p in distinct if p not in table_] if len(table_) + len(distinct) <= table_.kept else (table_.clear() or list(distinct)))
    get = table_.__getitem__
    return [n + sum(map(int.__mul__, map(get, f.keys()), f.values())) for n, f in zip(extra, freqs, strict=True)]


def _count(path: str, limit: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        have = Pieces(tokenizer, kept)
        for batch in pieces(batches, "text"):
            texts = batch.column(1).to_pylist()
            n = count_batch(texts, have, special)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = LIMIT, kept: int = KEPT) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit; one row for each input row.

    ``tokenizer_path`` is a byte-level BPE in the tokenizers library's JSON form, readable on every
    executor.  Added special strings inside a text count as one token each, as is the library's
    default; nothing is added, cut or padded.  Null and empty texts have no tokens; long texts are counted whole, by the
    frequencies of their pre-tokens.  Exactly ``limit`` tokens are not over it.  Repeated rows repeat, an empty table gives an
    empty result, and other columns of any name are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(tokenizer_path, limit, kept), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
