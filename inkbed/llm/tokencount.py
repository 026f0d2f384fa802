"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens.  The first tier is a compact table from frequent pre-tokens
to their lengths in tokens, sent to all workers; a miss goes to the worker's own bounded cache and from there to
the tokenizer.  Pre-tokens are never shuffled.

The table holds at most TABLE entries of at most PIECE_CHARS characters (some 5 MB), taken from SAMPLE_ROWS rows chosen by a
hash.  It is a cache that is warm from the start: what it holds changes the speed and never a count.  Neither the table nor the
workers' caches hold longer pre-tokens, so both are bounded in bytes.

A tokenizer whose file names another pre-tokenizer or a normalizer is refused.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a very long text is counted whole, also where it is a single
pre-token; special strings inside texts are one token each, as the library's default has it; rows without doc_id and repeated
rows are counted like others; extra columns are not read, so their names don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import short_batches

TABLE, PIECE_CHARS, SAMPLE_ROWS = 30_000, 32, 400
#: Entries of a worker's cache, which starts anew when it is full.
CACHE = 300_000
#: The pre-tokenizer that a file has to name, and its pattern.
KIND = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Lengths(dict):
    """Pre-token to length; what is not in the table is looked up in a cache and else encoded."""

    def __init__(self, encode, table: dict[str, int], most: int = CACHE) -> None:
        super().__init__(table)
        self.encode, self.most, self.seen = encode, most, {}

    def __missing__(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = len(self.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= PIECE_CHARS:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen[piece] = n
        return n


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    told = json.loads(t.to_str())
    own = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or any(own.get(k) != v for k, v in KIND.items()):
        raise ValueError(f"{path} has a normalizer or another pre-tokenizer than {KIND}")
    t.no_padding()
    t.no_truncation()
    added = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    return t, regex.compile(PRE_TOKEN), regex.compile("|".join(map(regex.escape, added))) if added else None


@lru_cache(maxsize=2)
def _lengths(path: str, table: tuple[tuple[str, int], ...]) -> Lengths:
    return Lengths(_loaded(path)[0].encode, dict(table))


def _counter(path: str, table: tuple[tuple[str, int], ...]):
    _, pieces, special = _loaded(path)
    lengths = _lengths(path, table)
    find, of = pieces.findall, lengths.__getitem__

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(of, find(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(of, find(p))) for p in parts)

    return count


def frequent(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, most: int = TABLE) -> tuple[tuple[str, int], ...]:
    """(pre-token, length) of the commonest pre-tokens of a bounded sample."""
    t, pieces, _ = _loaded(path)
    total = docs.count()
    place = F.pmod(F.xxhash64(F.lit("tokens"), "doc_id"), F.lit(1 << 30))
    sample = docs.filter((place < min(1.0, rows / max(total, 1)) * (1 << 30)) & (F.length("text") <= 100_000)).select("text").limit(2 * rows).toArrow()
    seen = Counter(chain.from_iterable(pieces.findall(x) for x in sample["text"].to_pylist() if x))
    own = [p for p, _ in seen.most_common(most) if len(p) <= PIECE_CHARS]
    return tuple((p, len(e.ids)) for p, e in zip(own, t.encode_batch(own, add_special_tokens=False), strict=True))


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_bytes (UTF-8) and n_tokens.  path: the tokenizer's file, which all workers can read."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))
    kinds = docs.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_bytes bigint", "n_tokens bigint"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, shared.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(len(kinds)):  # one text at a time is a Python string
                text = x.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kinds))), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                [*(f.name for f in kinds), "n_bytes", "n_tokens"],
            )

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(counted, schema)
