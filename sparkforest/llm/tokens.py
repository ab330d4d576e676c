"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 200_000


def tokenizer_file(name: str = TOKENIZER) -> str:
    """Where the vocabulary file of that name lies; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of the whole text; 0 for null and empty. Beyond PIECE_CHARS the text is counted in pieces, cut where a
    letter follows white space other than a blank, which no token spans; without such a place, at that length."""
    if not text:
        return 0
    enc = _encoding(path)
    if len(text) <= PIECE_CHARS:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        if end < len(text):
            while (brk := text.rfind("\n", at + 1, end)) > at and not text[brk + 1].isalpha():
                end = brk
            end = brk + 1 if brk > at else min(len(text), at + PIECE_CHARS)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_sizes(documents: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, *keep, n_tokens bigint): the size of every document's whole text; only these columns are read."""
    path = tokenizer_file(tokenizer)
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    names = ["doc_id", *keep]

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, path) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], names=[*names, "n_tokens"])

    return documents.select(*names, F.col("text")).mapInArrow(size, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_tokens bigint")
