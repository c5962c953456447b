"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies cut a text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in stretches of about this many characters, so that the tokens of a huge text are never held at once.
STRETCH = 100_000
#: A blank or line feed behind a letter or digit always begins a word of the pattern, so a cut there changes no count.
_CUT = re.compile(r"(?<=\w)[ \n]")

_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def stretches(text: str) -> Iterator[str]:
    """The whole text in pieces that end at the first place behind STRETCH characters where the pattern always cuts; a text without such a place is one piece."""
    at = 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    tokenizer = encoder(path)
    return sum(len(tokenizer.encode_ordinary(s)) for s in stretches(text))


def token_counts(documents: DataFrame, keep: list[Column | str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` with n_tokens: 0 for a null or empty text. Only these columns and the text reach Python."""
    rows = documents.select(*keep, F.col(text).alias("__text"))
    names = rows.columns[:-1]
    schema = rows.drop("__text").schema.add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, path) if t else 0 for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64())], [*names, "n_tokens"])

    return rows.mapInArrow(run, schema)
