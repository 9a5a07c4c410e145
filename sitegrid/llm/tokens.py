"""Sizes in tokens of a public byte-level BPE tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of ranks: one line for each token, base64 of its bytes and its number.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's authors split text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in parts, split before a space that follows a letter or digit, where the pattern splits too.
PART_CHARS = 400_000


class Tokenizer:
    """Token numbers and byte lengths of texts."""

    def __init__(self, file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, number in ranks.items():
            self.bytes_of[number] = len(token)

    def encode(self, text: str) -> list[int]:
        """Tokens of ordinary text; strings that look like special tokens are text too."""
        if len(text) <= PART_CHARS:
            return self.encoding.encode_ordinary(text)
        out, start = [], 0
        while start < len(text):
            end = min(start + PART_CHARS, len(text))
            if end < len(text):
                cut = end
                while cut > start + 1 and not (text[cut] == " " and text[cut - 1].isalnum()):
                    cut -= 1
                end = cut if cut > start + 1 else end
            out += self.encoding.encode_ordinary(text[start:end])
            start = end
        return out


@lru_cache(maxsize=2)
def _loaded(file: bytes) -> Tokenizer:
    return Tokenizer(file)


def tokenizer_of(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A function that gives the tokenizer on any executor: the file (about 1 MB) is read here once and broadcast."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: _loaded(shared.value)


def token_sizes(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., n_tokens`` of every row; a null or empty text has none. One pass in Arrow batches, no shuffle."""
    tokenizer = tokenizer_of(df.sparkSession, vocabulary)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer().encode
        for b in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], sizes], names=[*keep, "n_tokens"])

    schema = df.select(*keep, F.lit(0).cast("long").alias("n_tokens")).schema
    return df.select(*keep, text).mapInArrow(sized, schema)
