"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """Byte-level BPE from a file of ranks, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and the tokens of the whole ``text``; a null text has none."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(out, T.LongType())])

    def count(batches):
        enc = encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_to_numpy(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(n, np.int64))], names=[*keep, out])

    return df.select(*keep, df[text]).mapInArrow(count, schema)
