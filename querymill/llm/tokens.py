"""Sizes of texts in tokens of a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.session import spread

#: Vocabulary of ranks; a parameter of every operator that needs sizes.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the splitting pattern published with byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text_col: str, keep: list[str], path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """The keep columns and the number of tokens of the whole text; null text has 0."""
    slim = spread(df.select(*keep, F.col(text_col).alias("__text")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text") + f", {out} long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())
            cols = [*batch.columns[:-1], sizes]
            yield pa.record_batch(cols, names=[*batch.schema.names[:-1], out])

    return slim.mapInArrow(run, ddl)
