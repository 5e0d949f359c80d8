"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import ship_package

#: Folder of the tokenizers' vocabulary files; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """A function from a list of texts to their numbers of tokens."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(t) for t in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``key``, the columns ``keep`` and ``tokens``, the number of tokens of ``text``.

    Whole texts are counted; empty and null texts have 0 tokens.
    """
    ship_package(df.sparkSession)
    kept = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = encoder(folder, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes(texts), pa.int64())], names=[*kept, "tokens"])

    return df.select(*kept, text).mapInArrow(count, schema)
