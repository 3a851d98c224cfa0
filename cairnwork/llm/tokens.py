"""Token counts of whole texts, by the merging of bpe.py inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import bounded_batches, text_slices, tidy

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def tokenizer_path(tokenizer: str) -> str:
    """A path as it is; a bare name by the installed public vocabularies, asked on the machine that reads it."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, in one pass without a shuffle: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizer's library for the whole text; strings of special tokens count as one token.
    Null and empty texts have none. Ids, nulls among them, pass through; repeated rows are counted each; other
    columns aren't read; an empty table gives an empty result. A batch goes through in slices of bounded bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer_path(tokenizer))
        for batch in batches:
            for ids, texts in text_slices(batch):
                n = np.fromiter((len(b) // 4 for b in encoder.encode(texts)), np.int64, len(texts))
                size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
