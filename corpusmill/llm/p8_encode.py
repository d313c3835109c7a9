"""Problem 8: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import TOKENIZERS, encoder
from .common import arrow_map


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every document; null, empty and absent ids are the empty list.

    Texts are encoded whole, whatever their length; strings of special tokens are ordinary text.
    """

    def each(batch):
        e = encoder(path)
        lists = [e.encode(t) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        values = np.fromiter(itertools.chain.from_iterable(lists), np.int32, ends[-1])
        return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) back from ids; the inverse of ``encode`` for every text that is not null."""

    def each(batch):
        e = encoder(path)
        return {"doc_id": batch.column(0), "text": [e.decode(ids or []) for ids in batch.column(1).to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), each, "doc_id long, text string")
