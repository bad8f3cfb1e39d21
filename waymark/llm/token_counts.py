"""Token counts: batch encoding in Arrow functions that return lengths only.

One map over the documents, no shuffle. Each Arrow batch is dealt into parts of
about ``batch_bytes`` of text; ``tokens`` cuts long texts at safe boundaries, so
neither one huge document nor a run of them makes a large batch for the
library. Whole texts are counted, without truncation.

Null and empty texts have no bytes and no tokens. Repeated rows and ids stay as
they are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tokens import tokenizer


def parts_by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [from, to) of rows with about ``most`` bytes each; a larger row stands alone."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(frame: DataFrame, model_path: str, limit: int, key: str = "doc_id", text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""

    def lengths(batches):
        counter = tokenizer(model_path)
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            found = [counter.counts(batch.column(1).slice(a, b - a)) for a, b in parts_by_bytes(sizes, batch_bytes)]
            counts = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["key", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    read = frame.select(F.col(key).alias("key"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = read.schema["key"].dataType.simpleString()
    return read.mapInArrow(lengths, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
