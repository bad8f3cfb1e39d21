"""Exact top-k search by tiled matrix products.

Each component x becomes floor(scale * x) in double precision; the score is the
integer inner product. Queries are the rows whose id is divisible by ``every``,
candidates are all rows but the query's own. A tile of queries and vectors is
one matrix product in double precision, exact while no sum can pass 2^53; beyond
that the tile is computed in Python's integers. Each tile keeps ``k`` rows of each
query by partial selection, and the lists are merged in a tree.

Vectors that are null or empty or hold null or non-finite components take no
part, nor do rows without an id. A query sees vectors of its own dimension only.
A query is an id with a vector: rows that repeat both ask once, rows of one id with
unlike vectors have a list each. Rows that repeat an id are candidates of their own, but
not of a query with that id. Ties go to the smaller id. A score outside a long counts as
the long's bound. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from waymark.llm.tiles import merged, tiled, usable

#: Queries whose scores stand in memory at a time.
ROWS = 256


def top_of_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each row the places of its ``k`` highest scores, ties to the smaller id; ``ids`` ascend, the row's own id is left out."""
    for row, me in zip(scores, own, strict=True):
        mine = slice(*np.searchsorted(ids, [me, me + 1]))
        free = np.ones(len(ids), bool)
        free[mine] = False
        at = np.flatnonzero(free)
        if len(at) > k:
            had = row[at]
            bar = np.partition(had, len(at) - k)[len(at) - k]
            at = at[had >= bar]
        yield at[np.lexsort((ids[at], -row[at] if row.dtype != object else np.array([-x for x in row[at]], object)))][:k]


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not queries.size or not vectors.size or np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53:
        return queries @ vectors.T
    whole = [np.array([[int(x) for x in row] for row in side], object) for side in (queries, vectors)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1)


def exact_top_k(frame: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (long)."""
    def score(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "h": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            ids, own, names = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["h"].to_numpy()
            a, b = (np.floor(scale * np.vstack(x["v"].to_list()).astype(float)) for x in (queries, vectors))
            for at in range(0, len(own), ROWS):
                block = _scores(a[at : at + ROWS], b)
                for me, name, row, best in zip(own[at:], names[at:], block, top_of_rows(block, ids, own[at : at + ROWS], k), strict=False):
                    out["query_id"] += [me] * len(best)
                    out["h"] += [name] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["score"] += [int(x) for x in row[best]]
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})

    lists, shards = tiled(usable(frame, key, vector), every, k, score, "query_id long, h long, vec_id long, score long")
    return merged(lists, shards, k)
