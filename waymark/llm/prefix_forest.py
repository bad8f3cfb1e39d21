"""Approximate nearest neighbours: one forest of hash-prefix trees over the whole table.

A tree is the sorted array of all vectors' hash strings: ``BITS`` signs against
orthogonal hyperplanes drawn from a fixed seed. All vectors of one prefix lie
together in the array, so a node of the tree is a range of it. The arrays are dealt
by prefix: a leaf holds about ``LEAF`` strings, and a leaf with many more (vectors that
lie close together) is split by rows, with all its queries asking each part.

1. A query asks each tree with ``PROBES`` strings: its own, and that with those bits of its
   prefix turned that it is least sure of (the smallest distances to their hyperplanes).
   Each string descends to the longest prefix it shares with any string of its leaf, of
   whatever length, and counts what each node on the way down holds.
2. The counts of all trees are added up by query and level. All trees ascend
   together, one bit at a time, from the deepest match to the first level where
   their nodes hold the query's budget. That level is taken whole, so the order
   of rows plays no part.
3. The rows of these nodes are the query's candidates: each is scored once, with its cosine
   on the original vectors in double precision, in the block of vectors where it lies.
   Queries that met fewer than k, as in tables of a few vectors, are scored against all.

The budget is ``budget_for(n)``, a power of the number of vectors below 1: a query meets an
ever smaller share of a growing table, and no size is searched exhaustively by a
switch. No vector is copied for each query; what moves are strings, row numbers, and a
query's vector to the blocks that hold its candidates.

The hyperplanes go through the centre of a bounded sample of ``SAMPLE`` vectors:
the only thing fitted, and every vector is indexed. ``README.md`` has the recall
against brute force.

Vectors that are null, empty or zero or hold null or non-finite components take
no part, nor do rows without an id. A query sees vectors of its own dimension
only. A query is an id with a vector: rows that repeat both ask once, and rows of one id with
unlike vectors have a list each. Rows that repeat an id are candidates of their own, but not
of a query with that id. Of equal vectors only the k + 1 smallest ids can be in a list, and of
equal rows only k: no others are indexed, so a large group of copies costs nothing.
Ties go to the smaller id; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import cut_lineage
from waymark.llm.tiles import usable

TREES, BITS, PROBES, SAMPLE = 64, 48, 32, 4096
#: Strings of a leaf; vectors of a block; queries of a leaf's task; queries of a block's task.
LEAF, BLOCK, ASKED, SCORED = 4096, 8192, 2048, 16384
#: Levels below a leaf's root that are told apart.
DEEP = 24


#: Factor and power of a query's budget: the power is that of sign strings for neighbours at a cosine of about 0.45.
BUDGET = (6.0, 0.62)


def budget_for(n: int) -> int:
    """Meetings of a query with vectors, in all trees together, at which the ascent ends."""
    return math.ceil(BUDGET[0] * n ** BUDGET[1])


def root_level(n: int, leaf: int) -> int:
    """Length of the prefix by which leaves of about so many strings are dealt."""
    return max(0, int(math.log2(max(1, n) / leaf)))


def turned_bits(n: int) -> int:
    """Length of the prefix in which probes turn bits: about where the ascent ends."""
    return int(min(BITS, max(4, round(math.log2(TREES * PROBES * max(1, n) / budget_for(max(1, n)))))))


def planes_for(dim: int) -> np.ndarray:
    """A column for each bit of each tree; within a tree orthogonal, as far as the dimension goes."""
    rng = np.random.default_rng(dim)
    wide = -(-BITS // dim)
    return np.hstack([np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(wide)])[:, :BITS] for _ in range(TREES)])


def templates(bits: int) -> list[tuple[int, ...]]:
    """``PROBES`` sets of places in the order of certainty, the likeliest to hold the true string first (by the expected squares of ordered distances)."""
    cost = [j * (j + 1) / (4 * (bits + 1) * (bits + 2)) for j in range(1, bits + 1)]
    out: list[tuple[int, ...]] = [()]
    open_ = [(cost[0], (0,))]
    while open_ and len(out) < PROBES:
        at, places = heapq.heappop(open_)
        out.append(places)
        last = places[-1] + 1
        if last < bits:
            heapq.heappush(open_, (at + cost[last], (*places, last)))
            heapq.heappush(open_, (at + cost[last] - cost[last - 1], (*places[:-1], last)))
    return out


_WORTH = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)


def _distances(units: np.ndarray, planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((units - centre) @ planes).reshape(len(units), TREES, BITS)


def strings(units: np.ndarray, planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The hash string of each vector in each tree, as a number."""
    return (_distances(units, planes, centre) > 0) @ _WORTH


def probes(units: np.ndarray, planes: np.ndarray, centre: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` strings of each query in each tree."""
    away = _distances(units, planes, centre)
    own = (away > 0) @ _WORTH
    order = np.argsort(np.abs(away[:, :, :bits]), axis=2, kind="stable")
    turned = [_WORTH[order[:, :, list(places)]].sum(axis=2) if places else np.zeros_like(own) for places in templates(bits)]
    return own[:, :, None] ^ np.stack(turned, axis=2)


def spans(sorted_: np.ndarray, asked: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``sorted_`` the node of each asked string at ``level`` starts and ends."""
    width = np.int64(BITS) - np.asarray(level, np.int64)
    low = asked >> width << width
    return np.searchsorted(sorted_, low), np.searchsorted(sorted_, low + (np.int64(1) << width))


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cosine(x: np.ndarray, y: np.ndarray, x_unit: np.ndarray, y_unit: np.ndarray) -> float:
    """On the original vectors; on unit vectors where those are too large or too small for doubles."""
    with np.errstate(all="ignore"):
        norms = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return float(x @ y) / norms if 1e-140 < norms < 1e140 else float(x_unit @ y_unit)


def _matrix(column) -> np.ndarray:
    return np.vstack(column.to_list()).astype(float)


def nearest(frame: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine)."""
    return answers(*candidates(frame, k, every, key, vector), k)


def candidates(frame: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the forest finds: queries (query, query_id, dim, v), vectors (row, vec_id, dim, v) and met (query, rows: the candidates' numbers)."""
    whole = usable(frame, key, vector).where(F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))
    # Only the first of equal rows and ids matter; the window's limits work before the shuffle too.
    copy = F.row_number().over(Window.partitionBy("h", "v", "vec_id").orderBy(F.lit(0)))
    alike = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    some = whole.withColumn("copy", copy).where(F.col("copy") <= k).withColumn("alike", alike).where(F.col("alike") <= k + 1)
    vectors = cut_lineage(some.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "v"))
    asking = whole.where(F.col("vec_id") % every == 0).groupBy("h", "vec_id", "dim", "v").agg(F.lit(1))
    queries = cut_lineage(asking.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "dim", "v"))

    leaf_size, root_of = LEAF, root_level
    centres: dict[int, np.ndarray] = {}
    fitted = vectors.orderBy(F.xxhash64("v"), "row").limit(SAMPLE).select("dim", "v").collect()
    for dim in {r.dim for r in fitted}:
        centres[dim] = _units(np.array([r.v for r in fitted if r.dim == dim])).mean(axis=0)
    planes: dict[int, np.ndarray] = {}

    def hashed(units: np.ndarray, work, *more) -> np.ndarray:
        dim = units.shape[1]
        if dim not in planes:
            planes[dim] = planes_for(dim)
        return work(units, planes[dim], centres.get(dim, np.zeros(dim)), *more)

    def parts(batches, rows: int):
        for batch in batches:
            for (dim, n), own in batch.groupby(["dim", "n"]):
                for at in range(0, len(own), rows):
                    yield int(dim), int(n), own.iloc[at : at + rows]

    def indexed(batches):
        for dim, n, own in parts(batches, 512):
            codes = hashed(_units(_matrix(own["v"])), strings)
            tree = np.tile(np.arange(TREES), len(own))
            yield pd.DataFrame({"dim": dim, "tree": tree, "leaf": codes.ravel() >> (BITS - root_of(n, leaf_size)), "row": np.repeat(own["row"].to_numpy(), TREES), "code": codes.ravel()})

    def asked(batches):
        for dim, n, own in parts(batches, 64):
            codes = hashed(_units(_matrix(own["v"])), probes, turned_bits(n)).reshape(-1, PROBES)
            leaf = codes >> (BITS - root_of(n, leaf_size))
            out = {"query": [], "tree": [], "leaf": [], "codes": []}
            for i, (query, tree) in enumerate((q, t) for q in own["query"].tolist() for t in range(TREES)):
                for one in np.unique(leaf[i]).tolist():
                    out["query"].append(query)
                    out["tree"].append(tree)
                    out["leaf"].append(one)
                    out["codes"].append(codes[i][leaf[i] == one])
            yield pd.DataFrame({"dim": dim, "n": n, **out})

    numbers = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    index = vectors.join(numbers, "dim").select("row", "dim", "n", "v").mapInPandas(indexed, "dim int, tree int, leaf long, row long, code long")
    asks = queries.join(numbers, "dim").select("query", "dim", "n", "v").mapInPandas(asked, "dim int, n long, query long, tree int, leaf long, codes array<long>")
    asks = cut_lineage(asks)
    place = ["dim", "tree", "leaf"]
    sizes = index.groupBy(place).agg(F.count("*").alias("have")).join(asks.groupBy(place).agg(F.count("*").alias("ask")), place)
    sizes = cut_lineage(sizes.select(*place, F.ceil(F.col("have") / (2 * LEAF)).cast("int").alias("parts"), F.ceil(F.col("ask") / ASKED).cast("int").alias("turns")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    leaves = index.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("turn", upto("turns")).select(*place, "part", "turn", "row", "code")

    def meet(asks: DataFrame, work, schema: str) -> DataFrame:
        dealt = asks.join(sizes, place).withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).withColumn("part", upto("parts"))
        by = [*place, "part", "turn"]
        return leaves.groupBy(by).cogroup(dealt.drop("parts", "turns").groupBy(by)).applyInPandas(work, schema)

    def unpacked(leaf: pd.DataFrame, asks: pd.DataFrame):
        leaf = leaf.sort_values("code", kind="stable")
        counts = asks["codes"].map(len).to_numpy()
        return leaf["code"].to_numpy(), leaf["row"].to_numpy(), np.concatenate(asks["codes"].to_list()), np.repeat(np.arange(len(asks)), counts)

    def counted(leaf: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(leaf) or not len(asks):
            return pd.DataFrame({"query": np.empty(0, np.int64), "root": np.empty(0, np.int32), "held": pd.Series([], dtype=object)})
        sorted_, _, codes, of = unpacked(leaf, asks)
        root = root_of(int(asks["n"].iloc[0]), leaf_size)
        held = np.zeros((len(asks), DEEP), np.int64)
        for deep in range(min(DEEP, BITS - root + 1)):  # descend
            start, end = spans(sorted_, codes, root + deep)
            held[:, deep] = np.bincount(of, end - start, len(asks))
            if not held[:, deep].any():
                break
        return pd.DataFrame({"query": asks["query"], "root": root, "held": pd.Series(list(held), dtype=object).to_numpy()})

    held = meet(asks, counted, "query long, root int, held array<long>")
    sums = held.groupBy("query").agg(F.first("root").alias("root"), F.array(*(F.sum(F.col("held")[d]) for d in range(DEEP))).alias("held"))
    budget = asks.groupBy("query").agg(F.ceil(F.lit(BUDGET[0]) * F.pow(F.first("n"), F.lit(BUDGET[1]))).alias("budget"))
    # Ascend together: the deepest level that holds the budget, else the leaves' roots.
    enough = F.size(F.filter(F.col("held"), lambda x: x >= F.col("budget")))
    level = F.col("root") + F.greatest(enough - 1, F.lit(0))
    levels = cut_lineage(sums.join(budget, "query").select("query", level.cast("int").alias("level")))

    def gathered(leaf: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "rows": []}
        if len(leaf) and len(asks):
            sorted_, rows, codes, of = unpacked(leaf, asks)
            start, end = spans(sorted_, codes, asks["level"].to_numpy()[of])
            names = asks["query"].tolist()
            for i in np.unique(of[end > start]).tolist():
                mine = slice(*np.searchsorted(of, [i, i + 1]))
                out["query"].append(names[i])
                out["rows"].append(np.unique(np.concatenate([rows[a:b] for a, b in zip(start[mine].tolist(), end[mine].tolist(), strict=True)])))
        return pd.DataFrame({"query": np.array(out["query"], np.int64), "rows": pd.Series(out["rows"], dtype=object)})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query": group["query"].iloc[:1], "rows": [np.unique(np.concatenate(group["rows"].to_list()))]})

    met = meet(asks.join(levels, "query"), gathered, "query long, rows array<long>").groupBy("query").applyInPandas(joined, "query long, rows array<long>")
    return queries, vectors, met


def answers(queries: DataFrame, vectors: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best candidates by their cosines, scored where the vectors lie."""
    n, asking = vectors.count(), queries.count()
    blocks = max(1, -(-n // BLOCK))

    def scored(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asks):
            block = block.sort_values("row", kind="stable")
            rows, ids = block["row"].to_numpy(), block["vec_id"].to_numpy()
            raw = block["v"].to_list()
            sizes = np.array([len(v) for v in raw])
            units: dict[int, np.ndarray] = {}
            for query, me, v, own in zip(asks["query"], asks["query_id"], asks["v"], asks["rows"], strict=True):
                x = np.asarray(v, float)
                at = np.flatnonzero(sizes == len(x)) if own is None else np.searchsorted(rows, np.sort(own))
                at = at[ids[at] != me]
                if not len(at):
                    continue
                if len(x) not in units:
                    units[len(x)] = _units(np.vstack([r if len(r) == len(x) else np.ones(len(x)) for r in raw]).astype(float))
                x_unit, y_unit = _units(x[None, :])[0], units[len(x)]
                cosine = y_unit[at] @ x_unit
                if len(at) > k:
                    at = at[cosine >= np.partition(cosine, len(at) - k)[len(at) - k] - 1e-9]
                exact = np.array([_cosine(x, np.asarray(raw[i], float), x_unit, y_unit[i]) for i in at])
                best = np.lexsort((ids[at], -exact))[:k]
                out["query"] += [query] * len(best)
                out["query_id"] += [me] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += exact[best].tolist()
        kinds = {"query": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": float}
        return pd.DataFrame({c: np.array(out[c], kind) for c, kind in kinds.items()})

    def listed(wanted: DataFrame, turns: int) -> DataFrame:
        """``wanted``: query, block and rows (null: all of the block's)."""
        by = ["block", "turn"]
        asks = wanted.join(queries.select("query", "query_id", F.col("v").alias("v")), "query").withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int"))
        there = vectors.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        return cut_lineage(there.groupBy(by).cogroup(asks.groupBy(by)).applyInPandas(scored, "query long, query_id long, vec_id long, score double"))

    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = F.transform(every_block, lambda b: F.struct(b.alias("block"), F.filter("rows", lambda r: F.pmod(r, F.lit(blocks)) == b).alias("rows")))
    wanted = met.select("query", F.inline(dealt)).where(F.size("rows") > 0)
    lists = listed(wanted, max(1, math.ceil(asking * min(1.0, 2 * budget_for(max(1, n)) / blocks) / SCORED)))
    short = cut_lineage(queries.select("query").join(lists.groupBy("query").count(), "query", "left").where(F.coalesce("count", F.lit(0)) < k).select("query"))
    if few := short.count():  # nodes that hold next to nothing: such a query is scored against all vectors
        whole = short.select("query", F.explode(every_block).alias("block"), F.lit(None).cast("array<long>").alias("rows"))
        lists = lists.join(short, "query", "left_anti").union(listed(whole, max(1, -(-few // SCORED))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
