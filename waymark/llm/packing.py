"""Best-fit packing with a swap-based local search.

A document is its token ids and an end id behind them; only longer ones are cut,
into pieces of the sequence length. Pieces go to sequences ("bins") in two steps:

1. Each task tokenizes its documents and packs ``GROUP`` pieces at a time, in
   the same map, so no text and no id is shuffled: best fit decreasing, then the
   local search. Its result, a few dozen bytes a piece, is written once.
2. The underfull bins that are left are the only ones worth more work. They are dealt to
   groups of about ``GROUP`` pieces, in other company each round, taken apart there and packed
   again, until one group holds them all or a round gains no more than a bin a group: that is
   what the last, unfilled bin of each group costs. No task ever holds more than a group.
   Full bins never move.

Local search, among all underfull bins of a group: move one document, exchange one for one, two for one or
one for two between two bins, whenever that raises the sum of squared fills. Offers of one piece and of two are
indexed by their length, with the emptiest bin of each length, so a bin finds the step that fits it best without meeting the others.
Fuller bins grow, emptier ones shrink, until some are empty. The sum grows with each step, so the search ends: when no bin finds a step.

Null and empty texts are the end id alone. Repeated rows are packed as often as
they stand there; ids keep their type, null ids stay null. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.llm.common import cut_lineage
from waymark.llm.token_counts import parts_by_bytes
from waymark.llm.tokens import tokenizer

#: Pieces packed at a time in a task.
GROUP = 1 << 16


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into ``lengths``: longest first, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = size, len(bins)
            bins.append([])
        bins[k].append(i)
        by_room[room - n].append(k)
        if room > n:
            rooms |= 1 << (room - n)
    return bins


class _Offers:
    """Which bins can give one piece, or two, of a length together: a heap of bins by fill for each length, and the lengths that are there as bits."""

    def __init__(self, size: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        self.there = 0

    def enter(self, totals, fill: int, k: int, version: int) -> None:
        for n in totals:
            heapq.heappush(self.heaps[n], (fill, k, version))
            self.there |= 1 << n

    def emptiest(self, n: int, but: int, version: list[int]) -> tuple[int, int] | None:
        """Fill and number of the emptiest bin that offers ``n``, other than ``but``."""
        heap, aside = self.heaps[n], None
        while heap and (version[heap[0][1]] != heap[0][2] or heap[0][1] == but):
            top = heapq.heappop(heap)
            if version[top[1]] == top[2]:
                aside = top
        found = heap[0][:2] if heap else None
        if aside:
            heapq.heappush(heap, aside)
        if not heap:
            self.there &= ~(1 << n)
        return found

    def longest_first(self, above: int, most: int):
        """Lengths that are there, from ``most`` down to ``above`` + 1."""
        bits = (self.there >> (above + 1)) & ((1 << max(0, most - above)) - 1)
        while bits:
            top = bits.bit_length()
            yield above + top
            bits ^= 1 << (top - 1)


def _pairs(own: dict[int, list[int]], size: int) -> dict[int, tuple[int, int]]:
    """Two pieces for each sum of two lengths of a bin."""
    lengths, out = sorted(own), {}
    for x, a in enumerate(lengths):
        if len(own[a]) > 1 and 2 * a <= size:
            out[2 * a] = (own[a][0], own[a][1])
        for b in lengths[x + 1 :]:
            if a + b > size:
                break
            out[a + b] = (own[a][0], own[b][0])
    return out


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """The bins after steps between underfull ones, any with any; empty ones are gone.

    The emptiest bin asks first: where it finds nothing it stays a giver for the others. Of all steps that fit it, it takes one that fills it most: a piece moved in, one or
    two pieces of another bin for one of its own, or one for two. A bin that gave may ask again. Each step raises the sum
    of squared fills, and the search ends when no bin finds one.
    """
    fill, version = [sum(lengths[i] for i in b) for b in bins], [0] * len(bins)
    ones: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]
    twos: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]
    single, double = _Offers(size), _Offers(size)

    def enter(k: int) -> None:
        version[k] += 1
        own = defaultdict(list)
        for i in bins[k]:
            own[lengths[i]].append(i)
        ones[k], twos[k] = {n: (x[0],) for n, x in own.items()}, _pairs(own, size)
        if 0 < fill[k] < size:
            single.enter(ones[k], fill[k], k, version[k])
            double.enter(twos[k], fill[k], k, version[k])

    def best_step(k: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """Gain, the other bin, what it gives and what it gets."""
        room, best, gain = size - fill[k], None, 0
        nothing: dict[int, tuple[int, ...]] = {0: ()}
        for given, offers, offered in ((nothing | ones[k], single, ones), (nothing | ones[k], double, twos), (twos[k], single, ones)):
            for m, gone in given.items():
                for n in offers.longest_first(m + gain, m + room):
                    there = offers.emptiest(n, k, version)
                    if there and there[0] < fill[k] + n - m:  # the squares grow
                        gain = n - m
                        best = gain, there[1], offered[there[1]][n], gone
                        break
                if gain == room:
                    return best
        return best

    for k in range(len(bins)):
        enter(k)
    asking = [(f, k) for k, f in enumerate(fill) if 0 < f < size]
    heapq.heapify(asking)
    while asking:
        f, k = heapq.heappop(asking)
        while fill[k] == f and 0 < fill[k] < size and (step := best_step(k)):
            gain, other, come, gone = step
            bins[k] = [i for i in bins[k] if i not in gone] + list(come)
            bins[other] = [i for i in bins[other] if i not in come] + list(gone)
            fill[k], fill[other], f = fill[k] + gain, fill[other] - gain, f + gain
            enter(k)
            enter(other)
            heapq.heappush(asking, (fill[other], other))
    return [b for b in bins if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


def placed(lengths: np.ndarray, size: int, ids: list[int] | range) -> dict[str, np.ndarray] | None:
    """sequence_id (the first of ``ids``), offset and fill for each piece; None where ``ids`` are too few."""
    out = {k: np.zeros(len(lengths), np.int64) for k in ("sequence_id", "offset", "fill")}
    plain = lengths.tolist()
    bins = pack(plain, size)
    if len(bins) > len(ids):
        return None
    for own, name in zip(bins, ids, strict=False):
        at = 0
        for i in own:
            out["sequence_id"][i], out["offset"][i] = name, at
            at += plain[i]
        out["fill"][own] = at
    return out


_PIECES = "piece int, start long, length long, ids_crc32 long"
_PLACES = "sequence_id long, offset long, fill long"


def pieces(batches, model_path: str, size: int, end_id: int):
    """Lists (id, piece, start, length, crc32), one for each piece, by batch."""
    end = np.array([end_id], "<u4").tobytes()
    words = tokenizer(model_path)
    for batch in batches:
        keys, sizes, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        for a, b in parts_by_bytes(sizes, 4 << 20):
            ids, bounds = words.ids(batch.column(1).slice(a, b - a))
            for i, key in enumerate(keys[a:b]):
                own = ids[bounds[i] : bounds[i + 1]].tobytes() + end
                for k, at in enumerate(range(0, len(own), 4 * size)):
                    part = own[at : at + 4 * size]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
        pa.default_memory_pool().release_unused()
        yield out


def pack_documents(docs: DataFrame, model_path: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset."""

    def first_packed(batches):
        unit, have = (TaskContext.get().partitionId() << 36), []
        ready = pieces(batches, model_path, size, end_id)
        while True:
            more = next(ready, None)
            have += more or []
            while len(have) >= GROUP or (more is None and have):
                now, have = have[:GROUP], have[GROUP:]
                columns = list(zip(*now, strict=True))
                put = placed(np.array(columns[3], np.int64), size, range(unit, unit + len(now)))
                unit += len(now)
                kinds = (to_arrow_type(id_type), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(put[k]) for k in ("sequence_id", "offset", "fill")]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])
            if more is None:
                return

    def again(group: pd.DataFrame) -> pd.DataFrame:
        put = placed(group["length"].to_numpy(), size, np.unique(group["sequence_id"].to_numpy()).tolist())
        return group.assign(**put) if put else group

    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.octet_length(whole).alias("size"))
    id_type = read.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, {_PIECES}, {_PLACES}"
    now = cut_lineage(read.mapInArrow(first_packed, schema))
    loose = F.col("fill") < size
    done, turn, before = [], 0, None
    while True:
        done.append(now.where(~loose))
        rest = now.where(loose)
        bins = now.select("sequence_id").distinct().count() if before is not None else 0
        n, open_ = rest.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        groups = max(1, -(-n // GROUP))
        if open_ <= 1 or before is not None and (before[1] == 1 or before[0] - bins <= before[1]):
            done.append(rest)
            break
        dealt = rest.withColumn("unit", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
        now = cut_lineage(dealt.groupBy("unit").applyInPandas(again, f"{schema}, unit long").drop("unit"))
        turn, before = turn + 1, (open_, groups)
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.drop("fill").withColumnRenamed("doc_id", key)
