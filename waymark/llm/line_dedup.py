"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without white space at both ends and with A-Z in lower
case. Keys of ``min_chars`` code points or more that at least ``min_docs``
documents hold lose all their lines; the others stay, joined by line feeds.

1. Each task hashes its documents' lines (two 64-bit hashes with unlike seeds),
   counts each key once a document and adds up its own batch first; a sum over
   hash pairs follows. Only hashes and counts move, and a line that a third of
   the documents hold arrives as one row from each batch.
2. Keys that reach ``min_docs`` are dealt into shards of about ``SHARD_KEYS`` and
   each shard becomes a minimal perfect hash with fingerprint and count arrays.
   Keys below ``min_docs`` can't drop a line and need no slot: the fingerprint
   rejects them.
3. Documents probe the arrays in a map: no line is joined or shuffled. Shards of
   at most ``broadcast_bytes`` together are broadcast. If there are more, the
   documents pass over one group of shards after the other and carry a bit for
   each line found so far, so an executor never holds more than that size.

Null and empty texts are one empty line. An empty key never drops. Each row is a
document, whatever its id; repeated rows count as often as they stand there. An
empty table gives an empty result. Other columns stay as they are; where one is
named n_lines or n_dropped, the new column gets underscores behind its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import cut_lineage, free_name
from waymark.llm.mph import PerfectHash

SHARD_KEYS = 1 << 16
SEEDS = (42, 0x5EED)
_BLANKS = b" \t\n\x0b\x0c\r"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _key(line: bytes) -> bytes:
    return line.strip(_BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(keys: list[bytes]) -> list[np.ndarray]:
    return [np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys)) for seed in SEEDS]


def frequent_keys(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2 and n of the keys in ``min_docs`` rows or more. ``texts`` has one column."""

    def counted(batches):
        for batch in batches:
            keys = [k for text in batch.column(0).to_pylist() for k in {_key(x) for x in _lines(text)} if _long_enough(k, min_chars)]
            seen = pd.DataFrame(dict(zip(("h1", "h2"), _hashes(keys), strict=True))).value_counts().reset_index()
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen[c].to_numpy(np.uint64).view(np.int64)) for c in ("h1", "h2")] + [pa.array(seen["count"], pa.int64())], names=["h1", "h2", "n"]
            )

    rows = texts.mapInArrow(counted, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def build_index(keys: DataFrame) -> DataFrame:
    """A row for each shard: shard, bytes, index (the dumped perfect hash)."""
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def built(group: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        # Two keys with one h1 are one slot's worth too many: the perfect hash takes the pair mixed.
        blob = PerfectHash.build(h1 ^ (h2 >> np.uint64(1)), h2, group["n"].to_numpy(np.uint64)).dump()
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "bytes": [len(blob)], "index": [blob]})

    dealt = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(built, "shard int, bytes long, index binary")


class Index:
    """Some shards of the index, loaded."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.shards = shards
        self.of = {k: PerfectHash.load(blob) for k, blob in blobs.items()}

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        mixed, shard = h1 ^ (h2 >> np.uint64(1)), h1.view(np.int64) % self.shards
        if len(self.of) == 1 == self.shards:
            return self.of[0].count(mixed, h2)
        for k, one in self.of.items():
            if len(at := np.flatnonzero(shard == k)):
                out[at] = one.count(mixed[at], h2[at])
        return out


_index: tuple[int, Index] | None = None


def _loaded(shared) -> Index:
    """The broadcast's index, loaded once by each worker; the one before is let go."""
    global _index
    if _index is None or _index[0] != shared.value[2]:
        _index = (shared.value[2], Index(*shared.value[:2]))
    return _index[1]


def _grouped(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    groups, room = [[]], most
    for shard, size in sizes:
        if groups[-1] and size > room:
            groups.append([])
            room = most
        groups[-1].append(shard)
        room -= size
    return groups


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and n_lines (before) and n_dropped."""
    spark, names = docs.sparkSession, docs.columns
    keys = cut_lineage(frequent_keys(docs.select(text), min_docs, min_chars))
    index = cut_lineage(build_index(keys))
    sizes = sorted((r.shard, r.bytes) for r in index.select("shard", "bytes").collect())
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    groups = _grouped(sizes, broadcast_bytes)

    at = names.index(text)
    first = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    kept = T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType) for i, f in enumerate(first.schema)])
    found = T.StructType([*kept, T.StructField("found", T.BinaryType())])
    done = T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def one_pass(frame: DataFrame, group: list[int], last: bool) -> DataFrame:
        blobs = {r.shard: bytes(r["index"]) for r in index.where(F.col("shard").isin(group)).collect()} if group else {}
        shared = spark.sparkContext.broadcast((blobs, shards, hash(tuple(map(tuple, sorted((k, len(v), v[-64:]) for k, v in blobs.items()))))))

        def probed(batches):
            have = _loaded(shared)
            for batch in batches:
                texts = [_lines(x) for x in batch.column(at).to_pylist()]
                lines = [x for own in texts for x in own]
                named = [_key(x) for x in lines]
                drop = (have.counts(*_hashes(named)) >= min_docs) & np.fromiter((_long_enough(k, min_chars) for k in named), bool, len(named))
                ends = np.cumsum([len(x) for x in texts])
                if batch.num_columns > len(names):
                    drop |= np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(own)) for x, own in zip(batch.column(len(names)).to_pylist(), texts, strict=True)]).astype(bool)
                columns = batch.columns[: len(names)]
                parts = np.split(drop, ends[:-1])
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())], names=found.names)
                    continue
                columns[at] = pa.array([b"\n".join([x for x, d in zip(own, part.tolist(), strict=True) if not d]) for own, part in zip(texts, parts, strict=True)], pa.string())
                lost = pa.array([int(part.sum()) for part in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in texts], pa.int64()), lost], names=done.names)

        return frame.mapInArrow(probed, done if last else found)

    frame = first
    for group in groups[:-1]:
        frame = cut_lineage(one_pass(frame, group, last=False))
    frame = one_pass(frame, groups[-1], last=True)
    taken = [*names]
    for name in ("n_lines", "n_dropped"):
        taken.append(free_name(name, taken))
    return frame.toDF(*taken)
