"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words, by a literal rank map.

A text is the sequence of its words, the matches of the vocabulary's pattern. The frequent words of a bounded sample of the
documents are folded once each, and their ids become a dictionary of bounded size, a literal too. A text looks its words up there,
folds its other distinct words the same way, ``CHUNK`` words at a time, and joins the ids. What the sample holds changes the time and
never the ids. All of this is one projection: documents are encoded in one pass and never shuffled.

The rank map is bounded by the vocabulary: one row, an array of small maps, where the hash of a key says which map holds it,
since Spark searches a map from end to end. A word's parts are looked up only as far as a piece with their first bytes may
reach, by another literal array. The fold takes all pieces that stand in a word, by rank and then from left to right,
over the places where the word is still cut: a piece joins two parts if it begins and ends at cuts and has one cut
inside. Cuts are the bits of a number, or the bytes of a binary value in words of more than ``BITS`` bytes. That is what the library
does, which joins the pair of least rank again and again, wherever each piece of the vocabulary
comes about from parts of lesser ranks: merges then happen in the order of ranks, and a piece that didn't fit in its
turn never fits later. ``in_order`` proves it for every piece of the vocabulary; one that isn't in order can't be folded by
rank, and its words are merged by a heap in an Arrow function.

Decoding looks up each id's bytes in a literal array and joins them: the bytes of every text come back.

Null texts count as empty: no ids, no bytes. Repeated rows and ids stay as they
are, other columns too, whatever their names; an empty table gives an empty
result. A row is held whole in its task, with its words and ids; a merge in a word of more than ``BITS`` bytes copies a byte for each of its bytes.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut_lineage, free_name
from waymark.llm.token_counts import parts_by_bytes
from waymark.llm.tokens import _Kept

#: Documents of the sample, words of the dictionary at most, and the bytes of its longest ones: 2^18 words of 40 bytes are 10 MB.
SAMPLE, FREQUENT, SHORT = 40_000, 1 << 18, 40
#: Bytes of a word whose cuts are the bits of a long.
BITS = 60
#: Words of a text that are encoded together.
CHUNK = 1 << 12
#: Words of an Arrow batch that a heap merges together.
PART = 1 << 17
#: Slots of the rank map and of the dictionary, a power of two.
SLOTS = 1 << 19
#: First bytes of a piece, by which the longest such piece is looked up, and the slots of that.
HEAD, HEADS = 4, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the piece, a space and its rank on each line. Every byte must be a piece, and the ranks 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps or repeat")
    return ranks


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"piece": list(ranks), "rank": list(ranks.values())}), "piece binary, rank int")


def _rank_shelves(spark: SparkSession, ranks: dict[bytes, int]) -> _Shelves:
    return _Shelves(rank_table(spark, ranks).select(F.col("piece").alias("k"), F.col("rank").alias("v")), "shelf_of_ranks")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


class _Shelves:
    """A look-up over ``pairs`` (k, v), a bounded table with each k once.

    Subqueries may not be written inside a lambda, so ``beside`` puts the shelves below the projection with the lambdas, as a column
    with one use, which is merged into it: no row carries the shelves.
    """

    def __init__(self, pairs: DataFrame, name: str):
        full = pairs.groupBy(_slot(F.col("k")).alias("slot")).agg(F.collect_list(F.struct("k", "v")).alias("m"))
        every = pairs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(full, "slot", "left")
        self.one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda x: F.map_from_entries(x["m"])).alias("shelf"))
        self.name = name

    def used(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` of a function that gives the value of a key; null if it isn't there."""
        return _let(F.col(self.name), lambda shelf: body(lambda key: F.try_element_at(shelf[_slot(key)], key)))

    def beside(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn(self.name, self.one.scalar())


def _reach(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """A function of the next ``HEAD`` bytes of a word: the bytes of the longest piece that may begin there, ``HEAD`` - 1 at least.

    Pieces lie by the hash of their head; heads that share a slot share the longer reach, which costs look-ups and loses none.
    """
    longest = [HEAD - 1] * HEADS
    for piece in ranks:
        if len(piece) >= HEAD:
            at = xxhash.xxh64_intdigest(piece[:HEAD], 42) % HEADS  # as Spark's xxhash64 has it
            longest[at] = max(longest[at], len(piece))
    slots = F.split(F.lit(",".join(map(str, longest))), ",").cast("array<int>")
    return lambda head: slots[F.xxhash64(head).bitwiseAND(F.lit(HEADS - 1)).cast("int")]


def _parted(at: Column, word: Column, rank: Callable[[Column], Column]) -> Column:
    """The ids of the parts between the places ``at``."""
    return _let(at, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: rank(F.substring(word, a + 1, b - a))))


def _standing(word: Column, n: Column, rank: Callable[[Column], Column], reach: Callable[[Column], Column], merge: Callable[[Column, Column, Column], Column]) -> Column:
    """``merge`` (rank, begin, end) of all pieces of two bytes or more that stand in the word, in order."""

    def beginning(a: Column) -> Column:
        parts = F.transform(F.sequence(a + 2, F.least(n, a + reach(F.substring(word, a + 1, HEAD)))), lambda b: F.substring(word, a + 1, b - a))
        return F.transform(parts, lambda part, i: merge(rank(part), a, a + 2 + i))

    return F.sort_array(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), beginning))))


#: By 64 times a merge's begin plus its end: the bits of both, and the bits between them.
_ENDS = [1 << a | 1 << b if b <= BITS and a < b else 0 for a in range(64) for b in range(64)]
_INNER = [(1 << b) - (1 << a + 1) if b <= BITS and a < b else 0 for a in range(64) for b in range(64)]


def _folded(word: Column, rank: Callable[[Column], Column], reach: Callable[[Column], Column]) -> Column:
    """The ids of one word, a binary column of 2 to ``BITS`` bytes."""
    n, one = F.octet_length(word), F.lit(1).cast("long")
    ends, inner = (F.lit(",".join(map(str, x))) for x in (_ENDS, _INNER))
    ends, inner = (F.split(x, ",").cast("array<long>") for x in (ends, inner))
    bit = lambda i: F.call_function("shiftleft", one, i)
    found = _standing(word, n, rank, reach, lambda r, a, b: r.cast("long") * 4096 + (a * 64 + b))

    def apply(cuts: Column, merge: Column) -> Column:
        """The merge joins two parts if both its ends are cuts and one cut lies between them."""
        at = merge.bitwiseAND(F.lit(4095)).cast("int")
        joins = (F.bitwise_not(cuts).bitwiseAND(ends[at]) == 0) & (F.bit_count(cuts.bitwiseAND(inner[at])) == 1)
        return F.when(joins, cuts.bitwiseAND(F.bitwise_not(inner[at]))).otherwise(cuts)

    def pieces(cuts: Column) -> Column:
        return _parted(F.filter(F.sequence(F.lit(0), n), lambda i: cuts.bitwiseAND(bit(i)) != 0), word, rank)

    return F.aggregate(found, bit(n) + bit(n) - one, apply, pieces)


def _folded_long(word: Column, rank: Callable[[Column], Column], reach: Callable[[Column], Column]) -> Column:
    """The ids of one word of any length: cuts are bytes, 1 or 0 as texts."""
    n = F.octet_length(word)
    part = lambda cuts, a, b: F.substring(cuts, a + 1, b - a).cast("string")
    text = lambda x, k: F.call_function("repeat", F.lit(x), k)
    merge = lambda r, a, b: F.when(r.isNotNull(), F.struct(r.alias("r"), a.alias("a"), b.alias("b")))

    def apply(cuts: Column, m: Column) -> Column:
        a, b = m["a"], m["b"]
        joins = (part(cuts, a, a + 1) == "1") & (part(cuts, b, b + 1) == "1") & (F.octet_length(F.replace(part(cuts, a + 1, b), F.lit("0"), F.lit(""))) == 1)
        return F.when(joins, F.overlay(cuts, text("0", b - a - 1).cast("binary"), a + 2)).otherwise(cuts)

    def pieces(cuts: Column) -> Column:
        return _parted(F.filter(F.sequence(F.lit(0), n), lambda i: part(cuts, i, i + 1) == "1"), word, rank)

    return F.aggregate(_standing(word, n, rank, reach, lambda r, a, b: _let(r, lambda x: merge(x, a, b))), text("1", n + 1).cast("binary"), apply, pieces)


def _ids(word: Column, rank: Callable[[Column], Column], reach: Callable[[Column], Column]) -> Column:
    """The ids of one word. A word that is a piece itself is not merged; every byte is one."""

    def merged(w: Column) -> Column:
        folded = F.when(F.octet_length(w) <= BITS, _folded(w, rank, reach)).otherwise(_folded_long(w, rank, reach))
        return _let(rank(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded))

    return _let(word.cast("binary"), merged)


def heap_merged(word: bytes, ranks: dict[bytes, int], last: list | None = None) -> list[int]:
    """The ids of one word by a heap of pairs over linked parts. ``last``: gets both parts of the last merge."""
    n = len(word)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue  # one of its parts has grown since
        if last is not None:
            last[:] = word[i:j], word[j:end]
        gone[j], after[i] = True, end
        if end < n:
            before[end] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(word[a : after[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, after[after[a]]))
    return [ranks[word[i : after[i]]] for i in range(n) if not gone[i]]


def in_order(ranks: dict[bytes, int]) -> bool:
    """Whether merging a piece's bytes gives the piece from two parts of lesser ranks, for each that merging gives at all."""
    for piece, rank in ranks.items():
        last: list = []
        if len(piece) > 1 and heap_merged(piece, ranks, last) == [rank] and any(len(x) > 1 and ranks[x] > rank for x in last):
            return False
    return True


def _words(text: Column, pattern: str) -> Column:
    """The pattern's matches; with (?U) its white space is Unicode's, as the library has it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def dictionary(frame: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, sample: int, frequent: int) -> DataFrame:
    """k and v: the frequent words of a sample of ``frame``, and their ids, by the fold."""
    spark = frame.sparkSession
    share = min(1.0, sample / max(1, frame.count()))
    counted = frame.select(F.col(f"`{text}`").alias("k")).sample(share, 0).select(F.explode(_words(F.col("k"), pattern)).alias("k")).groupBy("k").count()
    top = counted.where(F.octet_length("k") <= SHORT).orderBy(F.desc("count"), "k").limit(frequent)
    top = top.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    ranked, reach = _rank_shelves(spark, ranks), _reach(ranks)
    return ranked.beside(top).select("k", ranked.used(lambda rank: _ids(F.col("k"), rank, reach)).alias("v"))


_kept: dict[str, _Kept] = {}


def _worker(name: str, ranks: dict[bytes, int]) -> _Kept:
    """The worker's heap, with the words it has met. Ids are little-endian numbers of 32 bits."""
    if name not in _kept:

        def merge(word: str) -> bytes:
            w = word.encode()
            return array("I", [ranks[w]] if w in ranks else heap_merged(w, ranks)).tobytes()

        _kept[name] = _Kept(lambda batch: [merge(w) for w in batch])
    return _kept[name]


def _gathered(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The lists of ids of texts: the values of their words' codes, one behind the other."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts, n = np.cumsum(lengths) - lengths, lengths[codes]
    where = np.concatenate([[0], np.cumsum(n)])
    pool = np.frombuffer(b"".join(values), "<i4")
    ids = pool[np.repeat(starts[codes] - where[:-1], n) + np.arange(where[-1])]
    return pa.ListArray.from_arrays(pa.array(where[bounds].astype(np.int32)), pa.array(ids))


def _encoded_words(words: Column, known: Callable[[Column], Column], rank: Callable[[Column], Column], reach: Callable[[Column], Column]) -> Column:
    """The ids of a list of words: those that are ``known`` are looked up, the other distinct ones folded."""

    def joined(part: Column, found: Column) -> Column:
        rest = F.array_distinct(F.filter(part, lambda w, i: found[i].isNull()))
        entries = F.transform(rest, lambda w: F.struct(w.alias("k"), _ids(w, rank, reach).alias("v")))
        return _let(F.map_from_entries(entries), lambda own: F.flatten(F.zip_with(part, found, lambda w, x: F.coalesce(x, F.try_element_at(own, w)))))

    def chunk(part: Column) -> Column:
        return _let(F.transform(part, known), lambda found: joined(part, found))

    def chunks(every: Column) -> Column:
        last = F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))

    return F.flatten(F.transform(_let(words, chunks), chunk))


def encoded(frame: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """``frame`` with the token ids of ``text`` in ``out``, an array of int."""
    words = _words(F.coalesce(F.col(f"`{text}`"), F.lit("")), pattern)
    if not in_order(ranks):
        return frame.withColumn(out, _heaped(ranks)(words))
    ranked, reach = _rank_shelves(frame.sparkSession, ranks), _reach(ranks)
    ranked.name = free_name(ranked.name, frame.columns)
    held = _Shelves(cut_lineage(dictionary(frame, ranks, pattern, text, sample, frequent)), free_name("shelf_of_words", frame.columns))
    ids = ranked.used(lambda rank: held.used(lambda known: _encoded_words(words, known, rank, reach)))
    return held.beside(ranked.beside(frame)).withColumn(out, ids).drop(ranked.name, held.name)


def _heaped(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """The ids of lists of words, by a heap."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def looked_up(lists: pa.Array) -> pa.Array:
        kept, done = _worker(name, ranks), []
        for a, b in parts_by_bytes(np.diff(lists.offsets.to_numpy()).tolist(), PART):
            part = lists.slice(a, b - a)
            coded, bounds = part.flatten().dictionary_encode(), part.offsets.to_numpy()
            done.append(_gathered(kept.values(coded.dictionary.to_pylist()), coded.indices.to_numpy(), bounds - bounds[0]))
        whole = pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))
        del done
        pa.default_memory_pool().release_unused()
        return whole

    return looked_up


def decoded(frame: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the bytes of ``ids`` joined in ``out``; null where the ids are null. An id that is not in the vocabulary is an error."""
    pieces = F.split(F.lit(",".join(p.hex() for p in sorted(ranks, key=ranks.get))), ",")
    return frame.withColumn(out, F.unhex(F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(pieces, i + 1)), "")))
