"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The piece lattice of a text has a node between any two characters and an edge
for each piece of the vocabulary; a character without a piece of its own has one
edge, its bytes. A segmentation's probability is the product of its pieces'
weights to the power ``alpha``, over the sum of all segmentations'. Forward filtering sums up the
weights of all ways to each node; backward sampling walks from the end, and at
each node draws the edge it came by. No piece crosses the place before a run of
spaces or a line feed (checked when the model is loaded), so the lattice falls apart into
chunks there. The unlike chunks of a part are filtered together, a column of the
lattices at a time; the few long ones each by themselves, by the same sums.

A piece's weight: exp(score) of a unigram model. A BPE model's scores are only
ranks; there it is 1 / (rank + 10), as frequencies fall with the rank.

Draws are counter based: a hash of (seed, row key, chunk's number, step). A row's
segmentation depends on its key and text alone, not on partitions, batches or other rows.
Sums are taken chunk by chunk in plain doubles and drawn against 32-bit
thresholds, so they are the same on every machine.

Lossless: the word mark stands for a space, one is put before the text; a literal
mark in a text is encoded as bytes. Decoding gives back the very text.

Null and empty texts have no pieces and decode to the empty text. Rows with one
key and text have one segmentation; a null key is a key. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.token_counts import parts_by_bytes

#: Bytes of text sampled at a time; characters of unlike chunks filtered at a time, and of the longest chunk among them.
PART, DENSE, SHORT = 6 << 20, 120_000, 64
_MARK, _CUT = "▁", "\x00"
_CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")
_STEP = 2.0**12  # weight a character, so that long products stay within doubles


class Lattices:
    """The model's pieces, and the filtered lattices of chunks."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import sentencepiece_model_pb2 as model

        said = model.ModelProto()
        with open(path, "rb") as file:
            said.ParseFromString(file.read())
        spec = said.normalizer_spec
        normal = {p.piece.replace(_MARK, " "): (i, p.score) for i, p in enumerate(said.pieces) if p.type == 1}
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or any("\n" in p or " " in p.lstrip(" ") for p in normal):
            raise ValueError("a model without normalization, with a dummy prefix, and with marks in front only is asked for")
        weight = (lambda s: np.exp(alpha * s)) if said.trainer_spec.model_type == 1 else (lambda s: (10.0 - max(s, -1e6)) ** -alpha)
        self.pieces = {p: (i, float(weight(s)) * _STEP ** len(p)) for p, (i, s) in normal.items()}
        self.longest = max(map(len, self.pieces))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(said.pieces) if p.type == 6}
        # What an edge puts out: a piece's id, or behind those a character's byte ids.
        self.out: list[tuple[int, ...]] = [(i,) for i in range(len(said.pieces))]
        self.of_char: dict[str, int] = {}
        self.raw = [b""] * len(said.pieces)
        for p, (i, _) in normal.items():
            self.raw[i] = p.encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self._grow_trie(normal)

    def _bytes_of(self, char: str) -> int:
        if char not in self.of_char:
            self.of_char[char] = len(self.out)
            self.out.append(tuple(self.bytes[b] for b in char.encode()))
        return self.of_char[char]

    def filtered(self, chunk: str) -> tuple[int, bytes, bytes, bytes, bytes]:
        """Length, and for each edge its end, its threshold there, its start and what it puts out."""
        n, longest, pieces = len(chunk), self.longest, self.pieces
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                if found := pieces.get(chunk[start:end]):
                    into[end].append((start, *found))
        ways = [1.0] + [0.0] * n
        ends, limits, starts, out = array("I"), array("I"), array("I"), array("I")
        for end in range(1, n + 1):
            edges = into[end]
            if chunk[end - 1] not in pieces:
                edges.append((end - 1, self._bytes_of(chunk[end - 1]), _STEP * 1e-9))
            shares = [ways[s] * w for s, _, w in edges]
            total, run = sum(shares), 0.0
            for (start, put, _), share in zip(edges, shares, strict=True):
                run += share
                ends.append(end)
                limits.append(min(int(run / total * 4294967296.0), 4294967295))
                starts.append(start)
                out.append(put)
            limits[-1] = 4294967295
            ways[end] = total
            if not 1e-100 < total < 1e100:  # only ratios count: move the ways that are still in reach
                shift = 2.0 ** -int(np.frexp(total)[1])
                for k in range(max(0, end - longest), end + 1):
                    ways[k] *= shift
        return n, ends.tobytes(), limits.tobytes(), starts.tobytes(), out.tobytes()

    def _grow_trie(self, normal: dict[str, tuple[int, float]]) -> None:
        """States of the pieces' prefixes. The 127 most frequent characters have a dense table, the others sorted keys."""
        states, steps = {"": 0}, []
        for piece in normal:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    steps.append((states[piece[: k - 1]], piece[k - 1], states[piece[:k]]))
        often = [c for c, _ in Counter(c for _, c, _ in steps).most_common(127)]
        self.class_of = np.zeros(0x110000, np.uint8)
        self.class_of[[ord(c) for c in often]] = np.arange(1, len(often) + 1)
        self.next = np.full((len(states), 128), -1, np.int32)
        rare = sorted((a << 21 | ord(c), b) for a, c, b in steps if not self.class_of[ord(c)])
        for a, c, b in steps:
            if self.class_of[ord(c)]:
                self.next[a, self.class_of[ord(c)]] = b
        self.rare = np.array([k for k, _ in rare] + [1 << 62], np.int64), np.array([b for _, b in rare] + [-1], np.int32)
        self.piece_at, self.weight_at = np.full(len(states), -1, np.int64), np.zeros(len(states))
        for piece, state in states.items():
            if piece in self.pieces:
                self.piece_at[state], self.weight_at[state] = self.pieces[piece]

    def _edges(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """filtered() of many chunks at once: number of each one's edges, and all ends, thresholds, starts and outputs."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        n, longest = len(points), self.longest
        first = np.cumsum(lengths) - lengths
        local = np.arange(n) - np.repeat(first, lengths)
        left = np.repeat(lengths, lengths) - local
        put, weight = np.full((n, longest), -1, np.int64), np.zeros((n, longest))  # by end, longest pieces first
        at, state = np.arange(n), np.zeros(n, np.int64)
        for depth in range(1, longest + 1):
            inside = left[at] >= depth
            at, state = at[inside], state[inside]
            point = points[at + depth - 1]
            kind = self.class_of[point]
            after = self.next[state, kind]
            if len(odd := np.flatnonzero(kind == 0)):
                key = state[odd] << 21 | point[odd]
                place = np.searchsorted(self.rare[0], key)
                after[odd] = np.where(self.rare[0][place] == key, self.rare[1][place], -1)
            at, state = at[after >= 0], after[after >= 0].astype(np.int64)
            piece = self.piece_at[state]
            hit = piece >= 0
            put[at[hit] + depth - 1, longest - depth] = piece[hit]
            weight[at[hit] + depth - 1, longest - depth] = self.weight_at[state[hit]]
            if not len(at):
                break
        if len(odd := np.flatnonzero(put[:, -1] < 0)):
            put[odd, -1] = [self._bytes_of(chr(c)) for c in points[odd].tolist()]
            weight[odd, -1] = _STEP * 1e-9
        ways, sums, back = np.zeros(n), np.empty((n, longest)), np.arange(longest, 0, -1)
        for k in range(int(lengths.max(initial=0))):  # forward
            here = first[lengths > k] + k
            before = ways[np.maximum(here[:, None] - back, 0)]
            before[:, back == k + 1] = 1.0
            sums[here] = np.cumsum(before * weight[here], axis=1)
            ways[here] = sums[here, -1]
        end, column = np.nonzero(put >= 0)
        limits = np.minimum(sums[end, column] / ways[end] * 4294967296.0, 4294967295.0).astype(np.uint32)
        stop = local[end] + 1
        count = np.bincount(np.repeat(np.arange(len(chunks)), lengths)[end], minlength=len(chunks))
        return count, stop.astype(np.uint32), limits, (stop - back[column]).astype(np.uint32), put[end, column].astype(np.uint32)

    def of(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """The chunks' numbers of edges; all ends, thresholds, starts and outputs, chunk after chunk."""
        parts, batch, size = [], [], 0

        def flush():
            nonlocal batch, size
            if batch:
                parts.append(self._edges(batch))
            batch, size = [], 0

        for chunk in chunks:
            if len(chunk) > SHORT:
                flush()
                _, *edges = self.filtered(chunk)
                edges = [np.frombuffer(x, np.uint32) for x in edges]
                parts.append((np.array([len(edges[0])]), *edges))
                continue
            batch.append(chunk)
            size += len(chunk)
            if size >= DENSE:
                flush()
        flush()
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), *[np.zeros(0, np.uint32)] * 4)

    def sample(self, keys: list, lists: pa.ListArray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and where each row's begin and end. ``lists``: the rows' chunks."""
        coded = lists.values.dictionary_encode()
        codes, bounds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        edges, ends, limits, starts, out = self.of(chunks)
        first = np.cumsum(lengths + 1) - (lengths + 1)  # a chunk's first node among all nodes
        shift = np.repeat(first, edges)
        limit = ((ends + shift).astype(np.uint64) << np.uint64(32)) | limits
        came = starts + shift
        rows = np.repeat(np.arange(len(keys)), np.diff(bounds))
        base = np.array([xxhash.xxh64_intdigest(f"{k}", seed) for k in keys], np.uint64)[rows]
        base = _mixed(base + (np.arange(len(codes)) - bounds[rows]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        node, start = first[codes] + lengths[codes], first[codes]
        live, step, drawn = np.flatnonzero(node > start), 0, []
        while len(live):
            draw = _mixed(base[live] + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)
            edge = np.searchsorted(limit, (node[live].astype(np.uint64) << np.uint64(32)) | draw)
            drawn.append((live, out[edge]))
            node[live] = came[edge]
            live = live[node[live] > start[live]]
            step += 1
        steps = np.zeros(len(codes), np.int64)
        for at, _ in drawn:
            steps[at] += 1
        behind = np.cumsum(steps)
        put = np.zeros(int(behind[-1]) if len(behind) else 0, np.int64)
        for k, (at, what) in enumerate(drawn):
            put[behind[at] - 1 - k] = what
        widths = np.array([len(x) for x in self.out], np.int64)
        flat = np.array([i for x in self.out for i in x], np.uint32)
        n, begin = widths[put], (np.cumsum(widths) - widths)[put]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], behind])[bounds]]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks_of(texts: pa.StringArray) -> pa.ListArray:
    """Each text behind its dummy prefix, cut before each run of spaces and each line feed. (Empty chunks have no pieces.)"""
    if pc.any(pc.match_substring(texts, _CUT)).as_py():
        return pa.array([["", *_CHUNK.findall(" " + t)] if t else [""] for t in texts.to_pylist()], pa.list_(pa.string()))
    framed = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    return pc.split_pattern(pc.replace_substring_regex(framed, "( +|\n)", _CUT + "\\1"), _CUT)


_loaded: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(path, alpha)
    return _loaded[path, alpha]


def sample_pieces(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = 1.0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key``, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), lossless (decoding gave the text back) and, if asked for, ids."""

    def mapped(batches):
        model = lattices(model_path, alpha)
        for batch in batches:
            keys, texts, sizes = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            rows = []
            for a, b in parts_by_bytes(sizes, PART):
                part = texts.slice(a, b - a)
                ids, bounds = model.sample(keys[a:b], chunks_of(part), seed)
                for i, whole in enumerate(part.to_pylist()):
                    own = ids[bounds[i] : bounds[i + 1]]
                    rows.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), model.decode(own) == whole, own if with_ids else None))
            n, crc, same, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_pieces", "ids_crc32", "lossless", "ids"][: len(arrays)])

    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("key"), whole.alias("text"), F.octet_length(whole).alias("size"))
    kind = read.schema["key"].dataType.simpleString()
    made = read.mapInArrow(mapped, f"key {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)
    return made.withColumnRenamed("key", key)


def decode_pieces(frame: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``frame`` with the text of its ``ids``; null ids give null."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        model = lattices(model_path, 1.0)
        return pa.array([None if x is None else model.decode(np.array(x, np.int64)) for x in column.to_pylist()], pa.string())

    return frame.withColumn(out, text(F.col(ids)))
