"""SimHash near-dedup with BK-trees.

1. Fingerprints, in one map: words of the lower-cased (A-Z) text, shingles of
   ``words`` words with repeats, XXH64 with seed 42 of each; bit b is 1 if it is
   set in more than half of the hashes. Texts of fewer words are one shingle;
   no words: fingerprint zero.
2. Shards: unlike fingerprints only. Two of them that differ in at most
   ``radius`` bits agree in at least two of ``radius`` + 2 bit blocks, so each
   goes to one shard for each pair of blocks, keyed by the pair's bits. Shards of
   one member are dropped, counts first, before anything is dealt out.
   A shard of more than ``TREE`` members is dealt again, by pairs of blocks of the bits that
   its members may still differ in, up to ``LEVELS`` times; then so few bits are left free
   (14 at radius 3) that no shard can be large. No pair of a full shard is walked before.
3. BK-trees: a tree's children are keyed by their Hamming distance to the parent,
   and a query follows only the edges within the radius of its own distance.
   What a tree finds leaves it as links to one member of each group found in
   that tree, never as all pairs of a group.
4. Components of the links by alternating large and small stars, in written
   rounds; only linked fingerprints take part, and nothing is gathered in the
   driver but two sums a round. Each component has its least id.

A null text is empty. Null ids carry a fingerprint and join their component, but
are never the least id, unless there is no other (then the component is null).
Repeated rows and ids stay. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import ascii_lower, cut_lineage

#: Members of a shard's BK-tree, and how often fuller shards are dealt; members of a leaf where many queries walk together; trees up to so many members are walked one by one.
TREE, LEVELS, LEAF, FEW = 1024, 3, 64, 24
#: Bands of so many least hashes each, by which texts meet to be compared: at a similarity of 0.8 one pair in 8 million has no band in common.
BANDS, ROWS = 40, 5
#: Candidates' keys that are broadcast at most; more are joined.
BROADCAST = 1 << 20
#: Near copies have this similarity or more, as a fraction of whole numbers.
SHARE = (4, 5)


def shingles(text: str | None, words: int) -> list[bytes]:
    """The shingles, as slices of the words joined by single spaces."""
    own = (text or "").encode().lower().split()
    if len(own) <= words:
        return [b" ".join(own)] if own else []
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]).tolist()
    starts = [0, *ends]
    return [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :], strict=False)]


def _rehashed(hashes: np.ndarray, prints: int) -> np.ndarray:
    """A column of hashes for each fingerprint: the given ones, and mixes of them."""
    out = np.empty((len(hashes), prints), "<u8")
    out[:, 0] = hashes
    for k in range(1, prints):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprints(texts: list[str | None], words: int, prints: int = 1) -> np.ndarray:
    """The fingerprints of each text, unsigned: a column for each."""
    out = np.zeros((len(texts), prints), np.uint64)
    for i, text in enumerate(texts):
        if own := shingles(text, words):
            out[i] = _prints(_hashed(own), prints)
    return out


def _hashed(own: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in own), "<u8", len(own))


def _prints(hashes: np.ndarray, prints: int) -> np.ndarray:
    """The fingerprints of one text's shingles."""
    ones = np.zeros(64 * prints, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded, however long the text
        raw = _rehashed(hashes[at : at + (1 << 14)], prints).view(np.uint8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


_MIX = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_MIX[0] |= np.uint64(1)


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` least mixed hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[None, at : at + (1 << 11)] * _MIX[0][:, None] + _MIX[1][:, None]).min(axis=1))
    return np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def with_fingerprints(frame: DataFrame, words: int, text: str) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of ``frame``'s columns id and ``text``."""

    def mapped(batches):
        for batch in batches:
            found = fingerprints(batch.column(1).to_pylist(), words)[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return frame.select("id", text).mapInArrow(mapped, f"id {frame.schema['id'].dataType.simpleString()}, fp long")


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while distance := (value ^ node[0]).bit_count():
            if distance not in node[1]:
                node[1][distance] = [value, {}]
                return
            node = node[1][distance]

    def near(self, value: int, radius: int) -> list[int]:
        """The members within the radius."""
        out, open_ = [], [self.root] if self.root else []
        while open_:
            member, children = open_.pop()
            distance = (value ^ member).bit_count()
            if distance <= radius:
                out.append(member)
            if children:
                open_ += [child for edge, child in children.items() if distance - radius <= edge <= distance + radius]
        return out


class BKBranches:
    """The same tree over an array, walked by many queries together: leaves hold up to ``LEAF`` members."""

    def __init__(self, values: np.ndarray):
        self.pivot, self.leaf, self.children = None, values, []
        if len(values) > LEAF:
            self.pivot, rest = values[0], values[1:]
            distance = np.bitwise_count(rest ^ self.pivot)
            self.leaf = rest[distance == 0]
            self.children = [(int(d), BKBranches(rest[distance == d])) for d in np.unique(distance) if d]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries, and the members within the radius of them."""
        at, found = [], []
        open_ = [(self, np.arange(len(queries)))]
        while open_:
            node, some = open_.pop()
            if len(node.leaf):
                q, m = np.nonzero(np.bitwise_count(queries[some][:, None] ^ node.leaf) <= radius)
                at.append(some[q])
                found.append(node.leaf[m])
            if node.pivot is not None:
                distance = np.bitwise_count(queries[some] ^ node.pivot).astype(np.int16)
                hit = some[distance <= radius]
                at.append(hit)
                found.append(np.full(len(hit), node.pivot))
                for edge, child in node.children:
                    if len(on := some[np.abs(distance - edge) <= radius]):
                        open_.append((child, on))
        return np.concatenate(at), np.concatenate(found)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _masks(radius: int, level: int) -> list[int]:
    """Masks of the bits that a shard of each kind holds fixed: at level 0 the pairs of blocks that the 64 bits are cut into, then of what is left."""
    n = radius + 2
    masks = [0]
    for _ in range(level + 1):
        dealt = []
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            blocks = [sum(1 << b for b in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
            dealt += [mask | x | y for x, y in itertools.combinations(blocks, 2)]
        masks = dealt
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


class _Groups:
    """Links of one tree: members that are near each other, or near one query, are in one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x


def links_of_trees(shards: DataFrame, radius: int) -> DataFrame:
    """a, b: links of fingerprints. ``shards``: which, shard and fp, sorted, so that a shard's rows lie together."""

    def one(members: list[int]):
        if len(members) > FEW:
            yield from together(np.unique(np.array(members, np.uint64)))
            return
        tree, groups = BKTree(), _Groups()
        for x in members:
            for y in tree.near(x, radius):
                a, b = groups.root(x), groups.root(y)
                if a != b:
                    groups.up[a] = b
                    yield x, y
            tree.add(x)

    def together(members: np.ndarray):
        tree = BKBranches(members)
        a, b = tree.near(members, radius)
        root = _roots(len(members), a, np.searchsorted(members, b))
        # The root stands for its group: a link to any member of it holds the component together.
        for k in np.flatnonzero(root != np.arange(len(members))).tolist():
            yield int(members[k]), int(members[root[k]])

    def mapped(batches):
        key, members = None, []
        for batch in batches:
            found = []
            prints = batch.column(2).to_numpy().view(np.uint64).tolist()  # unsigned, for bit_count()
            for which, shard, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), prints, strict=True):
                if (which, shard) != key:
                    found += one(members)
                    key, members = (which, shard), []
                members.append(fp)
            yield _links(found)
        yield _links(list(one(members)))

    def _links(found):
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return shards.select("which", "shard", "fp").mapInArrow(mapped, "a long, b long")


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting. Small sides would be broadcast else, and each relation is built in the driver: a run has dozens of them."""
    return left.join(right.hint("merge"), on, how)


def near_links(unlike: DataFrame, radius: int) -> DataFrame:
    """a, b: links between the fingerprints fp of ``unlike`` that hold each component together."""
    pairs = len(_masks(radius, 0))
    dealt = unlike.select("fp", F.lit(0).alias("was"), F.lit(0).alias("level"))
    links, level = None, 0
    while True:
        masks = F.array(*(F.lit(_signed(m)).cast("long") for m in _masks(radius, level)))
        keyed = dealt.select("fp", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("k"), "was").select("fp", (F.col("was") * pairs + F.col("k")).cast("int").alias("which"))
        keyed = keyed.withColumn("shard", F.col("fp").bitwiseAND(F.element_at(masks, F.col("which") + 1)))
        many = cut_lineage(keyed.groupBy("which", "shard").agg(F.count("*").alias("n")).where(F.col("n") > 1))
        full = many.where(F.col("n") > TREE) if level + 1 < LEVELS else many.limit(0)
        deeper = not full.isEmpty()
        jobs = _met(keyed, many.where(F.col("n") <= TREE) if deeper else many, ["which", "shard"]).select("which", "shard", "fp")
        found = links_of_trees(jobs.repartition("which", "shard").sortWithinPartitions("which", "shard", "fp"), radius)
        links = found if links is None else links.union(found)
        if not deeper:
            return links.distinct()
        # Members that agree in the fixed bits of one full shard, each once: they are dealt by what else they agree in.
        dealt = cut_lineage(_met(keyed, full.select("which", "shard"), ["which", "shard"]).select("fp", F.col("which").alias("was"), F.lit(level + 1).alias("level")))
        level += 1


#: Edges of a task in a round of stars: a small graph isn't dealt to many tasks over and over.
EDGES = 200_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node of each component, for the nodes of ``links`` (a, b)."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = edges.agg(*sums).first()
    for _ in range(most_rounds):
        tasks = before[0] // EDGES + 1
        # Large star: every larger neighbour to the least of the neighbourhood.
        around = both(edges.coalesce(tasks))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _met(around, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour, and the node, to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _met(large, least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.distinct().coalesce(tasks))
        now = edges.agg(*sums).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle")


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` (node, root) after more ``links`` (a, b): only their roots are joined anew."""
    own = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = _met(_met(links, own("a"), "a", "left"), own("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    fresh = cut_lineage(components(ends))
    kept = _met(roots, fresh.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return cut_lineage(kept.union(_met(fresh, roots, "node", "left_anti").select("node", "root")))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fp (signed) and component_id of every row."""
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    prints = cut_lineage(with_fingerprints(source, words, "text"))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(classes.select("fp"), radius))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = cut_lineage(linked)
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


def word_key(text):
    """A hash of the word sequence, native: equal words in equal order are one text."""
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def _sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node and own, the set of its shingles' hashes, of the ``nodes`` (each once). ``texts``: node and text, equal ones as often as they stand there."""

    def mapped(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(_hashed(shingles(t, words))).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    few = nodes.count() <= BROADCAST  # so that other texts are not dealt out
    first = Window.partitionBy("node").orderBy("text")
    met = texts.join(F.broadcast(nodes), "node", "left_semi") if few else _met(texts, nodes, "node", "left_semi")
    asked = met.withColumn("__at", F.row_number().over(first)).where("__at = 1").select("node", "text")
    return cut_lineage(asked.mapInArrow(mapped, "node long, own array<long>"))


def _alike(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets of shingles have a similarity of ``SHARE`` or more."""
    sets = _sets(cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), texts, words)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"{c}s"))
    both = _met(_met(pairs, side("a"), "a"), side("b"), "b").withColumn("common", F.size(F.array_intersect("as", "bs")))
    return both.where(F.col("common") * SHARE[1] >= (F.size("as") + F.size("bs") - F.col("common")) * SHARE[0]).select("a", "b")


def _by_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs around a hub that can be alike although one of them is not like the hub. ``members``: hub, node, and out (true: not like the hub).

    Let x add p shingles to the hub's n and lack r of them: its differences. With the similarity s = k / m (here 4 / 5),
    x and y are alike only if they share c differences with (k + m) c >= w(x) + w(y) - (m - k) n, where w = k p + m r;
    and w(x) > (m - k) n is what being unlike the hub means. So y must share differences with x, by more than w(y) / (k + m): if its
    differences stand in the order of their rarity, one of the first (k + m)(|D| - i) >= w(y) + w(x) - (m - k) n. The same holds for
    x and its own places, since both see their first shared difference with all others behind it. Those are
    what few others have, so that the pairs of a group of near copies are not walked to find that they are none.
    """
    k, m = SHARE
    own = sets.select("node", "own")
    around = _met(_met(members, own, "node"), own.select(F.col("node").alias("hub"), F.col("own").alias("theirs")), "hub")
    around = around.select("hub", "node", "out", F.size("theirs").alias("n"), F.array_except("own", "theirs").alias("more"), F.array_except("theirs", "own").alias("less"))
    around = around.withColumn("w", k * F.size("more") + m * F.size("less")).withColumn("all", F.size("more") + F.size("less"))
    # A shingle is added or lacking, as the hub has it or not: its hash alone tells which. Arrays are written, not a row for each
    # difference, and what holds for a whole member is joined to the differences that others share.
    around = cut_lineage(around.select("hub", "node", "out", "n", "w", "all", F.concat("more", "less").alias("ds")))
    each = around.select("hub", "node", "out", F.explode("ds").alias("d"))
    rare = each.groupBy("hub", "d").agg(F.count("*").alias("often"), F.bool_or("out").alias("asked")).where("often > 1 AND asked")
    order = Window.partitionBy("hub", "node").orderBy("often", "d")
    # Differences that nobody shares come first, and are not dealt out: only their number counts.
    whole = around.select("hub", "node", "n", "w", "all")
    shared = _met(_met(each, rare, ["hub", "d"]), whole, ["hub", "node"]).withColumn("i", F.col("all") - F.count("*").over(Window.partitionBy("hub", "node")) + F.row_number().over(order) - 1)
    shared = shared.withColumn("slack", (k + m) * (F.col("all") - F.col("i")) - F.col("w")).withColumn("excess", F.col("w") - (m - k) * F.col("n"))
    theirs = shared.where("slack > 0").select("hub", "d", F.col("node").alias("y"), "slack", F.col("excess").alias("need"))
    ours = shared.where("out").select("hub", "d", F.col("node").alias("x"), "excess", F.col("slack").alias("own"))
    met = _met(ours, theirs, ["hub", "d"]).where("excess <= slack AND need <= own AND x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _fits(n, m):
    """Sets of so many members can reach ``SHARE``."""
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def near_copies(docs: DataFrame, words: int = 5, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, the ``word_key`` of each text, and kept, the node that stands for its component: that of the least ``key``.

    Components link texts whose sets of ``words``-word shingles have a similarity of ``SHARE`` or more, by the exact sets:

    1. Candidates are the links of the fingerprints' BK-trees, which hold nearly all pairs from a similarity of 0.95 on, and, since a
       radius that reached down to 0.8 would link strangers, each text with one text of each of its bands of least hashes.
       The exact test keeps what is near; that joins the large groups.
    2. Bands that still hold several components: the others' texts are tested with the hub of the band's largest component, the text
       of most bands. Those not like it are tested with every text of these bands that shares enough of their differences from
       the hub (``_by_differences``): no other can be like them.

    A pair inside one component needs no test, so a large group of near copies costs its members, not their pairs.
    """
    source = docs.select(F.col(key).alias("id"), word_key(F.col(text)).alias("node"), F.col(text).alias("text"))

    def mapped(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes = [_hashed(shingles(t, words) or [b""]) for t in part.column(2).to_pylist()]
                fps = np.array([_prints(h, 1)[0] for h in hashes], np.uint64).view(np.int64)
                keys = [_band_keys(h).view(np.int64) for h in hashes]
                sizes = pa.array([len(np.unique(h)) for h in hashes], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "n", "fp", "keys"])

    # Sketches leave the map, not texts: equal texts have equal ones.
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(mapped, f"id {kind}, node long, n long, fp long, keys array<long>")
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "fp", "keys"))))
    texts = source.select("node", "text")

    heads = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("many")))
    same = _met(nodes.select("node", "fp"), heads.where("many > 1"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    far = near_links(heads.select("fp"), radius)
    ends = heads.select("fp", "head")
    far = _met(_met(far, ends.withColumnsRenamed({"fp": "a", "head": "ha"}), "a"), ends.withColumnsRenamed({"fp": "b", "head": "hb"}), "b")

    # Dealt out once: the counts and the join find each band's rows together.
    banded = nodes.select("node", "n", F.explode("keys").alias("band")).repartition("band")
    shared = banded.groupBy("band").agg(F.count("*").alias("many"), F.min(F.struct(F.xxhash64("band", "node"), "node", "n")).alias("head")).where("many > 1")
    shared = cut_lineage(_met(banded, shared, "band").select("band", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("m")))
    stars = shared.where((F.col("node") != F.col("head")) & _fits(F.col("n"), F.col("m"))).select(F.col("node").alias("a"), F.col("head").alias("b"))
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = cut_lineage(ordered(stars.union(same).union(far.select("ha", "hb"))))
    found = cut_lineage(_alike(first, texts, words))

    roots = cut_lineage(components(found))
    open_ = _met(shared.select("band", "node", "n"), roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = open_.groupBy("band", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("band").agg(F.max(F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    open_ = _met(open_, main, "band").select("node", "root", "main.c", F.col("main.root").alias("main"))
    # How many of the main component a text meets in its bands: most for the text in the middle, that the others were made from.
    near = cut_lineage(open_.groupBy("main", "node").agg(F.first("root").alias("root"), F.sum("c").alias("met")))
    if not near.isEmpty():
        hubs = near.where("root = main").groupBy("main").agg(F.max(F.struct("met", "node")).alias("best")).select("main", F.col("best.node").alias("hub"))
        near = cut_lineage(_met(near, hubs, "main").select("hub", "node", "root", "main"))
        asked = cut_lineage(_met(ordered(near.where("root <> main").select(F.col("node").alias("a"), F.col("hub").alias("b"))), first, ["a", "b"], "left_anti"))
        roots = joined_components(roots, _alike(asked, texts, words))
        now = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        away = _met(_met(near.select("hub", "node"), now("node"), "node", "left"), now("hub"), "hub", "left")
        away = away.select("hub", "node", (F.coalesce("node_root", "node") != F.coalesce("hub_root", "hub")).alias("out")).where("hub <> node")
        few = away.groupBy("hub").agg(F.bool_or("out").alias("open")).where("open").select("hub")
        away = cut_lineage(_met(away, few, "hub"))
        sets = _sets(cut_lineage(away.select("node").union(away.select("hub")).distinct()), texts, words)
        rest = cut_lineage(_met(_by_differences(away, sets), first, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            roots = joined_components(roots, _alike(rest, texts, words))
    linked = cut_lineage(_met(nodes.select("id", "node"), roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")))
    best = linked.groupBy("root").agg(F.min(F.struct("id", "node")).alias("best"))
    return _met(linked, best, "root").select("node", F.col("best.node").alias("kept"))


def hexed(column):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
