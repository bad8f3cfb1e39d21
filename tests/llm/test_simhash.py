import random
import re

import numpy as np
import pytest
import xxhash

from waymark.llm import simhash
from waymark.llm.simhash import BKTree, components, hexed, near_duplicates, near_links

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not own:
        return 0
    parts = [" ".join(own)] if len(own) < words else [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, ids, radius):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            several = isinstance(prints[i], list)  # fingerprints, of which any two may be near
            if any((a ^ b).bit_count() <= radius for a, b in (zip(prints[i], prints[j], strict=True) if several else [(prints[i], prints[j])])):
                up[root(i)] = root(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(ids))]


def result(frame):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.h, r.component_id) for r in frame.withColumn("h", hexed("fp")).collect())


def wanted(rows, words, radius):
    prints = [fingerprint(t, words) for _, t in rows]
    return sorted(((i is None, i or 0), f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute(prints, [i for i, _ in rows], radius), strict=True))


@pytest.mark.parametrize("words,radius,tree", [(3, 3, 1024), (5, 3, 4), (3, 6, 3)])
def test_table_against_brute_force(spark, monkeypatch, words, radius, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs, words, radius)) == wanted(rows, words, radius)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (None, " \n"), (9, "A b"), (8, "a  B"), (8, "a b"), (None, "only here x"), (2, "x " * 200_000), (7, "É é")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    assert result(near_duplicates(docs)) == wanted(rows, 3, 3)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_no_link_is_lost_in_large_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 8)
    rng = random.Random(2)
    base = rng.getrandbits(63)
    prints = {0, 1, 3, 7, (1 << 63) | 5}
    for _ in range(150):
        value = base
        for bit in rng.sample(range(40), rng.randrange(9)):
            value ^= 1 << bit
        prints.add(value)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(near_links(frame, 3)).collect()}
    unsigned = [p & (2**64 - 1) for p in prints]
    whole = brute(unsigned, prints, 3)
    assert [got.get(p, p) for p in prints] == whole


@pytest.mark.parametrize("few", [0, 5])
def test_trees_walked_together_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "LEAF", 4)
    test_no_link_is_lost_in_large_shards(spark, monkeypatch)


def test_branches():
    rng = random.Random(3)
    members = np.array([rng.getrandbits(14) for _ in range(900)], np.uint64)
    tree = simhash.BKBranches(members)
    queries = np.arange(0, 1 << 14, 61, dtype=np.uint64)
    at, found = tree.near(queries, 2)
    got = sorted(zip(at.tolist(), found.tolist(), strict=True))
    assert got == sorted((k, int(m)) for k, q in enumerate(queries.tolist()) for m in members.tolist() if (m ^ q).bit_count() <= 2)


def test_bk_tree():
    rng = random.Random(1)
    members = [rng.getrandbits(12) for _ in range(300)]
    tree = BKTree()
    for x in members:
        tree.add(x)
    for q in range(0, 4096, 97):
        assert sorted(tree.near(q, 2)) == sorted({x for x in members if (x ^ q).bit_count() <= 2})
    assert BKTree().near(1, 3) == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_full_shards_are_dealt_again(spark):
    """20,000 near fingerprints in one shard, which fill nearly all bits left free, and a hundred strangers: trees stay small, no link is lost."""
    rng = random.Random(9)
    base = rng.getrandbits(63)
    prints = {base ^ (k << 40) ^ rng.getrandbits(3) for k in range(20_000)} | {rng.getrandbits(63) for _ in range(100)}
    frame = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    sizes = []
    real = simhash.links_of_trees
    simhash.links_of_trees = lambda shards, radius: sizes.append(shards.groupBy("which", "shard").count().agg({"count": "max"}).first()[0]) or real(shards, radius)
    try:
        got = {r.node: r.root for r in components(near_links(frame, 3)).collect()}
    finally:
        simhash.links_of_trees = real
    assert max(x for x in sizes if x) <= 4 * simhash.TREE
    tree = simhash.BKBranches(np.array(sorted(prints), np.uint64))
    members = np.array(sorted(prints), np.uint64)
    a, b = tree.near(members, 3)
    root = simhash._roots(len(members), a, np.searchsorted(members, b))
    assert [got.get(int(p), int(p)) for p in members] == members[root].tolist()


def test_masks_leave_few_bits_free():
    for level in range(simhash.LEVELS):
        masks = simhash._masks(3, level)
        assert len(masks) == 10 ** (level + 1)
    assert max(64 - m.bit_count() for m in masks) <= 16
