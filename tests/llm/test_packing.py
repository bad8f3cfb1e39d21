import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import packing
from waymark.llm.packing import best_fit, local_search, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, docs, size):
    """Every document's ids lie gapless in pieces, every sequence is filled gapless from 0."""
    library = Tokenizer.from_file(PATH)
    wanted = []
    for key, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            wanted.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(wanted)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= size
    return len({r.sequence_id for r in rows}), -(-sum(r.length for r in rows) // size)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    rows = pack_documents(docs, PATH).collect()
    bins, least = checked(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert bins <= least + 1


def test_small_groups_go_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    texts = ["word " * (37 * i % 50) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    bins, least = checked(pack_documents(docs, PATH, size=64).collect(), list(enumerate(texts)), 64)
    assert bins <= least + 3


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "", 4), (3, "long " * 700, 5), (4, "<|endoftext|>", 5)], "doc_id long, text string, piece int")
    rows = pack_documents(docs, PATH, size=256).collect()
    checked(rows, [(r.doc_id, r.text) for r in docs.collect()], 256)
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_local_search_never_loses():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.choice([10, 64, 300])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(1, 60))]
        bins = pack(lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= size for b in bins)
        assert len(bins) <= len(best_fit(lengths, size))


def test_local_search_empties_a_bin():
    lengths = [6, 4, 5, 3, 2]
    assert len(local_search([[0, 3], [2, 4], [1]], lengths, 10)) == 2


def test_local_search_meets_all_underfull_bins():
    # 200 emptiest bins that can't gain from each other stand before two that can.
    lengths = [60] * 200 + [41, 36, 66, 16]
    bins = [[k] for k in range(200)] + [[200, 201], [202, 203]]
    after = local_search(bins, lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    fills = sorted(sum(lengths[i] for i in b) for b in after)
    assert fills[-1] > 82 and max(fills) <= 100


def test_groups_of_one_task_go_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    texts = ["word " * (37 * i % 50) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bins, least = checked(pack_documents(docs, PATH, size=64).collect(), list(enumerate(texts)), 64)
    assert bins <= least + 3


def test_groups_are_bounded_and_mixes_are_packed_tightly(spark, monkeypatch):
    """Groups of the second step hold about GROUP pieces; three length mixes end within a bin a group of the least number."""
    held = []
    real = packing.pack
    rng = random.Random(8)
    for low, high in ((1, 64), (20, 28), (11, 31)):
        lengths = [rng.randint(low, high) for _ in range(4000)]
        bins = real(lengths, 64)
        held.append((len(best_fit(lengths, 64)), len(bins), -(-sum(lengths) // 64)))
        assert len(bins) <= len(best_fit(lengths, 64))
    assert held[0][1] <= 1.005 * held[0][2]
    monkeypatch.setattr(packing, "GROUP", 256)
    texts = ["word " * rng.randint(20, 30) for _ in range(1500)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)
    out = pack_documents(docs, PATH, size=64)
    assert out.schema["doc_id"].dataType.simpleString() == "string"
    bins, least = checked(out.collect(), [(str(i), t) for i, t in enumerate(texts)], 64)
    assert bins <= len(real([len(t.split()) + 1 for t in texts], 64)) + 1500 // 256 + 1 and bins >= least


def test_swaps_beat_best_fit():
    """Lengths of which best fit leaves pairs and triples: all underfull bins must meet for these figures (best fit alone: 1293, 979, 1053)."""
    for low, high, most in ((600, 900, 1250), (500, 700, 969), (350, 1023, 1030)):
        rng = random.Random(5)
        lengths = [rng.randint(low, high) for _ in range(3_000)]
        bins = pack(lengths, 2048)
        assert len(bins) <= most < len(best_fit(lengths, 2048))
        assert sorted(i for b in bins for i in b) == list(range(3_000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)


def test_no_step_is_left():
    """Where the search ends, no move, one for one, two for one or one for two between two bins raises the squares."""
    rng = random.Random(8)
    for _ in range(40):
        size = rng.choice([20, 50])
        lengths = [rng.randint(1, size // 2) for _ in range(30)]
        bins = pack(lengths, size)
        fills = [sum(lengths[i] for i in b) for b in bins]
        for (a, x), (b, y) in itertools.permutations(zip(bins, fills, strict=True), 2):
            if x == size:
                continue
            options = {r: {sum(lengths[i] for i in own) for own in itertools.combinations(a, r)} for r in range(3)}, {r: {sum(lengths[i] for i in own) for own in itertools.combinations(b, r)} for r in range(3)}
            for gives, gets in ((0, 1), (1, 1), (1, 2), (2, 1)):
                for m, n in itertools.product(options[0][gives], options[1][gets]):
                    assert not (0 < n - m <= size - x and y < x + n - m and y < size)
