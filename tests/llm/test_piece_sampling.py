import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from waymark.llm import piece_sampling
from waymark.llm.piece_sampling import chunks_of, decode_pieces, lattices, sample_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a ", "Hello  world\n", "\n\n x", "x▁y ▁", "日本語 テ\x00ス\x01ト", "😀 ́é\r\n\t", "word " * 500, "a" * 5000, "�" * 90, "1234 5.6"]


def segmentations(model, chunk):
    """Every segmentation's outputs and weight."""
    if not chunk:
        yield (), 1.0
        return
    for n in range(1, min(len(chunk), model.longest) + 1):
        if chunk[:n] in model.pieces:
            put, weight = model.pieces[chunk[:n]]
        elif n == 1:
            put, weight = model._bytes_of(chunk[0]), piece_sampling._STEP * 1e-9
        else:
            continue
        for rest, more in segmentations(model, chunk[n:]):
            yield (put, *rest), weight * more


def test_filtered_lattice_against_all_segmentations():
    model = lattices(PATH, 1.0)
    for chunk in (" the", " token", "\nab", " é日", "▁x"):
        n, *parts = model.filtered(chunk)
        ends, limits, starts, out = (np.frombuffer(x, np.uint32).tolist() for x in parts)
        edges = {}
        for e, limit, s, o in zip(ends, limits, starts, out, strict=True):
            edges.setdefault(e, []).append((limit, s, o))
        total = sum(w for _, w in segmentations(model, chunk))
        for outputs, weight in segmentations(model, chunk):
            at, share = n, 1.0
            for put in reversed(outputs):
                before = 0
                for limit, s, o in edges[at]:
                    if o == put:
                        share, at = share * (limit - before) / 2**32, s
                        break
                    before = limit
            assert at == 0 and share == pytest.approx(weight / total, abs=1e-8)


def test_many_at_once_equal_one_by_one():
    model, rng = lattices(PATH, 0.7), random.Random(1)
    chunks = [" " + "".join(rng.choice("etaoin日é▁. thing") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", " ", "\n", "z" * 64]
    count, *many = model._edges(chunks)
    one = [model.filtered(c) for c in chunks]
    assert count.tolist() == [len(x[1]) // 4 for x in one]
    for k in range(4):
        assert many[k].tolist() == np.frombuffer(b"".join(x[k + 1] for x in one), np.uint32).tolist()


def test_draws_follow_the_weights():
    model = lattices(PATH, 1.0)
    keys = list(range(20_000))
    ids, bounds = model.sample(keys, chunks_of(pa.array(["then"] * len(keys))), 9)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(bounds))
    all_ = {s: w for s, w in segmentations(model, " then")}
    total = sum(all_.values())
    for outputs, weight in all_.items():
        assert seen[outputs] / len(keys) == pytest.approx(weight / total, abs=0.015)


def test_lossless_and_reproducible(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(None, "null key", 0), (3, "a", 1), (500, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text", "0"))
    made = sample_pieces(docs.repartition(5), PATH, with_ids=True)
    got = made.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    again = {(r.doc_id, r.ids_crc32) for r in sample_pieces(docs.coalesce(1), PATH).collect()}
    assert {(r.doc_id, r.ids_crc32) for r in got} == again
    other = {(r.doc_id, r.ids_crc32) for r in sample_pieces(docs, PATH, seed=1).collect()}
    assert len(other & again) < len(again) / 2
    back = sorted((str(r.doc_id), r.text) for r in decode_pieces(made, PATH).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sample_pieces(docs.limit(0), PATH).collect() == []
