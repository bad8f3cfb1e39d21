import re
from collections import Counter

import numpy as np
import pytest

from waymark.llm import line_dedup
from waymark.llm.line_dedup import drop_frequent_lines
from waymark.llm.mph import PerfectHash

TRIM = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def brute(texts, min_docs, min_chars=1):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [[(x, TRIM.sub("", x).translate(lower)) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for own in split for k in {k for _, k in own})
    return [("\n".join(x for x, k in own if not (len(k) >= min_chars and seen[k] >= min_docs)), len(own), sum(len(k) >= min_chars and seen[k] >= min_docs for _, k in own)) for own in split]


TEXTS = [None, "", "A line \nb", "a LINE\r\nc\n\n", "\ta line\x0b", "ÄB\näb", "äb", "Äb", "\n\n", "x" * 300_000 + "\na line", "é\n\xa0é"] + ["same\nown %d" % i for i in range(30)]


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 1), (2, 2), (100, 1)])
def test_against_brute_force(spark, min_docs, min_chars):
    rows = [(i if i % 5 else None, t, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_lines long")
    out = drop_frequent_lines(docs, min_docs, min_chars)
    assert out.columns == ["doc_id", "text", "N_lines", "n_lines_", "n_dropped"]
    got = {r[2]: tuple(r[i] for i in (1, 3, 4)) for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == brute(TEXTS, min_docs, min_chars)


def test_many_passes_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = sorted(drop_frequent_lines(docs, 2).collect())
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    assert sorted(drop_frequent_lines(docs, 2, broadcast_bytes=1500).collect()) == whole
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r[1:]) for r in whole] == brute(texts, 2)


def test_empty_table(spark):
    assert drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    prints, counts = keys * np.uint64(3), np.arange(len(keys)).astype(np.uint64)
    made = PerfectHash.load(PerfectHash.build(keys, prints, counts).dump())
    assert sorted(made.slots(keys)) == list(range(len(keys)))
    assert (made.count(keys, prints) == counts).all()
    assert not made.count(keys + np.uint64(2**63), prints + np.uint64(1)).any()
    assert PerfectHash.load(PerfectHash.build(keys[:0], prints[:0], counts[:0]).dump()).count(keys[:2], prints[:2]).tolist() == [0, 0]
