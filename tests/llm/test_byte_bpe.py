"""Byte-level BPE against the library, and exact round trips."""

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import byte_bpe
from waymark.llm.byte_bpe import decoded, dictionary, encoded, heap_merged, in_order, read_ranks

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def ranks(request):
    return read_ranks(public_tokenizers.path(request.param))


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "   ", "a", "Hello there, it's 2024!\n\n  indented\r\n\ttabs  ", "naïve café Straße ciónes ßß ÄÖÜ", "日本語のテキスト 한국어 العربية हिन्दी", "😀👩‍👩‍👧 é   　x\x85y\x1cz",
    "<|endoftext|> <|im_start|>", "x" * 5_000, "ab" * 3_000 + " " + "QWERTZUIOP" * 40, "=" * 300 + "-" * 300, " the the theing ouleretion ineinßchsch" * 50, "\x00\x01\x7f�\U0010ffff", "'s't'RE'll I'll we'd",
]


def test_against_the_library(spark, ranks):
    own = library(ranks)
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS * 2)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, words string, k int")
    found = decoded(encoded(frame, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() >= {"words", "k", "ids", "decoded"}
    for r in found:
        assert list(r.ids) == own.encode_ordinary(r.text or ""), r.text
        assert bytes(r.decoded) == (r.text or "").encode()


def test_all_code_points(spark, ranks):
    """The pattern's classes and white space, as Java has them, against the library's, around every code point that the library's Unicode knows as Java does."""
    own = library(ranks)
    points = [c for c in [*range(0x3000), *range(0xA000, 0xB000), *range(0xF900, 0x10000), *range(0x1F000, 0x1FA00)] if not 0xD800 <= c < 0xE000]
    rows = [("".join(f"a{chr(c)}1 {chr(c)}{chr(c)}" for c in points[k : k + 50]),) for k in range(0, len(points), 50)]
    wrong = [r for r in encoded(spark.createDataFrame(rows, "text string"), ranks, public_tokenizers.PATTERN, sample=10).collect() if list(r.ids) != own.encode_ordinary(r.text)]
    assert len(wrong) <= 0.05 * len(rows)  # letters that the younger of both Unicode versions has added
    assert [r for r in decoded(encoded(spark.createDataFrame(rows, "text string"), ranks, public_tokenizers.PATTERN), ranks).collect() if bytes(r.decoded) != r.text.encode()] == []


def test_fold_gives_the_heap_s_ids(spark, ranks):
    """Every word of the dictionary, by the fold alone."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    found = dictionary(texts, ranks, public_tokenizers.PATTERN, "text", 200, 3_000).collect()
    own = library(ranks)
    assert len(found) > 1_000
    assert [r.k for r in found if list(r.v) != own.encode_ordinary(r.k)] == []


def test_words_outside_the_dictionary_are_folded_too(spark, ranks):
    """No Python in the plan; words at the bounds of both folds, repeated and in several chunks, against the library."""
    own = library(ranks)
    words = ["".join("abtheingxß日"[(k * k + j * (k + 3)) % 11] for j in range(n)) for k, n in enumerate([*range(1, 12), *range(28, 64), 120])]
    texts = [*words, *(w * 7 for w in words[::6]), " ".join(words * 2), "= " * 5_000 + " ".join(words[:20]), "9" * 61 + " " + "9" * 60, None]
    found = encoded(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, public_tokenizers.PATTERN, frequent=1)
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in found.collect() if list(r.ids) != own.encode_ordinary(r.text or "")] == []


def test_parts_are_looked_up_only_as_far_as_pieces_reach(spark, ranks):
    """No piece is longer than the reach of its head, and a word's parts are not all looked up."""
    reach, size = byte_bpe._reach(ranks), byte_bpe.HEAD
    pieces = byte_bpe.rank_table(spark, ranks).where(F.octet_length("piece") >= size)
    assert pieces.count() > 10_000
    assert pieces.where(F.octet_length("piece") > reach(F.substring("piece", 1, size))).isEmpty()
    word = F.col("k").cast("binary")
    parts = byte_bpe._standing(word, F.octet_length(word), lambda part: F.lit(1), reach, lambda r, a, b: a * 64 + b)
    row = spark.createDataFrame([(" ofreedenedothernt" * 3,)], "k string").select(F.size(parts).alias("n")).first()
    assert 53 < row.n < 0.4 * sum(min(54 - a, max(map(len, ranks))) - 1 for a in range(53))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("abt hein", max_size=60))
def test_heap(text):
    ranks = test_heap.ranks
    own = library(ranks)
    word = text.encode()
    if word and word not in ranks:
        assert heap_merged(word, ranks) == own._encode_single_piece(word)


test_heap.ranks = read_ranks(public_tokenizers.path(FILES[0]))


def test_vocabularies_are_in_order(ranks):
    assert in_order(ranks)


def test_a_vocabulary_out_of_order_gets_no_dictionary(spark, monkeypatch):
    """'abc' has a lesser rank than 'bc', out of which alone it comes about."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257}
    assert not in_order(ranks)
    monkeypatch.setattr(byte_bpe, "dictionary", None)
    frame = spark.createDataFrame([("abc abcbc xbc",)], "text string")
    assert list(encoded(frame, ranks, public_tokenizers.PATTERN).first().ids) == library(ranks).encode_ordinary("abc abcbc xbc")


def test_broken_files(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="bytes without"):
        read_ranks(str(path))


def test_no_row_carries_the_rank_map(spark, ranks):
    """The maps are read where they lie: no projection that is left has one as a column."""
    texts = spark.createDataFrame([("a b c",)], "text string")
    plan = dictionary(texts, ranks, public_tokenizers.PATTERN, "text", 200, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS shelf_" not in plan and "scalar-subquery" in plan


def test_empty_table_and_unknown_ids(spark, ranks):
    none = encoded(spark.createDataFrame([], "text string"), ranks, public_tokenizers.PATTERN)
    assert decoded(none, ranks).collect() == []
    assert decoded(spark.createDataFrame([(None,)], "ids array<int>"), ranks).first().decoded is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        decoded(spark.createDataFrame([([60_000],)], "ids array<int>"), ranks).select(F.length("decoded")).collect()
