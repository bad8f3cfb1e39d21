import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm.token_counts import count_tokens, parts_by_bytes
from waymark.llm.tokens import PieceTokenizer, WordTokenizer

ODD = [
    "", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "  \n  ", "a", " a", "a ", "a  ", "  a", "Hello  world", "a\nb", "a \n b", "\na", "a\n", "x▁y", "▁", "▁▁a",
    "tab\there", "\r\nline", "</s> <s> <0x41>", "<|endoftext|>x <|startoftext|>", "don't we'll", "ﬁ Å é ̸x", " nbsp em", "日本語 テスト", "😀😀 👍🏽", "1234 5.6", "\x00\x01 \x1c", "a" * 500,
    "word " * 300, " " * 40 + "x", "ΑΣ ΣΑ İ", "!!! ?? $$$ a%%%",
]


def test_pieces_match_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = PieceTokenizer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.cuts
    assert own.counts(pa.array(ODD)).tolist() == [len(x) for x in library.encode(ODD)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_match_the_library(name):
    path = public_tokenizers.path(name)
    own, library = WordTokenizer(path), Tokenizer.from_file(path)
    assert own.drops_white == (name == "word_bpe_49k.json")
    assert own.counts(pa.array(ODD)).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in ODD]


def test_random_ascii_chunks_match_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abSTdl'!<|>9 .\x1c\x0b\nÀéßİſªº²½ʰ\xa0\xadΣ\u0301한ǅ") for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert own.counts(pa.array(texts)).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr("waymark.llm.tokens.KEEP", 5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert PieceTokenizer(path).counts(pa.array(ODD * 2)).tolist() == PieceTokenizer(path).counts(pa.array(ODD)).tolist() * 2


def test_whole_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, path, 4096).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)


def test_nulls_ties_and_empty_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(rows, path, 1).collect())
    assert got == [("1", 0, 0, False), ("2", 0, 0, False), ("2", 0, 0, False), ("None", 3, 2, True)]
    assert count_tokens(rows.limit(0), path, 1).collect() == []


def test_parts_by_bytes():
    assert list(parts_by_bytes([1, 1, 9, 1, 1, 1], 3)) == [(0, 2), (2, 3), (3, 6)]
    assert list(parts_by_bytes([], 3)) == []
