"""Token ids by chunks that no token can cross.

Both libraries tokenize a text as the concatenation of its chunks when it is
cut only at *safe boundaries*, places that no token of the vocabulary crosses.
Chunks repeat a lot, so each worker keeps the ids of the chunks it has met (two
generations of up to ``KEEP``) and sends only new ones to the library, in
batches balanced by bytes.

Safe boundaries, each proved from the model's file when it is loaded:

* a ``.json`` file whose pre-tokenizer drops white space and whose added tokens
  hold none: any of space, tab, line feed, carriage return;
* a ``.model`` file with the identity normalizer and a dummy prefix, in whose
  pieces the word mark stands only in front (or in runs of marks) and the line
  feed nowhere: before a run of spaces, and before a line feed.

Any other file has none: its texts go to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks in a generation, about 200 bytes each.
KEEP = 80_000
#: New chunks sent to the library at a time.
BATCH = 1 << 13

_MARK = "▁"


class _Kept:
    """The values of chunks met before; ``fill`` makes new ones. When full, it starts an empty generation and keeps the last."""

    def __init__(self, fill):
        self.fill, self.now, self.old = fill, {}, {}

    def values(self, chunks: list[str]) -> list:
        out = list(map(self.now.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.now) + len(new) > KEEP:
            self.now, self.old = {}, self.now
        rest = []
        for i in new:
            if (x := self.old.get(chunks[i])) is None:
                rest.append(i)
            else:
                out[i] = x
        for at in range(0, len(rest), BATCH):
            part = rest[at : at + BATCH]
            for i, x in zip(part, self.fill([chunks[i] for i in part]), strict=True):
                out[i] = x
        self.now.update((chunks[i], out[i]) for i in new)
        return out


def _spread(lists: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of lists of chunks: each chunk's number, the unlike chunks, and where the lists begin and end."""
    coded = lists.values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), lists.offsets.to_numpy()


def _joined(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(own), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in own], dtype=np.int64)])


def _sums(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: The pre-tokenizer's pattern that the fast path knows, and what a text may not hold there: code
#: points from U+0300 on, where NFC may compose, control and format characters, U+0130, and what may be a special token.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = r"[^\x20-\x7e\xa1-\xac\xae-\x{2ff}]|\x{130}|<\|"


class WordTokenizer:
    """A ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        first = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = first.get("pattern", {}).get("Regex", "")
        self.drops_white = (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and "\\s" in pattern
            and re.sub(r"\[\^\\s[^\]]*\]", "", pattern).find("\\s") < 0
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        )
        # Printable chunks of code points below U+0300, which NFC leaves alone, go on to the pre-tokenizer's
        # words, in lower case, where far fewer are unlike. Those need no normalizer and no pattern any more.
        # Whole texts of such code points are set out in those words at once.
        normal = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (said.get("normalizer") or {}).get("normalizers", [])]
        plain = normal == [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)] and all("<|" in t["content"] for t in said["added_tokens"])
        plain = plain and pattern == _PATTERN
        self.split = regex.compile(pattern).findall if plain and self.drops_white else None
        self.words, self.kept = _Kept(self._words), _Kept(self._chunks if self.split else self._encode)
        ends = {i for word, i in self.library.get_vocab().items() if word.endswith("</w>")}
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([i in ends for i in range(self.library.get_vocab_size())])

    def _words(self, batch: list[str]) -> list[bytes]:
        """The ids of the pre-tokenizer's words: encoded as one text, cut where a word's end has its own kind of token."""
        whole, batch = batch, [w for w in batch if w]
        ids = np.array(self.bare.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(batch):
            return self._encode(whole)
        raw, cuts = ids.tobytes(), itertools.pairwise([0, *ends.tolist()])
        return [raw.__getitem__(slice(*next(cuts))) if w else b"" for w in whole]

    def _chunks(self, batch: list[str]) -> list[bytes]:
        parts = [self.split(c.lower()) if c.isprintable() and (c.isascii() or max(c) < "\u0300") and "<|" not in c else None for c in batch]
        ready = iter(self.words.values([x for own in parts if own for x in own]))
        rest = iter(self._encode([c for c, own in zip(batch, parts, strict=True) if own is None]))
        return [next(rest) if own is None else b"".join(itertools.islice(ready, len(own))) for own in parts]

    def _encode(self, batch: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(batch, add_special_tokens=False)]

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as little-endian unsigned 32-bit numbers, and where each text's ids begin and end."""
        if not self.drops_white:
            return _joined(self._encode(texts.to_pylist()))
        for white in "\n\t\r":
            texts = pc.replace_substring(texts, white, " ")
        if not self.split:
            return self._looked_up(self.kept, texts)
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd).as_py():
            return self._looked_up(self.words, self._spaced(texts))
        own = np.array([None] * len(texts), object)
        for mask, kept in ((odd, self.kept), (pc.invert(odd), self.words)):
            part = texts.filter(mask)
            ids, bounds = self._looked_up(kept, part if kept is self.kept else self._spaced(part))
            own[mask.to_numpy(zero_copy_only=False)] = [ids[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist())] or None
        return _joined(own.tolist())

    @staticmethod
    def _spaced(texts: pa.StringArray) -> pa.StringArray:
        """The pre-tokenizer's words in lower case, with spaces between: letters stay, all other tokens are set apart."""
        return pc.replace_substring_regex(pc.utf8_lower(texts), "('s|'t|'re|'ve|'m|'ll|'d|\\p{N}|[^ \\p{L}\\p{N}]+)", " \\1 ")

    @staticmethod
    def _looked_up(kept: _Kept, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        codes, chunks, bounds = _spread(pc.split_pattern(texts, " "))
        values = kept.values(chunks)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, n = np.cumsum(lengths) - lengths, lengths[codes]
        where = np.concatenate([[0], np.cumsum(n)])
        pool = np.frombuffer(b"".join(values), "<u4")
        return pool[np.repeat(starts[codes] - where[:-1], n) + np.arange(where[-1])], where[bounds]

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        return np.diff(self.ids(texts)[1])


class PieceTokenizer:
    """A ``sentencepiece`` file. ``counts(texts)`` gives the number of ids of each text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        said = model.ModelProto()
        with open(path, "rb") as file:
            said.ParseFromString(file.read())
        spec, pieces = said.normalizer_spec, [p.piece for p in said.pieces if p.type in (1, 4)]
        self.cuts = (
            not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
            and not said.trainer_spec.treat_whitespace_as_suffix
            and said.trainer_spec.byte_fallback
            and not any(p.type == 4 for p in said.pieces)
            and not any("\n" in p or _MARK in p.lstrip(_MARK) for p in pieces)
        )
        self.kept, self.plain = _Kept(self._count), _Kept(self._lengths)

    def _lengths(self, batch: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(batch, num_threads=1)]

    def _count(self, batch: list[str]) -> list[int]:
        # The library puts one mark before each text. A chunk brings its own: take one space away, or take
        # the mark's token off again. A bare run of spaces ends at a line feed here, which is a token of its own.
        asked, off = [], []
        for chunk in batch:
            if chunk[0] == "\n":
                asked.append(chunk)
                off.append(1)
            elif chunk.strip(" "):
                asked.append(chunk[1:])
                off.append(0)
            else:
                asked.append(chunk[1:] + "\n")
                off.append(1)
        return [n - k for n, k in zip(self._lengths(asked), off, strict=True)]

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        if not self.cuts:
            return np.array(self._lengths(texts.to_pylist()), np.int64)
        # Where no two spaces meet and none stands at an end, the chunks are what lies between spaces.
        odd = pc.match_substring_regex(texts, f"^ | $|  |{_MARK}|^$").to_numpy(zero_copy_only=False)
        codes, words, bounds = _spread(pc.split_pattern(texts.filter(pa.array(~odd)), " "))
        values = np.array(self.plain.values(words), np.int64)
        out = np.zeros(len(texts), np.int64)
        out[~odd] = _sums(values[codes], bounds)
        for at in np.flatnonzero(odd).tolist():
            out[at] = sum(self.kept.values(chunked(texts[at].as_py())))
        return out


_CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")


def chunked(text: str) -> list[str]:
    """The text behind its dummy prefix, cut before each run of spaces and each line feed; the mark counts as a space."""
    return _CHUNK.findall(" " + text.replace(_MARK, " ")) if text else []


_loaded: dict[str, WordTokenizer | PieceTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer | PieceTokenizer:
    """The file's tokenizer, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path) if path.endswith(".json") else PieceTokenizer(path)
    return _loaded[path]
