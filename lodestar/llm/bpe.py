"""BPE encoding and decoding by forced-boundary splitting.

A vocabulary fixes which pairs of neighbouring bytes occur inside any of its tokens. Every merge yields a token of
the vocabulary, so between two bytes that no token holds side by side no merge can ever reach across: a certain cut.
A word is split at its certain cuts, the fragments are encoded independently, and their ids are concatenated. The last
byte of a word is a symbol of its own (it carries the mark of a word's end), so it has pairs of its own.

Defined results: a null text is an empty one (no tokens, decoded text empty); strings of added tokens inside a text are
those tokens; repeated rows, ties and nulls in other columns do not matter, as each row is encoded by itself; an empty
table gives an empty table; columns of the input other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import _shared

END = "</w>"
#: Texts within these characters are normalised and split here; others by the library's own normaliser and splitter.
_PLAIN = [*map(chr, range(0x100))]


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _set(test) -> str:
    return "".join(re.escape(c) for c in _PLAIN if test(c))


def _plain_pattern() -> str:
    letter, number = _set(lambda c: unicodedata.category(c)[0] == "L"), _set(lambda c: unicodedata.category(c)[0] == "N")
    space = _set(lambda c: c in "\t\n\v\f\r \x85\xa0")
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"


class _Cache(dict):
    """Word to ids; a word that isn't there is encoded. Emptied when full, so its memory is bounded."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


class ForcedBoundaryBPE:
    """Encodes as the tokenizers library does with the same file (add_special_tokens=False) and decodes likewise."""

    def __init__(self, path: str, cache_words: int = 400_000):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.added = model["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: One model for the fragment that ends a word and one for those before it.
        self.last = models.BPE(vocab=self.vocab, merges=merges, **({"end_of_word_suffix": self.suffix} if self.suffix else {}))
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        self.library = Tokenizer.from_file(path)
        self.chars = byte_chars()
        self.table = dict(enumerate(self.chars))
        self.number = {c: b for b, c in enumerate(self.chars)}
        self.joined = self._joined_pairs()
        self.names: list[bytes] = [b""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for token, k in [*self.vocab.items(), *self.added.items()]:
            self.names[k] = token.encode()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.plain = re.compile(_plain_pattern())
        self.cache = _Cache(self._word, cache_words)
        self.mapped = _Cache(self._mapped_word, cache_words // 4)

    def _joined_pairs(self) -> list[bytearray]:
        """joined[x][y] is 1 if byte x stands before symbol y inside a token; symbols 256 and up are bytes that end a word."""
        joined = [bytearray(512) for _ in range(256)]
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = [self.number[c] for c in (token[: -len(self.suffix)] if ends else token) if c in self.number]
            for k in range(len(body) - 1):
                joined[body[k]][body[k + 1] + 256 * (ends and k == len(body) - 2)] = 1
            if not self.suffix and len(body) > 1:
                joined[body[-2]][body[-1] + 256] = 1
        return joined if self.suffix else [bytearray(x[:256]) * 2 for x in joined]

    def cuts(self, word: bytes) -> list[int]:
        """Positions in a word that no token can span."""
        joined, last = self.joined, len(word) - 1
        found = [k for k, (x, y) in enumerate(zip(word, word[1:-1]), 1) if not joined[x][y]]
        if last > 0 and not joined[word[last - 1]][word[last] + 256]:
            found.append(last)
        return found

    def _mapped_word(self, mapped: str) -> bytes:
        return self._encode(bytes(self.number[c] for c in mapped), mapped)

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        return self._encode(raw, raw.decode("latin-1").translate(self.table))

    def _encode(self, raw: bytes, mapped: str) -> bytes:
        ids, at = [], 0
        for cut in self.cuts(raw):
            ids += [x.id for x in self.inner.tokenize(mapped[at:cut])]
            at = cut
        ids += [x.id for x in self.last.tokenize(mapped[at:])]
        return array("I", ids).tobytes()

    def _segment(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return b"".join(map(self.cache.__getitem__, self.plain.findall(text.lower())))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([self.mapped[piece] for piece, _ in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._segment(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._segment(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: this vocabulary has no decoder, so tokens joined by spaces."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids (array of ints, in order) and decoded text of every row."""

    def run(batches):
        coder = load(path)
        for batch in batches:
            for part, texts in _shared.slices(batch, text):
                ids = [coder.encode(x) for x in texts.to_pylist()]
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array([coder.decode(x).decode() for x in ids])], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same encoding and decoding, with digests in place of the ids and the text: one narrow stage, no shuffle."""

    def run(batches):
        coder = load(path)
        for batch in batches:
            for part, texts in _shared.slices(batch, text):
                counts, shas, back = [], [], []
                for x in texts.to_pylist():
                    ids = coder.encode(x)
                    counts.append(len(ids) // 4)
                    shas.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(_shared.table(spark, sf_dir, "documents"), default_tokenizer())


if sys.byteorder != "little":
    raise ImportError("ids are written in the machine's byte order, which must be little-endian")
