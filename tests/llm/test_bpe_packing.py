import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import bpe, packing

PATH = bpe.default_tokenizer()
LIB = Tokenizer.from_file(PATH)
OWN = bpe.ForcedBoundaryBPE(PATH)


def check(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got).decode() == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "it's THE 'Stop", "<|endoftext|>x<|startoftext|>", "İstanbul ΑΣ", "日本語 ١٢ ½", "a" * 3000, "\x85a\x1cb", "é" * 99])
def test_as_the_library(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_cuts_are_never_spanned():
    for token in list(OWN.vocab)[::97]:
        ends = token.endswith("</w>")
        raw = bytes(OWN.number[c] for c in (token[:-4] if ends else token))
        if ends:
            assert OWN.cuts(raw) == []


def test_documents(spark, docs, clashing, empty):
    rows = bpe.digest_documents(docs, PATH).collect()
    texts = {(r.doc_id): r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digest_documents(clashing, PATH).count() == len(rows)
    assert bpe.digest_documents(empty, PATH).count() == 0
    full = bpe.encode_documents(docs, PATH).where("doc_id = 0").first()
    assert full.ids == LIB.encode(texts[0], add_special_tokens=False).ids


def test_best_fit_and_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets, fill = packing.best_fit_decreasing(x, 100)
        assert fill.max() <= 100 and fill.sum() == x.sum()
        assert packing.lower_bound(x, 100) <= len(fill)
        for b in range(len(fill)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.cumsum(np.append(0, x[own][:-1]))).all()
    assert packing.lower_bound(np.array([60] * 7), 100) == 7


def test_rounds_go_on_while_bins_are_saved(spark, monkeypatch):
    """A packer that saves one bin a round for seven rounds, then none."""
    seen = []

    def parts(pieces, capacity, round_no):
        seen.append(round_no)
        bins = 12 - min(round_no, 7)
        now = pieces.drop("sequence_id", "offset", "bound", "bins", "given")
        return now.selectExpr("*", f"(cast({round_no} as long) << 48) + least(key, {bins - 1}) AS sequence_id", "key AS offset", "1L AS bound", f"{bins}L AS bins", "true AS given")

    monkeypatch.setattr(packing, "pack_parts", parts)
    pieces = spark.range(12).selectExpr("id AS key", "1L AS length", "id % 3 AS part")
    rows = packing.pack(pieces, 100, 5).collect()
    assert seen == list(range(9)) and len(rows) == 12 and len({r.sequence_id for r in rows}) == 5


def test_packing(spark, docs, clashing, empty):
    for part_pieces in (60_000, 7):
        rows = packing.pack_documents(docs, PATH, capacity=256, part_pieces=part_pieces).collect()
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        bins = {}
        for r in rows:
            ids = np.array(LIB.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
            own = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 256 and r.ids_crc32 == zlib.crc32(own.tobytes())
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 256
        bound = packing.lower_bound(np.array([r.length for r in rows]), 256)
        assert bound <= len(bins) <= (bound + 1 if part_pieces > 7 else 1.15 * bound + 1)
    assert packing.pack_documents(clashing, PATH).count() == packing.pack_documents(docs, PATH).count()
    assert packing.pack_documents(empty, PATH).count() == 0
