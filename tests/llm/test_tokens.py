"""BPE and token counts against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwatch.llm import bpe, tokencount
from shelfwatch.llm.queries import LLM_JOBS

SMALL = "/root/testdata/sf0.001"
PARTS = st.sampled_from(["'s", "'re", "'r", "'l", "don't", " ", "  ", "\n", "é", "É", "Σ", "日本", "12", "½", "!?", "'", "aaaa", "the", "İ", "<|endoftext|>", "\x1c", "\x85"])


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join) | st.text(max_size=20), min_size=1, max_size=5))
def test_any_texts(libraries, byte_level, word_end, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    words, library = bpe.kept_words(byte_level), libraries["byte_bpe_50k.json"]
    for first, ids, counts in bpe.encode_texts(texts, words):
        ends = np.r_[0, np.cumsum(counts)]
        decoded = bpe.decode_ids(ids, counts, words.merges)
        for k in range(len(counts)):
            expected = library.encode(texts[first + k], add_special_tokens=False).ids
            assert ids[ends[k] : ends[k + 1]].tolist() == expected
            assert decoded[k] == library.decode(expected, skip_special_tokens=False)
    words = bpe.kept_words(word_end)
    expected = [len(e.ids) for e in libraries["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_tokens(texts, words, words.merges).tolist() == expected


def test_pieces_do_not_change_ids(byte_level, monkeypatch):
    text = "some words of a text, it's long " * 50
    whole = [i.tolist() for _, i, _ in bpe.encode_texts([text], bpe.kept_words(byte_level))]
    monkeypatch.setattr(bpe.pieces, "__defaults__", (40,))
    assert len(list(bpe.pieces(text))) > 10
    assert [i.tolist() for _, i, _ in bpe.encode_texts([text], bpe.kept_words(byte_level))] == whole


def test_invalid_bytes_decode_as_in_library(libraries, byte_level):
    merges = bpe.kept_words(byte_level).merges
    for ids in ([447], [447, 247], [51, 447], [158, 121], [158, 121, 51]):
        assert bpe.decode_ids(np.array(ids), np.array([len(ids)]), merges) == [libraries["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)]


def test_op8_and_op3_on_documents(spark, libraries):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    library = libraries["byte_bpe_50k.json"]
    for row in LLM_JOBS["op8_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    library = libraries["word_bpe_49k.json"]
    for row in LLM_JOBS["op3_token_counts"](spark, SMALL).collect():
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(texts[row.doc_id].encode()), n > 2048)


def test_odd_rows(odd_docs, no_docs, byte_level, word_end, libraries):
    encoded = bpe.encode(odd_docs, byte_level, ["doc_id", "text", "score"])
    decoded = {(r.doc_id, r.text): r.decoded for r in bpe.decode(encoded, byte_level, ["doc_id", "text"]).collect()}
    assert len(decoded) == 12 and all(d == (t or "") for (_, t), d in decoded.items())
    counted = tokencount.with_token_counts(odd_docs, word_end, ["text"]).collect()
    assert len(counted) == odd_docs.count()
    assert all(r.n_tokens == len(libraries["word_bpe_49k.json"].encode(r.text or "", add_special_tokens=False).ids) for r in counted)
    assert bpe.round_trip(no_docs, byte_level, ["doc_id"]).count() == tokencount.with_token_counts(no_docs, word_end, ["doc_id"]).count() == 0


def test_prefix_scan_composes_maps():
    maps = np.random.default_rng(1).integers(0, 7, (37, 7)).astype(np.uint8)
    reach, state = tokencount.compose_prefixes(maps), np.arange(7)
    for i, m in enumerate(maps):
        state = m[state]
        assert (reach[i] == state).all()
