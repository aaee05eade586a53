"""Token files and chunked encoding against the tokenizers library on whole texts."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loanloom.llm import chunks, tokens
from loanloom.llm.pieces import Pieces, tokenizer_text

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PIECES = {p: Pieces(tokenizer_text(p)) for p in (BYTE, WORD)}

WORDS = st.sampled_from([
    "the", "Don't", "we'LL", "İstanbul", "naïve", "é", "́", " ", "  ", "\n", "\n\n ", "\t", " ", " ", " ", "​", "\x1c",
    "\x85", "᠎", "<|endoftext|>", "<|startoftext|>", "<|", "123", "x" * 50, "日本語テキスト", "🙂👩‍👩‍👧", "!!", "...", "'s", "it's!'s", "a.b", "_x", "÷", "ɐ", "ß", "ΑΣ", " ", "a",
])


def whole(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.lists(WORDS, max_size=40).map("".join))
def test_pieces_equal_library(path, text):
    assert np.frombuffer(PIECES[path].encode(text), "<u4").tolist() == whole(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(parts=st.lists(WORDS, min_size=100, max_size=400), seed=st.integers(0, 9))
def test_chunks_equal_library(path, parts, seed):
    rnd = random.Random(seed)
    text = "".join(p + rnd.choice(["", " ", " word" + str(rnd.randrange(50))]) for p in parts if not p.startswith(("<|", "\x1c", "\x85", "᠎", "​")))
    encoder = chunks.ChunkEncoder(PIECES[path], {})
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole(path, text)
    assert "".join(chunks.chunks_of(text)) == text


def test_text_without_white_space_takes_linear_time():
    draw, pieces = random.Random(3), PIECES[WORD]
    for letters in ([chr(c) for c in range(0x4E00, 0x9000)], "abcdefghijklmnop0123456789+/"):
        text = "a few words before " + "".join(draw.choices(letters, k=80_000)) + " and some after"
        encoder, start = chunks.ChunkEncoder(pieces, {}), time.perf_counter()
        found = encoder.encode(text)
        assert time.perf_counter() - start < 2
        assert found == pieces.whole(text)


def test_passages_are_cut_alike_and_seams_repaired():
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(600))
    one, two = chunks.chunks_of("short start " + passage), chunks.chunks_of("another, longer start of a text " * 9 + passage)
    assert len(set(one) & set(two)) > 0.7 * len(one)
    encoder = chunks.ChunkEncoder(PIECES[WORD], {})
    encoder.encode("short start " + passage)
    encoder.encode("another start " + passage)
    assert encoder.repaired and encoder.reused > 0.7 * len(one)


ROWS = [(3, "the same passage " * 200), (1, "the same passage " * 200), (2, None), (5, ""), (None, "né\n<|endoftext|>"), (4, "y" * 300_000),
        (1, "the same passage " * 200), (1, "other text for one id"), (9, "Title  case\tand tabs " * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS], "doc_id long, text string, n_tokens int, part string")


def test_token_files(spark, docs):
    got = tokens.token_digests(docs, BYTE).collect()
    want = [(i, np.array([*whole(BYTE, t or ""), 2], "<u4")) for i, t in ROWS]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert tokens.token_digests(docs.limit(0), BYTE).count() == 0


def test_token_lookup_by_metadata(spark, docs):
    files = tokens.write_tokens(docs.filter("doc_id IS NOT NULL"), BYTE)
    got = files.documents([4, 5, 77]).collect()
    assert sorted(r.doc_id for r in got) == [4, 5] and [list(r.ids) for r in got if r.doc_id == 5] == [[2]]
    plan = files.rows([4, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_round_trip(spark, docs):
    got = sorted(((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunks.round_trip(docs, WORD).collect()))
    want = []
    for i, t in ROWS:
        ids = whole(WORD, t or "")
        text = LIBRARY[WORD].decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert chunks.round_trip(docs.limit(0), WORD).count() == 0
    assert chunks.shared_chunks(docs, tokenizer_text(WORD))
