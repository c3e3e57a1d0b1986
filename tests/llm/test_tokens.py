"""Byte-level BPE and Simple-8b files against the tokenizer libraries."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from faultlens.llm import bpe, catalog, simple8b
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .conftest import SMALL

RANKS = P.path("byte_bpe_50k.tiktoken")
RAW = open(RANKS, "rb").read()
OWN = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
)
WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))
WORDS.encode_special_tokens = True


def test_bpe_equals_library(spark, documents, odd):
    for docs in (documents, odd):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = []
        for key, text in texts:
            ids = np.array(OWN.encode_ordinary(text), "<u4")
            want.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.digests(docs, RANKS, P.PATTERN, block_bytes=20_000).collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(got, key=order) == sorted(want, key=order)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cat'sé日 \n1"), max_size=60), max_size=8))
def test_replay_any_pieces(texts):
    m = bpe.merges(RAW)
    pieces = sorted({p.encode() for t in texts for p in __import__("regex").findall(P.PATTERN, t)})
    ids, counts = bpe.replay(pieces, m)
    parts = np.split(ids, np.cumsum(counts)[:-1]) if pieces else []
    for piece, part in zip(pieces, parts):
        assert part.tolist() == OWN.encode_ordinary(piece.decode())
        assert bpe.decode(part, m) == piece


def test_bpe_ids_and_bytes(spark, odd):
    row = next(r for r in bpe.encode(odd, RANKS, P.PATTERN).collect() if r.doc_id == 1)
    assert list(row.ids) == OWN.encode_ordinary(row.decoded.decode())


def test_bpe_empty(spark, none):
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("high", [2, 3, 100, 50_000, 1 << 40])
@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 3000])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, high, n) * (rng.random(n) < 0.7)
    words = simple8b.pack(codes)
    assert (simple8b.unpack(words, n) == codes.astype(np.uint64)).all()
    assert len(words) <= n


def test_simple8b_packs_small_codes():
    assert len(simple8b.pack(np.ones(600, np.int64))) == 10


def test_block_escapes_rare_ids():
    ids = np.array([7] * 50 + [40_000, 5, 7, 99_999], np.uint32)
    payload = simple8b.write_block(np.array([54]), ids, dictionary=2)
    lengths, back = simple8b.read_block(payload)
    assert lengths.tolist() == [54] and back.tolist() == ids.tolist()


def _token_files(spark, docs, folder, **more):
    simple8b.write_ids(docs, folder, P.path("word_bpe_49k.json"), end=2, **more)
    return simple8b.checksums(simple8b.read_ids(spark, folder)).collect()


def test_token_files(spark, documents, odd, tmp_path):
    for i, docs in enumerate((documents, odd)):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(_token_files(spark, docs, str(tmp_path / str(i)), block=500, known=300), key=lambda r: r.start)
        start = 0
        for r, g in zip(rows, got, strict=True):
            ids = np.array(WORDS.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_token_files_empty(spark, none, tmp_path):
    assert _token_files(spark, none, str(tmp_path / "none")) == []


def test_words_of_any_characters():
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 3000), rng.randrange(0x1E00, 0x2100), 0x301, 0x331]))
    texts = ["it's <|endoftext|> don't İ ΣΑΣ ẞ H̱x", "".join(pick() for _ in range(5000))]
    lengths, ids = simple8b.WordIds(open(P.path("word_bpe_49k.json")).read()).encode(texts, 2, 10**6)
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == WORDS.encode(text, add_special_tokens=False).ids + [2]


def test_query_rows(spark):
    assert catalog.QUERIES["op2_simple8b"](spark, SMALL).count() == catalog.QUERIES["op10_bpe_replay"](spark, SMALL).count() == 200


def test_packing_takes_the_most_codes_that_fit():
    """Against a plain search at every place; few and many places that are too wide."""
    rng = np.random.default_rng(3)
    for k in range(300):
        codes = (rng.integers(0, 1 << int(rng.integers(1, 50)), int(rng.integers(1, 300))) * (rng.random() < 0.9)).astype(np.int64)
        codes[rng.random(len(codes)) < rng.random()] = 1
        words, at, want = simple8b.pack(codes), 0, []
        while at < len(codes):
            want.append(next(s for s, (many, bits) in enumerate(simple8b.SELECTORS) if (codes[at : at + many] < 1 << bits).all()))
            at += simple8b.SELECTORS[want[-1]][0]
        assert (words >> np.uint64(60)).tolist() == want and simple8b.unpack(words, len(codes)).tolist() == codes.tolist()


def test_a_task_encodes_on_its_own_core():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        simple8b.WordIds(file.read())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


class _Recorder:
    """The tokenizer, with the units it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.asked += [w for t in texts for w in t.split(" ")]
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_a_unit_is_encoded_once_whatever_stands_around_it():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = simple8b.WordIds(file.read())
    encoder.tokenizer = recorder = _Recorder(encoder.tokenizer)
    texts = ["Word word, (word) word-word WORD. Grün grün, it's 1212", None, "", "grün. word; 21"]
    lengths, ids = encoder.encode(texts, 2, 10**6)
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == WORDS.encode(text or "", add_special_tokens=False).ids + [2]
    assert sorted(recorder.asked) == sorted(["word", ",", "(", ")", "-", ".", "grün", "it", "'s", "1", "2", ";"])
    encoder.encode(["word (grün)"], 2, 10**6)
    assert len(recorder.asked) == 12


with open(P.path("word_bpe_49k.json"), encoding="utf-8") as _file:
    _ENCODER = simple8b.WordIds(_file.read())


@pytest.mark.parametrize("texts", [[], [None], ["\u0085"], ["\xa0 \u3000", "e\u0301"]])
def test_texts_without_plain_units(texts):
    _ENCODER.clear()
    lengths, ids = _ENCODER.encode(texts, 2, 10**6)
    want = [WORDS.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aHsSTLl19''\"<=.-_ \n\x0b\x00\x1c \u0085̸̱́éßİΣ日²Ⅷ—🙂|>"), max_size=40), max_size=6), st.sampled_from([0, 5, 10**6]))
def test_units_have_the_ids_of_the_whole_text(texts, known):
    for _ in range(2):
        lengths, ids = _ENCODER.encode(texts, 2, known)
        for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
            assert own.tolist() == WORDS.encode(text, add_special_tokens=False).ids + [2]
