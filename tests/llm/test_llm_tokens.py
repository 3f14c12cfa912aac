"""Token counts and piece encoding against the libraries."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paywright.llm import piece_codec, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = list("abcdeth onirst  \n\n\t\r▁é😀含门Zx9.,'\"0123́▁日本ß\x0b\xa0　I'll<|$") + ["<|endoftext|>", " ", "'s"]


def texts(rnd, n=1500, most=50):
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_prefix_table_gives_the_library_s_ids_and_text(model, library, rnd):
    for text in texts(rnd):
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
        n, joined, back = model.coded(text)
        assert (n, joined, back) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_runs_of_blanks(model, library):
    for k in range(90):
        for tail in ("", "the", "含", "\n", "."):
            assert model.encode(" " * k + tail) == library.encode(" " * k + tail)


def test_a_forgotten_unit_is_encoded_again(library, rnd):
    small = piece_codec.PieceModel(PIECES)
    small.memo.entries = 5
    piece_codec.PAIRS, kept = 10, piece_codec.PAIRS
    try:
        for text in texts(rnd, 200):
            assert small.coded(text)[1] == ",".join(map(str, library.encode(text)))
    finally:
        piece_codec.PAIRS = kept


def test_long_text(model, library, rnd):
    text = "".join(rnd.choice("abcdeinortsu含é") for _ in range(60_000)) + " x" * 5000
    assert model.encode(text) == library.encode(text)


def test_code_digests(docs_of, library):
    rows = [(1, "The thing"), (1, "The thing"), (None, "a  b"), (2, None), (3, "")]
    got = sorted(map(tuple, piece_codec.code_digests(docs_of(rows), PIECES).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = {r[0]: (r[1], r[2]) for r in piece_codec.encode(docs_of([(7, "éa b")]), PIECES).collect()}
    assert full == {7: (library.encode("éa b"), "éa b")}
    assert piece_codec.code_digests(docs_of(rows).limit(0), PIECES).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(name, rnd):
    path = public_tokenizers.path(name)
    some = texts(rnd)
    if name.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some)]
    else:
        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    assert token_counts.Counter(path).count(some) == want


def test_counts_with_little_memory(rnd):
    counter = token_counts.Counter(BPE)
    counter.memo.entries = 5
    some = texts(rnd, 300) + ["x" * 300_000, "ab " * 100_000]
    assert counter.count(some) == [len(x) for x in Tokenizer.from_file(BPE).encode_batch(some, add_special_tokens=False)]


def test_token_counts_frame(docs_of):
    rows = [(1, "é the"), (1, "é the"), (None, "x"), (2, None), (3, ""), (4, "a " * 2000)]
    got = sorted(map(tuple, token_counts.token_counts(docs_of(rows), BPE).collect()), key=str)
    tokenizer = Tokenizer.from_file(BPE)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs_of(rows).limit(0), BPE).count() == 0
