"""Token counts and the SentencePiece codec against the library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vecsnap.llm import pieces, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("table", ["odd", "small"])
def test_tables(request, library, table):
    docs = request.getfixturevalue(table)
    ids, counts = Counter(), Counter()
    for r in docs.collect():
        plain = library.encode(r["text"] or "")
        full = [1, *plain, 2]
        ids[
            r["doc_id"], len(full), hashlib.sha256(np.array(full, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(full).encode()).hexdigest(),
        ] += 1
        counts[r["doc_id"], len((r["text"] or "").encode()), len(plain), len(plain) > 4096] += 1
    out = pieces.encode(docs, MODEL, with_ids=False).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == ids
    out = tokencount.count_tokens(docs, MODEL).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == counts
    out = tokencount.count_tokens(docs, MODEL, sample_docs=0).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == counts


def test_random_texts(library):
    table = pieces.Pieces(open(MODEL, "rb").read())
    lookup = tokencount.Lookup(open(MODEL, "rb").read(), {})
    rng = random.Random(3)
    alphabets = ["ab ", "the and of\n", "▁ a▁", "0123 .,", "éàüß日本語 \x00\t", "aaaa", "   ", "<s></s><unk>", "lo wer new est"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(0, 500))) for _ in range(300)]
    texts += ["a" * 5000, " " * 3000, "▁" * 700, "日" * 900, "https://example.org/" + "x1/" * 200]
    for text, ids in zip(texts, table.encode(texts)):
        want = library.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == [1, *want, 2], repr(text)
        assert table.decode(ids) == library.decode([1, *want, 2]), repr(text)
        assert lookup.count(text) == len(want), repr(text)


def test_decode_of_any_ids(library):
    table = pieces.Pieces(open(MODEL, "rb").read())
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert table.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids), ids


def test_round_trip(small):
    encoded = pieces.encode(small, MODEL)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()}
    assert back == {r["doc_id"]: r["text"] for r in small.collect()}


def test_empty(empty):
    assert pieces.encode(empty, MODEL).count() == 0
    assert tokencount.count_tokens(empty, MODEL).count() == 0
