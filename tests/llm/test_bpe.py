"""The byte-level BPE codec against the tokenizers library."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecsnap.llm import bpe
from vecsnap.llm.queries import op11_bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts():
    rng = random.Random(8)
    alphabets = ["ab ", "the and of\n", "it's we'll I'd 've", "0123 .,", "éàüß日本語 \x00\t", "aaaa", "   ", "   a\x85　",
                 "<|endoftext|>!", "\r\n\t x", "½²Ⅷ١ 9", "\U00031350\U0001e6c0Ᲊ\U00010d40 a", "-=*# "]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(1500)]
    parts = ["<|endoftext|>", " ", "  ", "a", "!", " !", "'s", "\n", "1", "<|", "|>", "endoftext", " ", "é"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
    return texts + ["a" * 20_000, " " * 9000, "-" * 50_000, "日" * 9000, "!<|endoftext|>" * 3000, "x\n" * 5000]


@pytest.mark.parametrize("chunk_words", [bpe.CHUNK_WORDS, 7])
@pytest.mark.parametrize("table", ["odd", "small", "texts"])
def test_tables(request, spark, library, table, chunk_words):
    if table == "texts":
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd_texts())], "doc_id int, text string, chunk int")
    else:
        docs = request.getfixturevalue(table)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    out = bpe.encode(docs, PATH, chunk_words).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out) == want


def test_decode_of_any_ids(spark, library):
    rng = random.Random(4)
    rows = [(7, [rng.randrange(50_257) for _ in range(rng.randint(0, 9))]) for _ in range(800)] + [(None, None), (8, [])]
    want = Counter((k, library.decode(ids or [], skip_special_tokens=False)) for k, ids in rows)
    out = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == want


def test_query(spark, library, small):
    out = {r["doc_id"]: r for r in op11_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == small.count()
    for r in small.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        got = out[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), digest)
        assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty(empty):
    assert bpe.encode(empty, PATH).count() == 0
