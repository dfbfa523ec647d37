"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from vecsnap.llm import periodic
from vecsnap.llm.queries import op12_periodic_runs, planted_periods


def plain_lyndon(word):
    """Longest Lyndon word at every position, by Duval's algorithm on every suffix."""
    out = []
    for i in range(len(word)):
        j, k = i + 1, i
        while j < len(word) and word[k] <= word[j]:
            k = i if word[k] < word[j] else k + 1
            j += 1
        out.append(j - k)
    return out


def plain_runs(word, least=6, times=4):
    """All runs by comparing the word with itself at every distance."""
    found, n = {}, len(word)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text, altered=True):
    """What the query returns, without the library."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if altered and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def random_words(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
    out = []
    while len(out) < 60 and rng.random() < 0.9:
        part = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
        out += part * rng.randint(1, 7)
        out = out[: len(out) - rng.randrange(3)] if rng.random() < 0.4 else out
    return out


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(3000):
        sequences = [random_words(rng) for _ in range(rng.randint(1, 3))]
        flat, want = [-1], [0]
        for s in sequences:
            flat += [*s, -1]
            want += [*plain_lyndon(s), 0]
        assert periodic.lyndon_lengths(flat) == want


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (10, 3)])
def test_runs(least, times):
    rng = random.Random(2)
    for _ in range(1500):
        sequences = [random_words(rng) for _ in range(rng.randint(1, 4))]
        codes = np.array([c for s in sequences for c in s], dtype=np.int64)
        owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        starts = np.cumsum([0] + [len(s) for s in sequences])
        want = [(starts[k] + a, b, c) for k, s in enumerate(sequences) for a, b, c in plain_runs(s, least, times)]
        assert [tuple(r) for r in periodic.runs(codes, owner, least, times).tolist()] == want


def test_long_sequences():
    for word in ([7] * 200_000, [1, 2] * 100_000, list(range(50_000)) * 4 + [3]):
        codes = np.array(word)
        period = len(set(word))
        length = len(word) if period != 50_000 else 200_000
        assert periodic.runs(codes, np.zeros(len(codes), dtype=int)).tolist() == [[0, length, period]]


@pytest.mark.parametrize("table", ["odd", "small", "planted"])
def test_query(request, spark, tmp_path, table):
    if table == "planted":
        rng = random.Random(6)
        rows = [(i % 900, " ".join(f"w{c}" for c in random_words(rng))) for i in range(1200)]
        docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, words string")
    else:
        docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(plain_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect())) == want


def test_null_words(spark, empty):
    rows = [(1, None), (2, []), (3, [None] * 7), (4, ["a", None, "a"])]
    out = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, words array<string>")).collect()
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out}
    assert found == {1: ([], ""), 2: ([], ""), 3: ([(0, 7, 1)], ""), 4: ([], "a  a")}
    assert periodic.find_runs(planted_periods(empty)).count() == 0
