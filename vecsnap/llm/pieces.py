"""SentencePiece BPE, encoded by vectorised merge rounds, and its decoding.

The text with spaces as the space mark is cut where no merge can reach: before a space mark that
follows another character, and around characters that no longer piece contains. All distinct
words of a batch lie in one flat symbol array; every round finds each word's best-ranked pair by a
segmented minimum, merges its leftmost occurrence in all words at once, compacts, and drops the
words without a pair. One merge per word and round gives the order of the library exactly.

Defined results: a null text is empty; an empty text has only the begin and end ids; repeated
rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import whole

MARK = "▁"
BEGIN, END = 1, 2
# Words beyond this length merge on a heap, one after another; rounds would go over them too often.
LONG_WORD = 200
CACHE_WORDS = 200_000
NO_RANK = np.iinfo(np.int64).max
# Characters of text handled at once in a worker.
SLICE_CHARS = 1_000_000


class Pieces:
    """The tables of one model: symbols, ranked pairs, characters, bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not special[i]}
        reach = {c for p in normal if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses a word boundary")
        self.symbols = list(normal) + sorted(reach - set(normal))
        self.ids = np.array([normal.get(s, -1) for s in self.symbols], dtype=np.int64)
        at = {s: k for k, s in enumerate(self.symbols)}
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = at.get(piece[:cut]), at.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (levels[sp.get_score(i)], at[piece])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        singles = {ord(s): k for s, k in at.items() if len(s) == 1}
        self.points = np.array(sorted(singles), dtype=np.int64)
        self.point_symbols = np.array([singles[c] for c in self.points.tolist()], dtype=np.int64)
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.by_bytes = {i: b for b, i in self.byte_ids.items()}
        self.output = [
            b"" if sp.is_control(i)
            else bytes([self.by_bytes[i]]) if i in self.by_bytes
            else " ⁇ ".encode() if sp.is_unknown(i)
            else names[i].replace(MARK, " ").encode()
            for i in range(n)
        ]
        inner = "".join(re.escape(c) for c in sorted(reach - {MARK}))
        self.split = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]").findall
        self.cache: dict[str, bytes] = {}

    def fallback(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode()]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and its row in the pair table."""
        key = left << 32 | right
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (left >= 0) & (right >= 0) & (self.keys[row] == key)
        return np.where(hit, self.ranks[row], NO_RANK), row

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        out: list[bytes | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if out[i] is None and not 0 < len(w) <= LONG_WORD:
                out[i] = self._pack(self._merge_long(w))
        if not short:
            return out
        points = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[row] == points, self.point_symbols[row], -1 - points)
        owner = np.repeat(np.array(short), [len(words[i]) for i in short])
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            pair = np.zeros(len(symbols), dtype=np.int64)
            rank[:-1], pair[:-1] = self.look_up(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NO_RANK
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            over = best == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                keep = ~over
                symbols, owner, rank, pair, best = (a[keep] for a in (symbols, owner, rank, pair, best))
            at = np.flatnonzero(rank == best)
            if not len(at):
                break
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]  # the leftmost of each word
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        plain = symbols >= 0
        ids = np.where(plain, self.ids[np.where(plain, symbols, 0)], -1)
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ends, known = np.r_[cuts[1:], len(ids)], ids >= 0
        packed, clear = ids.astype("<u4").tobytes(), np.logical_and.reduceat(known, cuts)
        for k, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist())):
            out[owner[a]] = packed[4 * a : 4 * b] if clear[k] else self._pack(symbols[a:b].tolist())
        return out

    def _pack(self, symbols: list[int]) -> bytes:
        ids = []
        for s in symbols:
            if s < 0:
                ids += self.fallback(chr(-1 - s))
            elif self.ids[s] < 0:
                ids += self.fallback(self.symbols[s])
            else:
                ids.append(int(self.ids[s]))
        return np.array(ids, dtype="<u4").tobytes()

    def _merge_long(self, word: str) -> list[int]:
        points = np.array([ord(c) for c in word], dtype=np.int64)
        row = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[row] == points, self.point_symbols[row], -1 - points).tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols) and symbols[a] >= 0 and symbols[b] >= 0:
                key = symbols[a] << 32 | symbols[b]
                if key in self.pairs:
                    heap.append((self.pairs[key][0], a, b, key)) if not heap_ready else heapq.heappush(
                        heap, (self.pairs[key][0], a, b, key)
                    )

        heap_ready = False
        for i in range(len(symbols) - 1):
            push(i, i + 1)
        heapq.heapify(heap)
        heap_ready = True
        alive = [True] * len(symbols)
        while heap:
            _, a, b, key = heapq.heappop(heap)
            if not (alive[a] and b < len(symbols) and alive[b] and after[a] == b) or symbols[a] << 32 | symbols[b] != key:
                continue
            symbols[a], alive[b] = self.pairs[key][1], False
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
                push(a, after[a])
            push(before[a], a)
        return [s for s, live in zip(symbols, alive) if live]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text between the begin and the end id."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        cache.update(zip(new, self.encode_words(new)))
        first, last = (np.array([i], dtype="<u4").tobytes() for i in (BEGIN, END))
        return [b"".join([first, *map(cache.__getitem__, words), last]) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids vanish, byte ids join, one leading space mark goes."""
        numbers = np.frombuffer(ids, dtype="<u4")
        raw = b"".join(map(self.output.__getitem__, numbers.tolist()))
        head = next((i for i in numbers.tolist() if i not in (BEGIN, END)), None)
        spaced = head is not None and head not in self.by_bytes and head != self.unknown and raw[:1] == b" "
        try:
            text = raw.decode()
            inner = numbers[1:-1]
            if not np.isin(inner, (BEGIN, END)).any():
                return text[1:] if spaced else text
        except UnicodeDecodeError:
            pass
        # Control ids end a run of bytes, and every byte outside a valid sequence is replaced on its own.
        cuts = np.flatnonzero(np.isin(numbers, (BEGIN, END)))
        runs = [b"".join(map(self.output.__getitem__, part.tolist())) for part in np.split(numbers, cuts)]
        text = "".join(r.decode(errors="surrogateescape").translate(_REPLACED) for r in runs)
        return text[1:] if spaced else text


_REPLACED = {c: "�" for c in range(0xDC80, 0xDD00)}


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _slices(texts: pd.Series) -> Iterator[list[str]]:
    """Texts in runs of bounded length; one text is never cut."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` on request.

    ``model`` is the path of the model file on the driver; its bytes go to the workers once.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(shared.value)
        for batch in batches:
            done = 0
            for texts in _slices(batch["text"]):
                ids = pieces.encode(texts)
                out = pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[done : done + len(texts)],
                        "n_tokens": [len(x) // 4 for x in ids],
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids],
                    }
                )
                if with_ids:
                    out["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
                done += len(texts)
                yield out

    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInPandas(run, fields + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids give an empty text."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(shared.value)
        for batch in batches:
            texts = ["" if x is None else pieces.decode(np.asarray(x).astype("<u4").tobytes()) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
