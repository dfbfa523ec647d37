"""Periodic runs of words: Lyndon roots from Baier's grouping, extended to runs.

A run is a maximal stretch of words with a smallest period that it holds several times. Every run
begins, under the order of the words or its reverse, with the longest Lyndon word of one of its
positions. These words come from the first phase of Baier's suffix sorter: groups of suffixes are
visited from the highest down, and the nearest lower suffix to the left of each moves to a group of
its own whose prefix is longer by the visited one. At the end a suffix's group is its longest Lyndon
prefix. Every such root is extended to both sides by the longest common extension, read from exact
names of all stretches of 2^k words.

Before that, words are left out that no run can hold: a run's words stand in short sequences that
recur in the document, and of the rest only its place is kept. The search goes over what is left,
stretch by stretch, however long.

Defined results: a null list of words counts as empty, a null word equals only null words; an empty
document has no runs; repeated rows and null ids get a row each; an empty table gives an empty
result; columns other than ``doc_id`` and ``words`` are ignored. Memory goes with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import cut

# Shortest run, and how often its period must fit into it.
LEAST, TIMES = 6, 4
# Words handled at once in a worker, unless one document has more.
SLICE_WORDS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every position; negative symbols separate sequences.

    Groups form a list from high to low. ``before[i]`` leads to the nearest position left of i
    that has not been visited, with the way shortened at each use.
    """
    n = len(symbols)
    places: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        if s >= 0:
            places.setdefault(s, []).append(i)
    members = [places[s] for s in sorted(places, reverse=True)]
    count = len(members)
    length = [1] * count
    lower = [*range(1, count), -1] if count else []
    upper = list(range(-1, count - 1))
    group = [-1] * n
    for g, ms in enumerate(members):
        for i in ms:
            group[i] = g
    before = list(range(n + 1))  # position i + 1 stands for i; 0 is a wall
    lengths = [0] * n

    def split(g: int, moved: list[int], size: int) -> None:
        """A group right above g for the positions of g that ``size`` more symbols follow."""
        new, above = len(members), upper[g]
        members.append(moved)
        length.append(length[g] + size)
        lower.append(g)
        upper.append(above)
        upper[g] = new
        if above >= 0:
            lower[above] = new
        for p in moved:
            group[p] = new

    g = 0 if count else -1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        members[g] = None
        size = length[g]
        for i in here:
            before[i + 1] = i
            lengths[i] = size
        found: dict[int, int] = {}
        for i in here:
            j = i
            while before[j] != j:
                before[j] = before[before[j]]
                j = before[j]
            if j and symbols[j - 1] >= 0:
                found[j - 1] = found.get(j - 1, 0) + 1
        if len(found) == 1:
            ((p, times),) = found.items()
            split(group[p], [p], size * times)
        elif found:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, times in found.items():
                parts.setdefault((times, group[p]), []).append(p)
            # The more copies follow, the higher: each new group goes right above the old one.
            for times, old in sorted(parts, reverse=True):
                split(old, parts[times, old], size * times)
        g = lower[g]
    return lengths


class Extensions:
    """Longest common extensions of pairs of positions, from names of all stretches of 2^k symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        step = 1
        while step < longest:
            last = self.names[-1].astype(np.int64)
            m = self.n - 2 * step + 1
            if m <= 0:
                break
            pair = last[:m] * (int(last.max()) + 1) + last[step : step + m]
            kinds, names = np.unique(pair, return_inverse=True)
            if len(kinds) == m:
                break
            self.names.append(names.astype(np.int32))
            step *= 2

    def _extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            x, y = (a + out, b + out) if forward else (a - out - step + 1, b - out - step + 1)
            inside = (x >= 0) & (y < len(names))
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
            out += np.where(same, step, 0)
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on (a < b)."""
        return self._extend(a, b, True)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a equal those up to b (a < b)."""
        return self._extend(a, b, False)


def recurring(codes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which positions stand in a sequence of ``width`` codes that their owner has twice or more.

    Sequences are compared by a hash: a clash keeps a position too many and never drops one.
    """
    n = len(codes) - width + 1
    marks = np.zeros(len(codes), dtype=bool)
    if n <= 0:
        return marks
    mixed = owner[:n].astype(np.uint64) * MIX
    for k in range(width):
        mixed = (mixed ^ codes[k : k + n].astype(np.uint64)) * MIX
        mixed ^= mixed >> np.uint64(29)
    within = np.flatnonzero(owner[:n] == owner[width - 1 :])
    ordered = np.sort(mixed[within])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    row = np.minimum(np.searchsorted(twice, mixed[within]), max(0, len(twice) - 1))
    starts = within[twice[row] == mixed[within]] if len(twice) else within[:0]
    for k in range(width):
        marks[starts + k] = True
    return marks


def runs(codes: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows of (start, length, period) of all runs of at least max(least, times * period) codes.

    ``codes`` hold the sequences of all owners one after another; starts count from the first code.
    Rows are sorted by start, then period.
    """
    if least < 2 or times < 2:
        raise ValueError("runs hold two words and two periods at least")
    # A run repeats at its period; this many of its words in a row do, whatever the period.
    width = min(max(least, times * q) - q for q in range(1, least + 1))
    marks = recurring(codes, owner, width)
    at = np.flatnonzero(marks)
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(at):
        return none
    # Stretches of neighbouring positions of one owner; a wall of its own stands before each.
    first = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]
    stretch = np.cumsum(first) - 1
    place = np.arange(len(at)) + stretch + 1
    total = len(at) + stretch[-1] + 2
    symbols = np.full(total, -1, dtype=np.int64)
    symbols[place] = np.unique(codes[at], return_inverse=True)[1]
    origin = np.zeros(total, dtype=np.int64)
    origin[place] = at
    walls = np.flatnonzero(symbols < 0)
    named = symbols.copy()
    named[walls] = -1 - np.arange(len(walls))
    longest = int(np.diff(walls).max())
    extensions = Extensions(named, longest)
    out = []
    top = int(symbols.max())
    for order in (symbols, np.where(symbols < 0, -1, top - symbols)):
        period = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
        i = np.flatnonzero((period > 0) & (period * times <= longest))
        p = period[i]
        i, p = i[i + p < total], p[i + p < total]
        after = extensions.right(i, i + p)
        ahead = extensions.left(i - 1, i + p - 1)
        length = ahead + p + after
        good = length >= np.maximum(least, times * p)
        out.append(np.stack([origin[i - ahead][good], length[good], p[good]], axis=1))
    found = np.unique(np.concatenate(out), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``doc_id`` and ``words``: its runs, and the text of its words without repetitions.

    ``runs``: start (word number), length and period, by start and then period. ``collapsed``: the
    words joined by spaces, without those that a run contains after its first period.
    """
    fields = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("words")).fill_null(0).to_numpy()
            for a, b in cut(sizes, SLICE_WORDS):
                yield part(batch.slice(a, b - a), sizes[a:b])

    def part(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        words = batch.column("words").flatten()
        codes = words.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        found = runs(codes, owner, least, times)
        start, length, period = found.T
        whose = owner[start]
        fields = [pa.array(x) for x in (start - (ends - sizes)[whose], length, period)]
        cuts = np.r_[0, np.cumsum(np.bincount(whose, minlength=len(sizes)))].astype(np.int32)
        rows = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        depth = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        keep = np.cumsum(depth)[:-1] == 0
        counts = np.r_[0, np.cumsum(keep)][np.r_[0, ends]].astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(counts), words.filter(pa.array(keep)).fill_null(""))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), rows), pc.binary_join(kept, " ")],
            ["doc_id", "runs", "collapsed"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "words")
    return rows.mapInArrow(run, fields)


def strongest(runs: str = "runs"):
    """The run with the greatest length / period; ties go to the smallest start, then period.

    The quotients of whole numbers below 10^8 differ as doubles whenever they differ.
    """
    ranked = F.transform(
        runs,
        lambda r: F.struct(
            (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("a"), (-r["period"]).alias("b"), r.alias("run")
        ),
    )
    return F.array_max(ranked)["run"]
