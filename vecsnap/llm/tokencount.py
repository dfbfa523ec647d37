"""Token counts by a map-side two-tier lookup.

A broadcast table holds the token counts of the most frequent words of a bounded sample of
documents; words outside it go through a bounded cache in each worker, filled by the tokenizer
library. Nothing is shuffled but the sample's word counts. The table only saves time: every word
of every text is counted, whatever the sample held.

Defined results: a null text is empty and has no tokens; repeated rows count alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import uniform, whole
from vecsnap.llm.pieces import MARK, Pieces

# Documents of the sample (about), words of the broadcast table, words of a worker's cache.
SAMPLE_DOCS = 2_000
TABLE_WORDS = 32_768
CACHE_WORDS = 200_000
LONGEST_CACHED = 64
LIMIT = 4096


class Lookup(dict):
    """Token count per word: the broadcast table first, then the worker's own cache."""

    def __init__(self, model: bytes, table: dict[str, int]):
        super().__init__(table)
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.base = len(self.library.encode("\n"))
        self.recent: dict[str, int] = {}
        self.split = Pieces(model).split

    def __missing__(self, word: str) -> int:
        n = self.recent.get(word)
        if n is None:
            # The library puts a space mark before a text; a line break keeps it off a bare word.
            if word[0] == MARK:
                n = len(self.library.encode(word[1:]))
                if word == MARK:
                    n = 1
            else:
                n = len(self.library.encode("\n" + word)) - self.base
            if len(word) <= LONGEST_CACHED:
                if len(self.recent) >= CACHE_WORDS:
                    self.recent.clear()
                self.recent[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(MARK + text.replace(" ", MARK)))) if text else 0


@functools.lru_cache(maxsize=2)
def _lookup(model: bytes, words: str, lengths: bytes) -> Lookup:
    return Lookup(model, dict(zip(words.split(" "), lengths)) if lengths else {})


def frequent(docs: DataFrame, model: bytes, sample_docs: int, table_words: int) -> tuple[str, bytes]:
    """The sample's most frequent words, joined by spaces (no word holds one), and their counts."""
    n = docs.count()
    if not n:
        return "", b""
    sample = docs.where(uniform(F.col("doc_id"), F.col("text")) * n < sample_docs).select(whole().alias("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _lookup(model, "", b"")
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch["text"]:
                seen.update(w for w in lookup.split(MARK + text.replace(" ", MARK)) if len(w) <= LONGEST_CACHED)
            rows = [(w, lookup[w], c) for w, c in seen.items()]
            yield pd.DataFrame(rows, columns=["word", "n", "seen"])

    rows = (
        sample.mapInPandas(run, "word string, n int, seen long")
        .groupBy("word", "n")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "word")
        .limit(table_words)
        .collect()
    )
    rows = [r for r in rows if r["n"] < 256]
    return " ".join(r["word"] for r in rows), bytes(r["n"] for r in rows)


def count_tokens(
    docs: DataFrame,
    model: str,
    limit: int = LIMIT,
    sample_docs: int = SAMPLE_DOCS,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``model``: a file on the driver."""
    with open(model, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, *frequent(docs, content, sample_docs, table_words)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _lookup(*shared.value)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": batch["n_bytes"],
                    "n_tokens": [lookup.count(t) for t in batch["text"]],
                }
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(whole()).cast("long").alias("n_bytes"),
        whole().alias("text"),
    )
    counted = rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
