"""GF(2) code words over a DataFrame of messages, and Hamming weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First row of the bordered circulant that generates the [24, 12, 8] code.
CIRCULANT = "11011100010"


def generator_rows() -> list[list[int]]:
    """12 x 24 generator: identity, then left-shifted circulant rows with a parity one.

    The last row borders the circulant with ones and ends in zero.
    """
    first = [int(c) for c in CIRCULANT]
    rows = []
    for i in range(12):
        unit = [int(i == j) for j in range(12)]
        right = first[i:] + first[:i] + [1] if i < 11 else [1] * 11 + [0]
        rows.append(unit + right)
    return rows


def generator_words() -> list[int]:
    """Generator rows as integers, bit ``p`` for coordinate ``p``."""
    return [sum(bit << p for p, bit in enumerate(row)) for row in generator_rows()]


def codeword(message: Column) -> Column:
    """XOR of the generator rows selected by the bits of a 12-bit message."""
    word = F.lit(0)
    for i, row in enumerate(generator_words()):
        picked = F.when(F.shiftright(message, i).bitwiseAND(1) == 1, F.lit(row)).otherwise(F.lit(0))
        word = word.bitwiseXOR(picked)
    return word


def weight(word: Column) -> Column:
    return F.bit_count(word)


def support(word: Column, width: int = 24) -> Column:
    """Positions of the one bits."""
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    return F.filter(positions, lambda p: F.call_function("shiftright", word, p).bitwiseAND(1) == 1)


def messages(df: DataFrame, column: str) -> DataFrame:
    """Add ``word`` and ``weight`` of the low 12 bits of an integer column."""
    low = F.pmod(F.col(column), F.lit(4096)).cast("int")
    return df.withColumn("word", codeword(low)).withColumn("weight", weight(F.col("word")).cast("int"))
