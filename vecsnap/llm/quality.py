"""Quality rules under weak supervision.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns (at most 3 to the power of the number of rules) estimates each rule's accuracy and
the share of good documents; a document's posterior replaces "all rules must pass".

Model: a rule that votes is right with its own accuracy, rules err independently, abstaining says
nothing. Accuracies stay between ``ACCURACY`` bounds, which also fixes which class is the good one.

Defined results: a null text has no words and fails; an empty table gives an empty result;
repeated rows count as often as they occur. Columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import WORD, let, stored, whole, words

ROUNDS = 30
ACCURACY = (0.55, 0.995)
PRIOR = (0.5, 0.99)
THRESHOLD = 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(docs: DataFrame) -> DataFrame:
    """Add the counts the rules read; windows of three words are compared by a 64-bit hash."""
    text = F.col("_text")
    rows = docs.drop(*[c for c in docs.columns if c in {*FEATURES, "n_lines", "n_stops"}]).withColumn("_text", whole())
    rows = rows.withColumn("_words", words(text)).withColumn("n_words", F.size("_words").cast("long"))
    rows = (
        rows.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
        .withColumn("n_repeat_words", repeat_words(F.col("_words")))
    )
    return rows.drop("_text", "_words", "_lines")


def repeat_words(all_words: Column) -> Column:
    """Words covered by three-word windows that occur more than once.

    Windows sorted by hash have their equals next to them; sorted by place again, each hit covers
    three words, less what the next hit covers too.
    """

    def windows(w: Column) -> Column:
        one = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
        every = F.transform(F.sequence(F.lit(0), F.size(w) - 3), one)
        return F.when(F.size(w) >= 4, F.sort_array(every))

    def hits(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, n: a + n)

    count = let(all_words, lambda w: let(windows(w), lambda s: let(hits(s), covered)))
    return F.coalesce(count, F.lit(0)).cast("long")


def vote(value: Column, bad: Column, good: Column) -> Column:
    """-1, 1 or 0; a document without words has no value and abstains."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, each on one property of the text as a whole."""
    per_word = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words"))
    length, n, symbols, repeats = per_word("word_chars"), F.col("n_words"), per_word("n_symbols"), per_word("n_repeat_words")
    copies = F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines"))
    return {
        "long_enough": vote(n, n < 50, n >= 80),
        "word_length": vote(length, (length < 2.5) | (length > 12), length.between(3.5, 9)),
        "few_symbols": vote(symbols, symbols > 0.1, symbols < 0.03),
        "few_copied_lines": vote(copies, copies > 0.3, copies < 0.1),
        "few_repeats": vote(repeats, repeats > 0.3, repeats < 0.15),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Prior of good and accuracy per rule from (votes, count) pairs."""
    width = len(patterns[0][0]) if patterns else 0
    prior, accuracy = 0.8, [0.8] * width
    for _ in range(rounds):
        good, right, cast = 0.0, [0.0] * width, [0.0] * width
        for votes, n in patterns:
            p = posterior(votes, prior, accuracy)
            good += n * p
            for i, v in enumerate(votes):
                if v:
                    right[i] += n * (p if v > 0 else 1 - p)
                    cast[i] += n
        total = sum(n for _, n in patterns)
        clamp = lambda x, lo, hi: min(hi, max(lo, x))
        prior = clamp(good / total, *PRIOR) if total else prior
        accuracy = [clamp(r / c, *ACCURACY) if c else a for r, c, a in zip(right, cast, accuracy)]
    return prior, accuracy


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    logit = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))
    return 1 / (1 + math.exp(-logit))


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the features, base_failed, p_good and kept."""
    outputs = {"base_failed", "kept", "p_good", "text"} if not keep_text else {"base_failed", "kept", "p_good"}
    rows = with_features(docs).drop(*[c for c in docs.columns if c in outputs])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = list(rules())
    voted = rows.withColumn("base_failed", failed).withColumns({f"_v_{k}": v for k, v in rules().items()})
    votes = [F.col(f"_v_{k}") for k in names]
    if not keep_text:
        voted = stored(voted, "quality-votes")
    counts = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    prior, accuracy = fit([(tuple(r)[:-1], r["n"]) for r in counts])
    logit = F.lit(math.log(prior / (1 - prior)))
    for v, a in zip(votes, accuracy):
        logit = logit + v * F.lit(math.log(a / (1 - a)))
    good = 1 / (1 + F.exp(-logit))
    return (
        voted.withColumn("p_good", F.round(good, 9))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD))
        .drop(*[f"_v_{k}" for k in names], "n_lines")
    )
