"""Secret scans with corpus-wide ownership of every candidate.

Candidates are matched by pattern; each one's value is hashed, and the hash is counted over all
documents by distinct owner and distinct repository. A value that many owners carry, or few owners in
many repositories each, is a copied example; one of at most ``OWNERS`` owners with at most ``REPOSITORIES``
repositories for each of them is a live credential if it looks random. The
base kinds (assign, access, hex) are always reported; the wider kinds (token, mixed) only where
ownership calls them live.

Defined results: a null text is empty and has no spans; repeated rows get the same result each
and count as one repository; a null owner counts as one owner; an empty table gives an empty
result. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import let, stored, whole


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: kind, pattern, group of the value, fewest characters of the value
BASE = [
    ("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
WIDE = [
    ("token", "(?:gh[opsu]_|xox[abprs]-|sk-|sk_live_|glpat-|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    ("mixed", "[A-Za-z0-9+/_-]{24,}", 0, 24),
]
OWNERS, REPOSITORIES = 2, 5
BLOCK = 64


def matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern as structs; positions in code points from the pieces between them.

    Prefix sums go over blocks of ``BLOCK`` lengths, so texts with very many matches stay cheap.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def located(state: Column) -> Column:
        hits, values, gaps, lengths = (state[c] for c in ("hits", "values", "gaps", "lengths"))
        last = F.floor((F.size(hits) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
        both = F.struct(hits.alias("hits"), values.alias("values"), gaps.alias("gaps"), lengths.alias("lengths"),
                        F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))).alias("before"))

        def at(s: Column) -> Column:
            def one(i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = s["before"][block] + total(F.slice(s["lengths"], block * BLOCK + 1, F.pmod(i, F.lit(BLOCK))))
                start = start + F.length(s["gaps"][i])
                return F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                    (start + F.length(s["hits"][i])).alias("end"), s["values"][i].alias("value"),
                )

            return F.transform(F.sequence(F.lit(0), F.size(s["hits"]) - 1), one)

        return let(both, at)

    state = F.struct(hits.alias("hits"), values.alias("values"), gaps.alias("gaps"), lengths.alias("lengths"))
    found = let(state, located)
    empty = F.lit(None).cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    found = F.when(text.rlike(pattern), found).otherwise(empty)
    kept = F.filter(F.coalesce(found, F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")),
                    lambda x: F.length(x["value"]) >= least)
    return kept


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, sorted by start and then by kind as listed."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    return F.array_join(F.transform(F.sort_array(spans), text), ",")


def random_looking(value: Column) -> Column:
    """Digits, lower-case and capital letters, or long hex with both digits and letters."""
    has = lambda p: value.rlike(p)
    return has("[0-9]") & has("[a-z]") & (has("[A-Z]") | has("^[0-9a-f]+$"))


def scan(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """Per document: counts per base kind, base_sha256, spans, n_live, n_example, n_owners, n_repositories.

    The last two are the largest counts of any value in the document, 0 without one.
    """
    names = ["assign", "access", "hex"]
    text = F.col("_text")
    rows = docs.select(
        "doc_id", F.col(owner).alias("_owner"), F.col(repository).alias("_repository"), whole().alias("_text")
    )
    for rank, (kind, pattern, group, least) in enumerate(BASE + WIDE):
        rows = rows.withColumn(f"_{kind}", matches(text, kind, rank, pattern, group, least))
    base = F.concat(*[F.col(f"_{k}") for k in names])
    overlaps = lambda x, spans: F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn("_base", base).withColumn(
        "_token", F.filter("_token", lambda x: ~overlaps(x, F.col("_base")))
    )
    rows = rows.withColumn(
        "_mixed",
        F.filter(
            "_mixed", lambda x: random_looking(x["value"]) & ~overlaps(x, F.concat(F.col("_base"), F.col("_token")))
        ),
    )
    # Only hashes of the values are written down.
    hashed = lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"),
        F.sha2(x["value"], 256).alias("hash"), random_looking(x["value"]).alias("random"),
    )
    bare = F.transform("_base", lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = rows.select(
        "doc_id", "_owner", "_repository",
        F.md5(F.concat_ws(":", F.col("doc_id"), text)).alias("_row"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in names],
        F.sha2(joined(bare), 256).alias("base_sha256"),
        F.transform(F.concat("_base", "_token", "_mixed"), hashed).alias("_found"),
    )
    found = stored(found, "secrets")

    each = found.where(F.size("_found") > 0).select("_row", "_owner", "_repository", F.explode("_found").alias("x"))
    each = each.select("_row", "_owner", "_repository", "x.*")
    per_owner = each.select("hash", "_owner", "_repository").distinct().groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    ownership = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    few = F.col("n_repositories") <= repositories * F.col("n_owners")
    live = F.col("random") & (F.col("n_owners") <= owners) & few
    judged = each.join(ownership, "hash").withColumn("live", live)
    span = F.struct("start", "rank", "kind", "end")
    shown = (F.col("rank") < len(BASE)) | F.col("live")
    # A text has a bounded number of spans, and equal rows are one group.
    per_row = judged.groupBy("_row").agg(
        F.collect_set(F.when(shown, span)).alias("_spans"),
        F.count_distinct(F.when(F.col("live"), F.struct("start", "rank"))).alias("n_live"),
        F.count_distinct(F.when(~F.col("live"), F.struct("start", "rank"))).alias("n_example"),
        F.max("n_owners").alias("n_owners"),
        F.max("n_repositories").alias("n_repositories"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return found.join(per_row, "_row", "left").select(
        "doc_id", *[f"n_{k}" for k in names], "base_sha256",
        joined(F.coalesce("_spans", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_example", "n_owners", "n_repositories")],
    )
