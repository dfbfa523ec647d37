"""Mixing, shards, exact groups, secrets and quality against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vecsnap.llm import exact, mixing, quality, secrets, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")
n_words = lambda t: len(WORD.findall(t or ""))


@pytest.fixture(params=["odd", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_mix(docs):
    rows = docs.collect()
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    assert Counter((r["doc_id"], n_words(r["text"])) for r in rows) == Counter((r["doc_id"], r["size"]) for r in mixed)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += n_words(r["text"])
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in above})
        free -= above
    taken = defaultdict(int)
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) == r["copies"]
        taken[r["source"]] += r["taken"]
    for s in names:
        largest = max(n_words(r["text"]) for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(str, mixed)) == Counter(map(str, again))


def test_mix_follows_its_schedule(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("five words in each text").alias("text"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows = mixing.training_order(mixing.mix(docs)).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    falling = [r["position"] for r in rows if r["source"] == "s0"]
    rising = [r["position"] for r in rows if r["source"] == "s2"]
    # Of 1.5 -> 0.5 the first half hands out 62.5 %; the rising shape hands out less than half.
    assert sum(p < 0.5 for p in falling) / len(falling) == pytest.approx(0.625, abs=0.01)
    assert sum(p < 0.5 for p in rising) / len(rising) < 0.45


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards(docs, n):
    rows, out = docs.collect(), sharding.shard(docs, n, pieces=16).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        assert r["law"] == "bytes" and 0 <= r["shard"] < n and r["grown_shard"] is None
        by[r["shard"]].append(r)
    mean, largest = sum(r["size"] for r in out) / n, max(r["size"] for r in out)
    for k in range(n):
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r["size"] for r in by[k]) - mean) <= largest + 0.04 * mean


def test_shard_files(odd, tmp_path):
    sharding.write_shards(sharding.shard(odd, 3, keep=["text"]), str(tmp_path / "shards"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count() and back.select("shard").distinct().count() == 3


@pytest.mark.parametrize("pieces", [1, 40])
def test_exact_groups(docs, pieces):
    rows, out = docs.collect(), exact.exact_groups(docs, pieces).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        text = r["text"] or ""
        ids = [i for i in groups[text] if i is not None]
        assert r["keep_id"] == (max(ids) if ids else None) and r["group_size"] == len(groups[text])
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[text] += 1
    assert kept == Counter(list(groups))


def spans_of(text):
    names = "|".join(secrets.either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = []
    for m in re.finditer(f"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secrets(spark, docs):
    key = "Zx9" + "Qw3rTyUiOp5AsDfGhJk"
    extra = [
        (900, f"é日 password = 'hunter22' token: abc secret=longer_value {key}aB12", "en", "a", 1),
        (901, "AKIA" + "A1B2C3D4E5F6G7H8 deadbeef" + "0123456789abcdef01 api_key:\"" + key, "en", "b", 1),
        (902, "API-KEY=abcdef apikey=abcdef PASSWD : x.y=z+/_- 😀 token=😀 token=secret=abcdefgh", "en", "b", 1),
        (903, " ".join(f"token={i:06d}" for i in range(300)), "en", "b", 1),
        (904, "password=token: abcdefgh AKIA AKIAKIA" + "Z" * 20, "en", "b", 1),
    ]
    extra += [(910 + i, f"sample ghp_{key}0{'a1' * 8}", "en", f"owner{i}", 1) for i in range(5)]
    # One owner, many documents: an example too; a handful of documents is not.
    extra += [(1000 + i, f"copied ghp_{key}3{'c3' * 8}", "en", "one", 1) for i in range(40)]
    extra += [(1100 + i, f"few ghp_{key}4{'d4' * 8}", "en", "one", 1) for i in range(3)]
    extra += [(930, f"mine ghp_{key}1{'b2' * 8}", "en", "one", 1)]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows, out = table.collect(), secrets.scan(table).collect()
    assert len(rows) == len(out)
    want = Counter()
    for r in rows:
        spans = spans_of(r["text"] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        n = Counter(k for _, _, k, _ in spans)
        want[(r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out) == want
    base = {r["doc_id"]: {f"{k}:{a}:{b}" for a, _, k, b in spans_of(r["text"] or "")} for r in rows}
    got = {r["doc_id"]: r for r in out}
    for r in out:
        assert base[r["doc_id"]] <= set(r["spans"].split(","))
    # The copied example is not reported, the one owner's value is.
    assert got[912]["spans"] == "" and got[912]["n_example"] == 1
    assert got[930]["spans"].startswith("token:5:") and got[930]["n_live"] == 1
    for i in range(40):
        assert (got[1000 + i]["spans"], got[1000 + i]["n_owners"], got[1000 + i]["n_repositories"]) == ("", 1, 40)
    assert all(got[1100 + i]["n_live"] == 1 and got[1100 + i]["n_repositories"] == 3 for i in range(3))
    assert (got[912]["n_owners"], got[912]["n_repositories"]) == (5, 5)


def features(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def test_quality(docs):
    rows, out = docs.collect(), quality.judge(docs).collect()
    want, got = Counter(), Counter()
    for r in rows:
        f = features(r["text"] or "")
        want[(r["doc_id"], *f, f[0] < 50 or 100 * f[4] > 50 * f[0])] += 1
    for r in out:
        got[(r["doc_id"], *[r[c] for c in quality.FEATURES], r["base_failed"])] += 1
        assert not (r["kept"] and r["base_failed"])
    assert got == want


def test_quality_labels(spark):
    """Documents labelled good stay, unless the base rules reject them."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    n = Counter((r["quality"], r["kept"]) for r in rows)
    assert n[1, True] / (n[1, True] + n[1, False]) >= 0.98, n
    print(n)


def test_fit_recovers_accuracies():
    import random

    rng, truth = random.Random(1), [0.95, 0.9, 0.8, 0.7, 0.85]
    seen = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        seen[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in truth)] += 1
    prior, accuracy = quality.fit(list(seen.items()), rounds=100)
    assert prior == pytest.approx(0.7, abs=0.03)
    assert accuracy == pytest.approx(truth, abs=0.03)


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.training_order(mixing.mix(empty)).count() == 0
    assert sharding.shard(empty).count() == 0
    assert exact.exact_groups(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert quality.judge(empty).count() == 0


def test_clashing_columns(odd):
    names = ["size", "target", "shard", "kept", "keep_id", "n_words", "spans", "_part"]
    table = odd.select("*", *[F.lit("x").alias(n) for n in names])
    assert mixing.mix(table).count() == odd.count()
    assert sharding.shard(table).count() == odd.count()
    assert exact.exact_groups(table).where("kept").count() == exact.exact_groups(odd).where("kept").count()
    assert secrets.scan(table).count() == odd.count()
    assert quality.judge(table).count() == odd.count()


def test_mixing_exchanges_texts_once(spark):
    """The prefix sums of a source and their offsets use one exchange of the texts, also where the offsets are not broadcast."""
    docs = spark.createDataFrame([(i, f"word {i}", "ab"[i % 2] if i % 5 else None) for i in range(40)], "doc_id long, text string, source string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        mixed = mixing.mix(docs)
        plan = mixed._jdf.queryExecution().executedPlan().treeString()
        at = [line for line in plan.splitlines() if "Exchange" in line]
        # Sides of the join: the texts, and the sums by source and bucket.
        assert len([line for line in at if "hashpartitioning(_s#" in line]) == 2
        assert not [line for line in at if "coalesce(source" in line or "hashpartitioning(source" in line and "text" in line]
        assert sorted(r["doc_id"] for r in mixed.collect()) == list(range(40))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
