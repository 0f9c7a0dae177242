"""Sharding, exact and near dedup against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, fuse, minhash, sharding
from sparkloom.llm.common import shared_dir
from tests.conftest import SF

DOC = "doc_id long, text string"


def words(rng, n, vocab=5000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


# --------------------------------------------------------------------- sharding
def brute_shard(key, shards):
    def score(n, w):
        h = int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:13], 16)
        return -w / math.log((h + 0.5) / 2**52)

    return max(sorted(shards), key=lambda n: score(n, shards[n]))


def test_shards_match_brute_force_and_move_little(spark):
    df = sharding.assign_shards(spark.range(3000).withColumnRenamed("id", "k"), "k", sharding.SHARDS)
    got = {r["k"]: r["shard"] for r in df.collect()}
    assert all(got[k] == brute_shard(k, sharding.SHARDS) for k in range(0, 3000, 7))
    bigger = {r["k"]: r["shard"] for r in sharding.assign_shards(spark.range(3000).withColumnRenamed("id", "k"), "k", {**sharding.SHARDS, "new": 1.0}).collect()}
    moved = [k for k in got if got[k] != bigger[k]]
    assert all(bigger[k] == "new" for k in moved) and len(moved) < 3000 / 17 * 1.6
    fewer = {n: w for n, w in sharding.SHARDS.items() if n != "shard-07"}
    less = {r["k"]: r["shard"] for r in sharding.assign_shards(spark.range(3000).withColumnRenamed("id", "k"), "k", fewer).collect()}
    assert all(got[k] == "shard-07" for k in got if got[k] != less[k])
    sizes = Counter(got.values())
    assert sizes["shard-05"] > 2 * sizes["shard-00"]  # weights 2.0 and 0.5


def test_shard_edges(spark):
    df = spark.createDataFrame([(None, "a", "old"), (None, "b", "old"), (1, "", None), (1, None, None)], "k long, text string, Shard string")
    rows = sharding.assign_shards(df, "k", sharding.SHARDS, "shard").collect()
    assert rows[0]["shard"] == rows[1]["shard"] == brute_shard("\\N", sharding.SHARDS) and rows[2]["shard"] == rows[3]["shard"]
    assert sharding.assign_shards(df, "k", sharding.SHARDS, "shard").columns == ["k", "text", "shard"]
    assert sharding.assign_shards(df.limit(0), "k", sharding.SHARDS).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), {"a": 0.0})


# ---------------------------------------------------------------- binary fuse
@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**62), 2**62, n)
    blob = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.contains(blob, keys).all()
    other = rng.integers(-(2**62), 2**62, 20_000)
    assert fuse.contains(blob, other).mean() < 0.01
    if n >= 50_000:
        assert len(blob) < 1.25 * n


# ------------------------------------------------------------------ exact dedup
def brute_copies(rows, generations=4):
    gen = lambda i: generations - 1 if i is None else i % generations
    by = defaultdict(list)
    for i, t in rows:
        if t is not None:
            by[t].append((gen(i), i is None, i if i is not None else 0, i))
    out = []
    for group in by.values():
        group.sort(key=lambda x: x[:3])
        out += [(g[3], group[0][3], "snapshot" if group[0][0] < g[0] else "batch") for g in group[1:]]
    return sorted(out, key=repr)


def sample_rows():
    rng = random.Random(5)
    pool = ["", "a", "A", "naïve", "x" * 200_000, "x" * 200_001, "two\nlines", " a"] + [" ".join(words(rng, 12)) for _ in range(60)]
    rows = [(i, rng.choice(pool)) for i in range(400)] + [(i, None) for i in range(400, 405)] + [(7, "a"), (7, "a"), (7, "b"), (None, "a"), (None, "a"), (None, None)]
    rng.shuffle(rows)
    return rows


def test_exact_copies_match_brute_force(spark):
    rows = sample_rows()
    got = [tuple(r) for r in exact_dedup.exact_copies(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=repr) == brute_copies(rows)


def test_exact_copies_with_small_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 10)
    rows = sample_rows()
    got = [tuple(r) for r in exact_dedup.exact_copies(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=repr) == brute_copies(rows)


def test_drop_exact_copies(spark):
    rows = [(i, t, "src", "d") for i, t in sample_rows()]
    df = spark.createDataFrame(rows, DOC + ", gen string, digest string")
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    texts = Counter(t for _, t in kept)
    assert {t for _, t, *_ in rows} == set(texts) and all(n == 1 for t, n in texts.items() if t is not None)
    assert texts[None] == sum(t is None for _, t, *_ in rows)
    first = {}
    for i, t, *_ in rows:
        rank = ((3 if i is None else i % 4), i is None, i or 0)
        if t is not None and (t not in first or rank < first[t][0]):
            first[t] = (rank, i)
    assert all(first[t][1] == i for i, t in kept if t is not None)
    assert exact_dedup.exact_copies(df.limit(0)).count() == 0 and exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


# ------------------------------------------------------------------- components
def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(i, i - 1) for i in range(1, 40)] + [(1000 + i, 1000) for i in range(1, 300)]  # a chain and a star
    pairs += [tuple(sorted((rng.randrange(2000, 2300), rng.randrange(2000, 2300)), reverse=True)) for _ in range(250)]
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    got = {r[0]: r[1] for r in minhash.components(spark.createDataFrame(pairs, "u long, v long"), shared_dir(spark)).collect()}
    assert got == union_find(pairs)


# --------------------------------------------------------------------- near dedup
def shingle_set(text, k=minhash.SHINGLE):
    w = minhash._WORD.findall(text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_estimates_follow_jaccard():
    rng = random.Random(1)
    a, b = minhash.coefficients()
    base = words(rng, 300)
    for share in (0.02, 0.05, 0.1, 0.3):
        other = [w if rng.random() > share else f"z{rng.random()}" for w in base]
        sets = [minhash.shingles(" ".join(base)), minhash.shingles(" ".join(other))]
        m = minhash.signatures(sets, a, b).astype(np.uint8)
        true = jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other)))
        assert abs(minhash.estimate(m[0], m[1:])[0] - true) < 0.15
    long = minhash.shingles(" ".join(words(rng, 100_000)))
    one = minhash.signatures([long], a, b)[0]
    assert len(one) == minhash.K and one[0] == min((int(x) * int(a[0]) + int(b[0])) % 2**64 for x in long) >> 32


def test_near_groups_against_brute_force(spark):
    """Recall over all pairs of the documents table, and no group that similarity does not explain."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = {r[0]: shingle_set(r[1]) for r in df.collect()}
    inv = defaultdict(list)
    for i, s in docs.items():
        for g in s:
            inv[g].append(i)
    common = Counter()
    for ids in inv.values():
        for x in range(len(ids)):
            for y in range(x):
                common[(ids[y], ids[x])] += 1
    sim = {p: n / (len(docs[p[0]]) + len(docs[p[1]]) - n) for p, n in common.items()}
    near = [p for p, s in sim.items() if s >= minhash.SIMILARITY]
    group = {r["doc_id"]: r["group_id"] for r in minhash.near_groups(df).collect()}
    found = sum(group.get(a, a) == group.get(b, -b) for a, b in near)
    assert near and found >= 0.95 * len(near)
    loose = union_find([p for p, s in sim.items() if s >= 0.35])
    assert all(loose[d] == loose[g] for d, g in group.items() if d != g)


def test_near_groups_edges(spark):
    rng = random.Random(2)
    base = words(rng, 200)
    hot = []
    for i in range(300):  # many slightly different copies share all buckets
        w = list(base)
        w[rng.randrange(200)] = f"q{i}"
        hot.append((10_000 + i, " ".join(w)))
    lone = [(i, " ".join(words(rng, 30, 10**9))) for i in range(200)]
    rows = hot + lone + [(500, "hi"), (501, "HI!"), (502, ""), (503, "   "), (504, None), (None, " ".join(base)), (505, "..."), (506, "..."), (507, hot[0][1]), (507, "other text of the same id")]
    df = spark.createDataFrame(rows, DOC).withColumn("sig", F.lit(1)).withColumn("group_id", F.lit("x"))
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in minhash.near_groups(df).collect()}
    want = {i for i, _ in hot} | {507}
    assert {d for d, (g, _) in got.items() if g == 507} == want and got[507][1]
    assert got[501] == (500, False) and set(got) == want | {500, 501}
    out = minhash.drop_near_copies(df)
    assert out.columns == df.columns and out.count() == len(rows) - len(hot) - 1
    assert minhash.near_groups(df.limit(0)).count() == 0


def test_near_dedup_survives_small_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_MEMBERS", 5)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    small = {tuple(r) for r in minhash.near_groups(df).collect()}
    monkeypatch.undo()
    assert small == {tuple(r) for r in minhash.near_groups(df).collect()}


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    """Documents that share one bucket: chains, stars and strangers; split into blocks they are connected as by comparing all pairs."""
    rng = np.random.default_rng(4)
    sigs = rng.integers(0, 256, (400, minhash.K), dtype=np.uint8)
    for i in range(1, 400):  # each like one before it, or like none
        if rng.random() < 0.7:
            of = rng.integers(max(0, i - 60), i)
            change = rng.choice(minhash.K, rng.integers(10, 75), replace=False)
            sigs[i] = sigs[of]
            sigs[i, change] = rng.integers(0, 256, len(change))
    order = rng.permutation(400)
    near = [(int(order[i]), int(order[j])) for i in range(400) for j in range(i) if minhash.estimate(sigs[i], sigs[j : j + 1])[0] >= minhash.ACCEPT]
    want = union_find(near)
    rep = spark.createDataFrame([(int(order[i]), bytearray(sigs[i].tobytes())) for i in range(400)], "node long, sig binary")
    for block in (7, 50, 150, 1000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        chunks = -(-400 // block)
        sets = [(5, 6, c, chunks, [n for n in range(400) if n % chunks == c]) for c in range(chunks)] + [(8, 8, 0, 1, [1, 2])]
        found = minhash._large(spark.createDataFrame(sets, "b1 long, b2 long, chunk int, chunks int, nodes array<long>"), rep, shared_dir(spark))
        assert (found is None) == (chunks == 1)
        if found:
            pairs = [tuple(r) for r in found.collect()]
            assert all(u > v for u, v in pairs) and union_find(pairs) == want


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    whole = Counter(tuple(r) for r in minhash.near_groups(df).collect())
    monkeypatch.setattr(minhash, "BLOCK", 2)
    assert Counter(tuple(r) for r in minhash.near_groups(df).collect()) == whole


def test_near_copies_that_repeat_an_id(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 100)) for _ in range(3))
    rows = [(0, a), (1, a + " more"), (1, b), (1, c), (2, c + " tail"), (3, b), (3, b), (4, "alone twice"), (4, "alone twice")]
    df = spark.createDataFrame(rows, DOC)
    assert Counter(tuple(r) for r in minhash.near_groups(df).collect()) == Counter([(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (1, 1, True), (3, 1, False), (3, 1, False), (4, 4, True), (4, 4, False)])
    assert Counter(tuple(r) for r in minhash.drop_near_copies(df).collect()) == Counter([(0, a), (1, b), (1, c), (4, "alone twice")])


def test_near_copies_in_scripts_without_spaces():
    rng = random.Random(12)
    for first, last in (("\u4e00", "\u9000"), ("\u0e01", "\u0e2e"), ("\u3041", "\u3090")):
        some = lambda n: [chr(rng.randrange(ord(first), ord(last))) for _ in range(n)]  # noqa: E731, B023
        text = some(1000)
        for k in range(20, 1000, 25):
            text[k] = "。"
        near = [rng.choice(some(9)) if rng.random() < 0.02 else c for c in text]
        a, b, c = (set(minhash.shingles("".join(x)).tolist()) for x in (text, near, some(1000)))
        assert len(a & b) / len(a | b) > 0.7 and len(a & c) / len(a | c) < 0.1


def test_a_million_empty_texts(spark):
    """Rows of one text are never gathered: each comes back on its own."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    out = exact_dedup.exact_copies(df)
    got = out.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("duplicate_of").alias("lo"), F.max("duplicate_of").alias("hi"), F.min("doc_id").alias("first")).first()
    assert tuple(got) == (n - 1, n - 1, 0, 0, 1)
    assert exact_dedup.drop_exact_copies(df).collect() == [(0, "")]
