"""The pipeline's near-duplicates stage against brute force over sets of five-word shingles, and how op3's
fingerprints and the stage's nodes are dealt to buckets."""

import itertools
import random

import numpy as np
import pytest

from papertrace.llm import simhash


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of(table, least=0.8):
    """The doc_ids that stay: the least of each component."""
    sets, p = [grams(t) for _, t in table], list(range(len(table)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in itertools.combinations(range(len(table)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            p[root(i)] = root(j)
    return sorted(min(d for k, (d, _) in enumerate(table) if root(k) == r) for r in {root(i) for i in range(len(table))})


def near_copies():
    r, out = random.Random(8), []
    for _ in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        out.append(base)
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):
            out.append([x if r.random() > share else f"n{r.randrange(5000)}" for x in base])
    table = [" ".join(x) for x in out] + [None, "", " \n", "one two", "One  two", "one two three"]
    r.shuffle(table)
    return list(enumerate(table))


def test_stage_removes_near_copies(spark):
    import corpus_pipeline as c

    table = near_copies()
    docs = spark.createDataFrame([(d, t, "x") for d, t in table], "doc_id long, text string, row string").repartition(3)
    want = kept_of(table)
    out = c.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want and len(want) < 0.6 * len(table)
    assert c.near_duplicates(spark, docs.limit(0), "").count() == 0
    twice = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "row")).unionByName(docs)
    assert sorted(r.doc_id for r in c.near_duplicates(spark, twice, "").collect()) == want


def test_tables_miss_as_few_as_they_say():
    """Pairs of random sets at a similarity of 0.8: those that no table brings together."""
    r, n, missed = np.random.default_rng(5), 3000, 0
    places = simhash.tables(n)
    for k in range(0, n, 500):
        a, b = [], []
        for _ in range(500):
            x = r.integers(0, 1 << 63, 330, dtype=np.uint64)
            a.append(simhash.signature_of(x[:297]))
            b.append(simhash.signature_of(x[33:]))  # 264 of 330 shared
        x = np.unpackbits(np.frombuffer(b"".join(a), np.uint8).reshape(500, -1) ^ np.frombuffer(b"".join(b), np.uint8).reshape(500, -1), axis=1)
        missed += int((np.stack([x[:, p].sum(axis=1) for p in places]) > simhash.NEAR).all(axis=0).sum())
    assert missed <= 2 * simhash.MISSED * n


@pytest.mark.parametrize("bits", [0, 3])
def test_chains_pair_all_that_meet(bits):
    r = np.random.default_rng(6)
    f = np.unique(np.concatenate([x := r.integers(0, 1 << 24, 400, dtype=np.uint64), x ^ np.uint64(1), x ^ np.uint64(5 << 10), x ^ np.uint64(7 << 3)]))
    node = r.permutation(len(f)).astype(np.int64)
    found = set()
    for bucket in range(1 << bits):
        found |= set(zip(*(c.tolist() for c in simhash.chains(node, f, 24, bucket, bits))))
    near = {(max(p, q), min(p, q)) for (p, x), (q, y) in itertools.combinations(zip(node.tolist(), f.tolist()), 2) if (x ^ y).bit_count() <= simhash.NEAR}
    assert found <= near
    def roots(pairs):
        p = list(range(len(f)))
        for a, b in pairs:
            x, y = p[a], p[b]
            if x != y:
                p = [x if k == y else k for k in p]
        return p

    a, b = roots(found), roots(near)
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_parities_bound_the_difference():
    """Sets of any size differ in no fewer hashes than parities, and in just as many where those are few."""
    r = np.random.default_rng(7)
    for n, apart in ((0, 0), (0, 1), (1, 1), (5, 1), (300, 0), (300, 3), (300, 60), (20_000, 5_000)):
        x = np.unique(r.integers(0, 1 << 63, n + apart, dtype=np.uint64))
        a, b = (int.from_bytes(simhash.parities_of(s), "little") for s in (x[:n], x))
        assert (a ^ b).bit_count() <= apart and ((a ^ b).bit_count() == apart or apart > 3)


def written(spark):
    """Bytes of shuffles written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def signed(n, seed):
    """Nodes of random sets, every other one a near copy of that before it."""
    r, out, x = np.random.default_rng(seed), [], None
    for k in range(n):
        x = r.integers(0, 1 << 63, 200, dtype=np.uint64) if k % 2 == 0 else np.concatenate([x[:195], r.integers(0, 1 << 63, 5, dtype=np.uint64)])
        s = np.unique(x)
        words = np.frombuffer(simhash.signature_of(s) + simhash.parities_of(s), ">i8").tolist()[-len(simhash.WORDS) :]
        out.append((k, k, bytearray(simhash.signature_of(s)), bytearray(simhash.parities_of(s, simhash.SHORT)), len(s), *words))
    return out, "node long, root long, sig binary, short binary, size long, " + ", ".join(f"{w} long" for w in simhash.WORDS)


def test_a_node_goes_to_one_bucket_of_each_table(spark):
    """With as many buckets as millions of texts have, few bytes of each travel, and near copies still meet."""
    n = 3_000_000
    nodes = spark.createDataFrame(*signed(300, 9)).repartition(2)
    before = written(spark)
    found = {(max(r), min(r)) for r in simhash.candidates(nodes, n, simhash.tables(n)).collect()}
    assert {(k + 1, k) for k in range(0, 300, 2)} <= found
    assert written(spark) - before < 300 * 20_000


def test_tables_of_millions_miss_as_few_as_they_say():
    """As above, where some bits of a table have to be equal."""
    r, n, places, equal, missed = np.random.default_rng(5), 2000, simhash.tables(3_000_000), simhash.equal_bits(3_000_000), 0
    assert equal > 0
    for _ in range(n):
        x = r.integers(0, 1 << 63, 330, dtype=np.uint64)
        d = np.unpackbits(np.frombuffer(simhash.signature_of(x[:297]), np.uint8) ^ np.frombuffer(simhash.signature_of(x[33:]), np.uint8))
        missed += not any(not d[p[:equal]].any() and d[p[equal:]].sum() <= simhash.NEAR for p in places)
    assert missed <= 2 * simhash.MISSED * n


def test_stage_with_many_buckets(spark, monkeypatch):
    import corpus_pipeline as c

    monkeypatch.setattr(simhash, "TABLE_ROWS", 40)
    table = near_copies()
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect()) == kept_of(table)


@pytest.mark.parametrize("rows", [1_000_000, 1000])
def test_few_bytes_of_a_fingerprint_travel(spark, monkeypatch, rows):
    """With as many buckets as millions of fingerprints have (3 times what a bucket holds), and links as by brute force."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    r = np.random.default_rng(10)
    f = r.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    far = np.array([int(np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 1 + k % 6, replace=False).astype(np.uint64))) for k in range(1500)], dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ far]))
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(2)
    before = written(spark)
    found = {(max(r), min(r)) for r in simhash.links(fps).collect()}
    bytes_ = written(spark) - before
    near = set()
    for k in range(len(f)):
        near |= {(max(x, y), min(x, y)) for y in f[k + 1 :][np.bitwise_count(f[k + 1 :] ^ f[k]) <= 4].view(np.int64).tolist() for x in [int(f[k].view(np.int64))]}
    assert found == near and len(near) > 900  # pairs apart from each other: a forest has them all
    assert bytes_ < len(f) * 1000


@pytest.mark.parametrize("spread", [4, 9])
def test_crossings_are_all_pairs_of_different_roots(spread):
    """Dense groups of fingerprints, equal ones too: no partner is left out for the group's size."""
    r = np.random.default_rng(spread)
    centre = r.integers(0, 1 << 30, 12, dtype=np.uint64)
    f = np.concatenate([centre[k % 12] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, spread, 2, dtype=np.uint64))[None] for k in range(500)])
    node, root = r.permutation(len(f)).astype(np.int64), r.integers(0, 400, len(f))
    a, b = simhash.crossings(node, f, 30, root)
    near = {(max(p, q), min(p, q)) for (p, x, s), (q, y, u) in itertools.combinations(zip(node.tolist(), f.tolist(), root.tolist()), 2) if s != u and (x ^ y).bit_count() <= simhash.NEAR}
    assert set(zip(a.tolist(), b.tolist())) == near and len(a) == len(near)
    odd = simhash.crossings(node, f, 30, root, lambda i, j: (node[i] + node[j]) % 2 == 1)
    assert set(zip(*(c.tolist() for c in odd))) == {(p, q) for p, q in near if (p + q) % 2}


def test_stage_finds_a_partner_among_many(spark, monkeypatch):
    """Texts of a dense group, all of whose fingerprints meet, of which few are similar: each meets all others, not the
    next two in order only."""
    import corpus_pipeline as c

    monkeypatch.setattr(simhash, "signature_of", lambda s: bytes(simhash.SIGNATURE // 8))
    monkeypatch.setattr(simhash, "parities_of", lambda s, many=simhash.PARITIES: bytes(many // 8))
    r = random.Random(11)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(60)]
    table = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(100 + k, " ".join([*t, "more"])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect()) == list(range(60))
