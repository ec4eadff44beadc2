"""Each operator against a brute-force statement of its contract, on small tables with nulls, empty and very
long texts, ties, repeated rows, no rows, and extra columns whose names clash with internal ones."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from papertrace.llm import bpe, components, licenses, mixing, neighbors, pii, quality, queries, sharding, simhash, substrings, warc
from papertrace.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, _k string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["tha", "ing", "on", "er", "re", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts():
    a, b = prose(1, 120), prose(2, 90)
    out = [a, a, a.replace("tha", "Tha", 1), b + "\n" + b, a[:300] + " " + b, None, "", " \t\n", "one two", prose(3, 6000), "x" * 5000, "ab " * 60]
    out += [b.upper(), "### *** " * 40 + b, prose(4, 70) + " tel +1 (743) 555-3824 or 4785380592391139, nbii.70@mail8.example.com", "ÀÉ ß\x85x İ Σ ﬁ " * 12, "\n".join([prose(5, 8)] * 9)]
    out += [prose(100 + k, 60) for k in range(10)]
    return out


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", None][i % 2 + i % 5 // 4], 1, 2, "k", "q") for i, t in enumerate(texts())]
    out.append(out[3])  # a repeated row
    out.append((None, texts()[0], None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = queries.word_bpe_path()
    tok = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows())
    for r in got:
        want = tok.encode(r.text or "", add_special_tokens=False)
        assert r.ids == want.ids and r.decoded == tok.decode(want.ids, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    path, r = queries.word_bpe_path(), random.Random(5)
    tok, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    odd = ["<|startoftext|>A<|endoftext|>b", "don't I'LL x's", "a" * 3000, "thething" * 100, "</w>"]
    odd += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0x2100), r.randrange(0x3040, 0x9FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(200)]
    ids, n = own.encode(odd)
    ends = np.cumsum(n)
    for t, a, b in zip(odd, ends - n, ends):
        assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_warc(spark, monkeypatch):
    big, small = "p" * 1500, "s" * 20
    pages = [(1, "http://a/", big), (5, "http://b/\r\nx", big), (3, None, big), (4, "u", small), (6, "u", small), (7, "u", None), (5, "dup", big), (None, "n", big), (8, "é", "é" * 600), (None, None, None)] + [(100 + i, "u", "q" * 1000 + "é\r\n\r\n") for i in range(60)] * 2
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, header string, sha256 string").repartition(3)
    for split in (200, 5):
        monkeypatch.setattr(warc, "SPLIT", split)
        got = warc.read(spark, warc.write(df, scratch(spark)))
        names = ("WARC-Type", "WARC-Refers-To", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI")
        out = got.select("page_id", "payload", "record", "header", *(warc.field(n).alias(n) for n in names)).collect()
        last = lambda p: max(i for i, _, h in pages if i is not None and (h or "") == p)
        want = []
        for i, _, h in pages:
            h = h or ""
            again = len(h.encode()) >= 1000 and i is not None and i != last(h)
            want.append((i, "revisit" if again else "response", last(h) if again else None, h.encode()))
        to = lambda r: int(r["WARC-Refers-To"].split(":")[2]) if r["WARC-Refers-To"] else None
        assert Counter((r.page_id, r["WARC-Type"], to(r), bytes(r.payload)) for r in out) == Counter(want)
        ids = {r["WARC-Record-ID"]: r for r in out}
        assert len(ids) == len(pages)
        for r in out:
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["WARC-Date"]) and "\n" not in (r["WARC-Target-URI"] or "")
            head, body = bytes(r.record).split(b"\r\n\r\n", 1)
            assert head.decode() + "\r\n\r\n" == r.header and body == (b"" if r["WARC-Type"] == "revisit" else bytes(r.payload)) + b"\r\n\r\n"
            if r["WARC-Refers-To"]:
                assert bytes(ids[r["WARC-Refers-To"]].payload) == bytes(r.payload) and ids[r["WARC-Refers-To"]]["WARC-Type"] == "response"
    assert warc.read(spark, warc.write(df.limit(0), scratch(spark))).count() == 0


def fp_of(t, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs, shingle=4).collect()
    assert len(got) == len(rows())
    fps = {(r[0], r[1]): fp_of(r[1], 4) for r in rows()}
    assert Counter(r.fp % (1 << 64) for r in got) == Counter(fps[r[0], r[1]] for r in rows())
    distinct = sorted(set(fps.values()))
    root = union(len(distinct), [(i, j) for i, j in itertools.combinations(range(len(distinct)), 2) if (distinct[i] ^ distinct[j]).bit_count() <= 4])
    comp = {f: root[i] for i, f in enumerate(distinct)}
    low = {}
    for (d, _), f in fps.items():
        if d is not None:
            low[comp[f]] = min(low.get(comp[f], d), d)
    assert all(r.component_id == low[comp[r.fp % (1 << 64)]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed,bits", [(1, 6), (2, 8), (3, 12)])
def test_ball_hashing_misses_no_link(seed, bits):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    f = [base]
    for d in range(1, 7):
        flips = np.zeros(300, dtype=np.uint64)
        for i in range(300):
            flips[i] = np.bitwise_or.reduce(np.uint64(1) << r.choice(64, d, replace=False).astype(np.uint64))
        f.append(base ^ flips)
    f = np.unique(np.concatenate(f))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if (int(f[i]) ^ int(f[j])).bit_count() <= 4]
    trees = [simhash.meet(f, b, bits) for b in range(1 << bits)]
    at = {int(x): i for i, x in enumerate(f)}
    found = [(at[int(a)], at[int(b)]) for x, y in trees for a, b in zip(x, y)]
    assert union(len(f), found) == union(len(f), pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def counts_of(t):
    w, t = words(t), t or ""
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c, cov = Counter(tri), set()
    for k, y in enumerate(tri):
        if c[y] > 1:
            cov |= {k, k + 1, k + 2}
    lines = [y for y in t.split("\n") if WORD.search(y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality(docs, empty):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        n = counts_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_licenses(spark, docs, empty):
    isc = "ISC License\n\nCopyright (c) 2020 Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."
    more = {licenses.digest_of(isc): "ISC"}
    made = [(1, isc.upper().replace("2020 SOMEBODY", "1999-2004 Other")), (2, isc.replace("fee", "a fee")), (3, "Prose.\nReleased under the MIT Licence.\nmore"), (4, None), (5, ""), (6, "Copyright 2020 X"), (7, "licensed under cc by-nc 4.0"), (7, "licensed under cc by-nc 4.0")]
    got = sorted((r.doc_id, r.license, r.notices) for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string").withColumnRenamed("x", "y"), more=more).collect() if r.doc_id != 99)
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7, 7]
    assert got[0][1] == "ISC" and got[1][1] is None and got[2][1:] == (None, "MIT") and got[6][1:] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0")
    assert all(g[1] is None and g[2] is None for g in got[3:6])
    assert licenses.scan(docs).count() == len(rows()) and licenses.scan(empty).count() == 0
    assert all(r.d == licenses.digest_of(r.text) for r in docs.select("text", licenses.F.sha2(licenses.canonical("text"), 256).alias("d")).collect())


def test_pii(spark, docs, empty):
    values = ["4785380592391139", "4111 1111 1111 1111", "378282246310005", "+1 (743) 555-3824", "555-123-4567", "152.143.123.131", "nbii.70@mail8.example.com", "1987-02-28", "03/12/1999", "12/25/1999", "GB82 WEST 1234 5698 7654 32", "a@b.co"]
    bad = ["4785380592391138", "300.1.1.1", "1987-02-30", "GB82 WEST 1234 5698 7654 33", "12345"]
    made = [(1, " x ".join(values)), (2, "y\n".join(v + " " for v in values)), (3, " ".join(bad)), (4, None), (5, ""), (6, "no values"), (7, "1" * 3000 + " " + "a" * 20000 + "@"), (8, "4785380592391139 152.143.123.131")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(made, "doc_id long, text string"), "key", count="n").collect()}
    one, two = got[1].text.split(" x "), [x.strip() for x in got[2].text.split("y\n")]
    assert one == two and got[1].n == len(values) and len(set(one)) == len(values)
    for old, new in zip(values, one):
        assert old != new and (re.sub("[0-9]", "0", re.sub("[a-z]", "a", old)) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", new)) or "." in old or "GB" in old), (old, new)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10
    assert all(luhn(x) == 0 for x in one[:3]) and all(int(o) < 256 for o in one[5].split("."))
    iban = one[10].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[3].text == " ".join(bad) and got[4].text is None and got[5].text == "" and got[6].text == "no values" and got[7].n == 0
    assert got[8].text.split(" ") == [one[0], one[5]]
    other = pii.pseudonymise(spark.createDataFrame(made[:1], "doc_id long, text string"), "another").first().text
    assert not set(other.split(" x ")) & set(one)
    assert pii.pseudonymise(docs, "k").count() == len(rows()) and pii.pseudonymise(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(300).selectExpr("array(id div 100, id div 10 % 10, id % 10) as v")
    from pyspark.sql import functions as F

    out = df.select(pii.feistel(F.col("v"), F.array(F.lit(3), F.lit(10), F.lit(10)), F.struct(*(F.lit(x).alias(n) for n, x in zip(("inner", "outer"), pii.pads("k")))), F.lit("t")).alias("w")).collect()
    assert {tuple(r.w) for r in out} == {(a, b, c) for a in range(3) for b in range(10) for c in range(10)}


def removed(table, span):
    """By doc_id, then start: a window is repeated if its words stand at an earlier place."""
    low = {}
    for d, t in table:
        w = words(t)
        for k in range(len(w) - span + 1):
            x = tuple(w[k : k + span])
            low[x] = min(low.get(x, (d, k)), (d, k))
    out = []
    for d, t in table:
        w = words(t)
        gone = set()
        for k in range(len(w) - span + 1):
            if low[tuple(w[k : k + span])] < (d, k):
                gone |= set(range(k, k + span))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("span,key_segments,shard_words", [(20, 20_000, 1_000_000), (20, 2, 500), (4, 3, 300), (2, 20_000, 100)])
def test_substrings(docs, empty, span, key_segments, shard_words):
    got = substrings.deduplicate(docs, span=span, key_segments=key_segments, shard_words=shard_words).collect()
    null = -(1 << 63)
    want = removed([(null if r[0] is None else r[0], r[1]) for r in rows()], span)
    assert Counter((null if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter(want)
    assert any(w[2] for w in want)
    assert substrings.deduplicate(empty, span=span).count() == 0


def test_fm_index_counts():
    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(1, 5, 400), [0], r.integers(1, 5, 300), [0]])
    fm = substrings.FmIndex(text, 19)
    s = text.tolist()
    for n in (1, 2, 5, 9):
        for k in range(0, 300, 17):
            p = s[k : k + n]
            lo, hi = np.array([0]), np.array([len(s)])
            for c in reversed(p):
                lo, hi = fm.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum(s[i : i + n] == p for i in range(len(s) - n + 1))


def test_sharding(docs, empty):
    got = sharding.shards(docs, count=5).collect()
    import zlib

    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert set(by) <= set(range(5)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert all(abs(sum(r.size for r in x) - total / 5) <= largest for x in by.values())
    places = [r.curve for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert places == sorted(places)
    assert sharding.shards(empty).count() == 0


def test_hilbert_is_a_curve(spark):
    from pyspark.sql import functions as F

    df = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    at = {r.h: (r.x, r.y, r.z) for r in df.withColumn("h", sharding.hilbert([F.col("x"), F.col("y"), F.col("z")], 3)).collect()}
    assert set(at) == set(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))


def sainte_lague(t, n):
    got = dict.fromkeys(t, 0)
    for _ in range(n):
        got[max(t, key=lambda s: (t[s] / (2 * got[s] + 1), -list(t).index(s)))] += 1
    return got


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight, fixed = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}, {}
    while True:
        left = [s for s in order if s not in fixed]
        level = (sum(size.values()) - sum(fixed.values())) / sum(weight[s] for s in left) if left else 0
        over = {s: 3 * size[s] for s in left if level * weight[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        assert target[s] == pytest.approx(fixed.get(s, level * weight[s]))
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(empty).count() == 0
    out = mixing.materialise(docs)
    assert out.columns == docs.columns


def test_quotas(spark):
    t = {"a": 100.0, "b": 260.0, "c": 33.0, "d": 7.0, "e": 400.0}
    df = spark.createDataFrame([(s, 10_000, x * 32) for s, x in t.items()], "source string, source_size long, target double")
    got = Counter()
    for r in mixing.quotas(df, shards=5).orderBy("shard").collect():
        got[r.shard, r.source] = r.quota
    for i in range(1, 6):
        upto = {s: sum(got[k, s] for k in range(i)) for s in t}
        assert upto == sainte_lague(t, round(800 * i / 5))


def test_neighbors(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 16))
    out, i = [], 0
    for c in range(40):
        for _ in range(60 if c == 0 else int(r.integers(1, 8))):
            out.append((i, (centres[c] + r.normal(size=16) * 0.05).astype(np.float32).tolist(), int(c % 2), "x"))
            i += 1
    out += [(i, None, 0, "x"), (i + 1, [0.0] * 16, 0, "x"), (i + 2, [float("nan")] * 16, 0, "x"), (i + 3, [], 1, "x"), (i + 4, out[0][1], None, "x"), (i + 5, out[0][1][:3], 0, "x"), (i + 6, [None] + out[0][1][1:], 0, "x"), (2, out[2][1], 0, "x"), (None, out[0][1], 0, "x")]
    df = spark.createDataFrame(out, "vec_id long, embedding array<float>, label int, rid string")
    got = neighbors.linked(df).collect()
    assert len(got) == len(out)
    good = [k for k, (_, v, l, _) in enumerate(out) if l is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([out[k][1] for k in good], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([out[k][2] for k in good])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    n = Counter()
    want = []
    for k, m in zip(good, link.sum(1)):
        n[k] = int(m)
    root = union(len(out), [(good[a], good[b]) for a, b in np.argwhere(link) if a < b])
    low = {}
    for k, (d, *_) in enumerate(out):
        if d is not None:
            low[root[k]] = min(low.get(root[k], d), d)
    for k, (d, *_) in enumerate(out):
        c = low.get(root[k])
        want.append((d, n[k], c, d is not None and d == c))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert neighbors.linked(spark.createDataFrame([], df.schema)).count() == 0


def test_graph_recall():
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(150, 24)), 20, axis=0) + r.normal(size=(3000, 24)) * 0.06
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = neighbors.Graph(x)
    truth = (x[:400].astype(np.float32) @ x.T.astype(np.float32)) >= 0.98
    q, n = g.links(x[:400].astype(np.float32), 0.98, neighbors.BEAM)
    hit = np.zeros(truth.shape, dtype=bool)
    hit[q, n] = True
    assert (hit & truth).sum() >= 0.95 * truth.sum()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    df = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for name, f in c.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        docs = out.cache()
        if name == "quality_rules":
            assert docs.count() == quality.judge(df).where("kept").count()
        if name == "near_duplicates":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "personal_data":
            assert docs.where("text like '%4785380592391139%' or text like '%mail8.example.com%nbii%'").count() == 0
    got = c.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_bpe_path())
    want = [tuple(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()]
    assert Counter(tuple(r.ids) for r in got) == Counter(want)
    assert hashlib.sha256(b"").hexdigest()
