"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most RADIUS = 4 bits if and only if some 64-bit value lies within 2 bits of
both. So every distinct fingerprint emits its ball, all 2,081 values within 2 bits; equal values meet in one
task; whoever meets is a pair. The values travel in groups: a linear code gives each value v a bucket H*v, and
since H*(f^e) = H*f ^ H*e, a fingerprint sent to a bucket once (8 bytes) stands for all its values in that
bucket, which the task writes out for itself. Equal values have equal buckets, so none misses another. The
code is the parity of each of m groups of bits, so that a ball's values are in 1 + m + m(m-1)/2 buckets only.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ready, text_of
from .components import components, forest

RADIUS = 4
SEED = 42
#: Fingerprints that a bucket may hold (8 bytes each); from that on there are more buckets.
BUCKET_ROWS = 1_000_000
#: Least number of buckets, as a power of two.
BUCKET_BITS = 6
#: Values that a task compares at once, about.
AT_ONCE = 2_000_000

_rng = np.random.default_rng(20240229)
#: The code: a 32-bit syndrome for each of the 64 bits, all different.
COLUMNS = _rng.choice(np.arange(1, 1 << 31, 65_537, dtype=np.int64), 64, replace=False) * 2_654_435_761 % (1 << 32)
_TABLES = np.zeros((8, 256), dtype=np.int64)
for _k in range(8):
    for _x in range(256):
        for _b in range(8):
            if _x >> _b & 1:
                _TABLES[_k, _x] ^= COLUMNS[8 * _k + _b]
#: The errors of weight 0, 1 and 2, and their syndromes.
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_I, _J = np.triu_indices(64, 1)
ERRORS = np.concatenate([np.zeros(1, np.uint64), _BITS, _BITS[_I] | _BITS[_J]])
SYNDROMES = np.concatenate([np.zeros(1, np.int64), COLUMNS, COLUMNS[_I] ^ COLUMNS[_J]])


def fingerprint_of(data: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the shingles' XXH64."""
    words = data.lower().split()  # A-Z only; parts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        h = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(h, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str | Column = "text", out: str = "fp", shingle: int = 5) -> DataFrame:
    """df with the fingerprint of each whole text as a long (the 64 bits, signed) in `out`.

    Fewer words than a shingle: the whole sequence is the one shingle; none, or null: zero."""
    ready(df.sparkSession)

    @F.arrow_udf(T.LongType())
    def fp(a: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x.as_py(), shingle) for x in a.cast(pa.binary())], dtype=np.uint64).view(np.int64), pa.int64())

    return df.withColumn(out, fp(text_of(text)))


def syndrome(f: np.ndarray) -> np.ndarray:
    s, b = np.zeros(len(f), dtype=np.int64), f.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        s ^= _TABLES[k][b[:, k]]
    return s


def bucket_of(f: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of values: bit k is the parity of every bits-th of the 64 bits, from k on."""
    out = np.zeros(len(f), dtype=np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(f & np.bitwise_or.reduce(_BITS[k::bits])) & 1).astype(np.int64) << k
    return out


def buckets_near(bits: int) -> np.ndarray:
    """What to add to a fingerprint's own bucket for all the buckets of its ball's values."""
    return np.unique(bucket_of(ERRORS, bits))


def deal_out(f: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(bucket, fingerprints) for all buckets that hold a value of a fingerprint's ball."""
    near = buckets_near(bits)
    to, i = (bucket_of(f, bits)[:, None] ^ near[None, :]).ravel(), np.repeat(np.arange(len(f)), len(near))
    order = np.argsort(to, kind="stable")
    to, f = to[order], f[i[order]]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])[: len(to)]).tolist()
    return [(int(to[x]), f[x:y].tobytes()) for x, y in zip(cuts, [*cuts[1:], len(to)])]


def meet(f: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among distinct fingerprints f that show in one bucket, as a spanning forest."""
    own, error = np.sort(bucket_of(f, bits)), bucket_of(ERRORS, bits)
    many = int((np.searchsorted(own, (bucket ^ error) + 1) - np.searchsorted(own, bucket ^ error)).sum())
    sub = math.ceil(math.log2(max(1.0, many / AT_ONCE)))
    # within the bucket, values are told apart by bits of their syndromes
    key = bucket_of(f, bits) << sub | syndrome(f) >> (32 - sub)
    error = error << sub | SYNDROMES >> (32 - sub)
    order = np.argsort(key, kind="stable")
    f, key = f[order], key[order]
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(bucket << sub, (bucket + 1) << sub):
        low, high = np.searchsorted(key, at ^ error), np.searchsorted(key, (at ^ error) + 1)
        some = np.flatnonzero(low < high)
        owner = list(zip(low[some].tolist(), high[some].tolist()))
        if not owner:
            continue
        v = np.concatenate([f[lo:hi] ^ e for (lo, hi), e in zip(owner, ERRORS[some])])
        ranked = np.sort(v)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(again):
            continue
        k = np.searchsorted(again, v)
        k[k == len(again)] = 0
        hit = np.flatnonzero(again[k] == v)
        who = np.concatenate([np.arange(lo, hi) for lo, hi in owner])[hit]
        group = np.lexsort((f[who], k[hit]))
        k, who = k[hit][group], who[group]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        star = who[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        a, b = f[who[~new]], f[star[~new]]
        near = np.bitwise_count(a ^ b) <= RADIUS
        parts.append(forest(a[near], b[near]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints (longs) within RADIUS bits, as spanning forests of the
    buckets: enough for components, without all pairs of a dense group. Nulls take no part."""
    spark = ready(fps.sparkSession)
    fps = cut(fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct())
    n, bits = fps.count(), BUCKET_BITS
    while n * len(buckets_near(bits)) / (1 << bits) > BUCKET_ROWS and bits < 31:
        bits += 1
    schema = pa.schema([("bucket", pa.int64()), ("fps", pa.binary())])

    def deal(batches):
        some, most = [], max(1, AT_ONCE // len(buckets_near(bits)))

        def rows():
            out = deal_out(np.concatenate(some), bits)
            return pa.RecordBatch.from_pydict({"bucket": [r[0] for r in out], "fps": [r[1] for r in out]}, schema=schema)

        for batch in batches:
            some.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, some)) >= most:
                yield rows()
                some.clear()
        if some:
            yield rows()

    def join(t: pa.Table) -> pa.Table:
        f = np.frombuffer(b"".join(t.column("fps").to_pylist()), dtype=np.uint64)
        a, b = meet(f, t.column("bucket")[0].as_py(), bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.mapInArrow(deal, "bucket long, fps binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << min(bits, 16))
    return dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): per row the fingerprint of its whole text and the least doc_id that links
    of at most RADIUS differing bits reach.

    Equal texts (null and empty ones too) share fingerprint zero or another and so a component. Rows with a
    null doc_id keep their component but don't name it (null if no other row does); repeated doc_ids give one
    row each. No rows, no result; other columns are ignored."""
    docs = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), "_t", "fp", shingle).drop("_t"))
    by_fp = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(by_fp))
    placed = by_fp.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return docs.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# -- near copies by similarity ---------------------------------------------------------------------------

#: Least Jaccard similarity of two texts' sets of shingles that makes a link, and the share of pairs at exactly that
#: similarity that the tables may miss.
SIMILAR, MISSED = 0.8, 0.001
#: Bits of a signature; a table takes so many of them as number the texts, and SPARE more; a pair may differ in
#: NEAR of a table's bits.
SIGNATURE, SPARE, NEAR = 256, 10, 4
#: Nodes that a bucket of a table may hold (88 bytes each); where there are more, some bits of a table have to be equal
#: and tell the bucket, so that a node goes to one bucket of each table.
TABLE_ROWS = 500_000
#: Bits of a set's parities, and of the shorter ones that travel to the tables.
PARITIES, SHORT = 1024, 256
#: Tables that are looked at first; what they link needs no more pairs.
FIRST = 2
#: Standard deviations by which the signatures of a similar pair may differ in more bits than on average.
DOUBT = 6.0
#: The columns of a node's parities, 64 bits each.
WORDS = [f"odd{k}" for k in range(PARITIES // 64)]
_U = np.uint64
_FACTORS, _WORDS = (np.random.default_rng(k).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1) for k in (20240301, 20240302))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingles_of(data: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's distinct shingles. Fewer words than a shingle: all of them are the
    one shingle; none: no shingle."""
    words = data.lower().split()  # A-Z only; parts at exactly \x20 and \x09-\x0D
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.zeros(0, np.uint64)
    h, k = np.fromiter((digest(w) for w in words), np.uint64, n), min(n, shingle)
    g = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        g = (g + h[i : n - k + 1 + i]) * _FACTORS[i % len(_FACTORS)]
        g ^= g >> _U(29)
    return np.unique(_mixed(g))


def signature_of(s: np.ndarray) -> bytes:
    """The SimHash of a set of shingle hashes, SIGNATURE bits: a bit is 1 if set in over half of them."""
    ones = np.zeros(SIGNATURE, dtype=np.int64)
    for k in range(0, len(s), 16_384):
        words = np.stack([_mixed(s[k : k + 16_384] ^ w) for w in _WORDS[: SIGNATURE // 64]], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s)).tobytes()


def parities_of(s: np.ndarray, many: int = PARITIES) -> bytes:
    """Bit k tells whether an odd number of a set's hashes are k modulo `many`. Where two sets' bits differ, some
    hash is in one of them only: they differ in no fewer hashes than bits."""
    return np.packbits(np.bincount((s % _U(many)).astype(np.int64), minlength=many) & 1).tobytes()


def differing(similar: float = SIMILAR) -> float:
    """The chance that a signature's bit differs between sets of a Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def equal_bits(n: int) -> int:
    """How many bits of a table have to be equal, for n texts: each halves the nodes of a bucket."""
    return max(0, math.ceil(math.log2(max(n, 1) / TABLE_ROWS)))


def tables(n: int, similar: float = SIMILAR) -> list[np.ndarray]:
    """The bits that each table takes of a signature, for n texts, first those that have to be equal. A pair's D
    differing bits of all are binomial, and those in a table hypergeometric; there are as many tables as miss MISSED
    of the pairs at `similar`."""
    bits, equal, q = max(24, math.ceil(math.log2(max(n, 2))) + SPARE), equal_bits(n), differing(similar)
    share = [math.comb(SIGNATURE, d) * q**d * (1 - q) ** (SIGNATURE - d) for d in range(SIGNATURE + 1)]
    hit = [sum(math.comb(d, k) * math.comb(SIGNATURE - d, bits - k) * math.comb(bits - k, equal) for k in range(NEAR + 1) if k <= d) / (math.comb(SIGNATURE, bits) * math.comb(bits, equal)) for d in range(SIGNATURE + 1)]
    many = 1
    while sum(p * (1 - h) ** many for p, h in zip(share, hit)) > MISSED:
        many += 1 + many // 32
    places = [np.random.default_rng([SEED, bits, t]).choice(SIGNATURE, bits, replace=False) for t in range(many)]
    return [np.concatenate([p[:equal], np.sort(p[equal:])]) for p in places]


def ball(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The errors of up to NEAR / 2 bits in fingerprints of `width` bits, and their syndromes."""
    own = ERRORS >> _U(width) == 0
    return ERRORS[own], SYNDROMES[own]


def shared_values(f: np.ndarray, width: int, bucket: int = 0, bits: int = 0):
    """Each fingerprint of `width` bits emits all values within NEAR / 2 bits. Part by part of those in a bucket,
    (places, values): the places in f that emit a value which another emits too, and that value."""
    error, shift = ball(width)
    sub = max(0, math.ceil(math.log2(max(1.0, len(f) * len(error) / (1 << bits) / AT_ONCE))))
    total = bits + sub
    shift = shift >> (32 - total)
    syn = syndrome(f) >> (32 - total)
    order = np.argsort(syn, kind="stable")
    g, syn = f[order], syn[order]
    for at in range(bucket << sub, (bucket + 1) << sub):
        low, high = np.searchsorted(syn, at ^ shift), np.searchsorted(syn, (at ^ shift) + 1)
        some = np.flatnonzero(low < high)
        spans = list(zip(low[some].tolist(), high[some].tolist()))
        if not spans:
            continue
        v = np.concatenate([g[lo:hi] ^ e for (lo, hi), e in zip(spans, error[some])])
        ranked = np.sort(v)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(again):
            continue
        k = np.minimum(np.searchsorted(again, v), len(again) - 1)
        hit = np.flatnonzero(again[k] == v)
        yield order[np.concatenate([np.arange(lo, hi) for lo, hi in spans])[hit]], v[hit]


def chains(node: np.ndarray, f: np.ndarray, width: int, bucket: int, bits: int, root: np.ndarray | None = None, like=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes whose fingerprints of `width` bits meet in one bucket of a table: of those who share a value, in
    order of nodes, each is paired with the next two. Enough to join most of a group of near copies, without pairs that
    grow with its square, but not all that meet: see crossings(). Nodes of one root need no pair, nor do those for whose
    places in `node` like(i, j) is false."""
    root = node if root is None else root
    out: list[np.ndarray] = []
    for at, v in shared_values(f, width, bucket, bits):
        order = np.lexsort((node[at], v))
        at, v = at[order], v[order]
        of = root[at]
        for d in (1, 2):
            same = (v[d:] == v[:-d]) & (of[d:] != of[:-d])
            met = np.unique(at[d:][same] * np.int64(len(f)) + at[:-d][same])
            x, y = met // len(f), met % len(f)
            if like is not None:
                own = like(x, y)
                x, y = x[own], y[own]
            out.append(np.stack([node[x], node[y]], axis=1))
        if sum(map(len, out)) > AT_ONCE:
            out = [np.unique(np.concatenate(out), axis=0)]
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def ranges(low: np.ndarray, high: np.ndarray):
    """(i, j) for each j from low[i] to before high[i], in parts of AT_ONCE / 4 or one i."""
    many, at = np.maximum(high - low, 0), 0
    done = np.cumsum(many)
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE // 4, side="right")))
        n = many[at:to]
        yield np.repeat(np.arange(at, to), n), np.arange(n.sum()) + np.repeat(low[at:to] - np.cumsum(n) + n, n)
        at = to


def _ends(new: np.ndarray) -> np.ndarray:
    """For each place the end of its run, where new[i] tells that place i + 1 begins another."""
    ends = np.concatenate([np.flatnonzero(new) + 1, [len(new) + 1]])
    return ends[np.searchsorted(ends, np.arange(len(new) + 1), side="right")]


def crossings(node: np.ndarray, f: np.ndarray, width: int, root: np.ndarray, like=None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of nodes of different roots whose fingerprints of `width` bits differ in at most NEAR bits and for whose
    places in `node` like(i, j) is true. Distinct fingerprints meet by values as in chains(), a pair of them at one of
    the values that they share; where a value's fingerprints all have nodes of one root only, no pair is looked at."""
    if not len(f):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((root, f))
    node, f, root = node[by], f[by], root[by]
    start = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1, [len(f)]])
    own, low, high = f[start[:-1]], root[start[:-1]], root[start[1:] - 1]
    # a fingerprint whose nodes have one root is of that; any other is of its own
    _, rank = np.unique(low, return_inverse=True)
    label = np.where(low == high, rank, len(own) + np.arange(len(own)))
    out: list[np.ndarray] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if like is not None and len(i):
            some = like(by[i], by[j])
            i, j = i[some], j[some]
        if len(i):
            out.append(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], axis=1))

    mixed = (low != high)[np.searchsorted(start, np.arange(len(f)), side="right") - 1]
    for i, j in ranges(_ends((f[1:] != f[:-1]) | (root[1:] != root[:-1])), np.where(mixed, _ends(f[1:] != f[:-1]), 0)):
        take(i, j)
    for at, v in shared_values(own, width):
        order = np.lexsort((label[at], v))
        at, v = at[order], v[order]
        new = v[1:] != v[:-1]
        for i, j in ranges(_ends(new | (label[at[1:]] != label[at[:-1]])), _ends(new)):
            x, y = at[i], at[j]
            d = own[x] ^ own[y]
            one = d & (~d + _U(1))
            two = (d ^ one) & (~(d ^ one) + _U(1))
            here = v[i] == np.minimum(own[x], own[y]) ^ np.where(np.bitwise_count(d) > NEAR // 2, one | two, _U(0))
            x, y = x[here], y[here]
            for p, a in ranges(start[x], start[x + 1]):
                for q, b in ranges(start[y[p]], start[y[p] + 1]):
                    take(a[q], b)
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
    return pairs[:, 0], pairs[:, 1]


def taken(sig: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The bits at `place` of each signature, the first as the lowest."""
    out = np.zeros(len(sig), dtype=np.uint64)
    for k, p in enumerate(place.tolist()):
        out |= (sig[:, p >> 3] >> np.uint8(7 - (p & 7)) & 1).astype(np.uint64) << _U(k)
    return out


def candidates(nodes: DataFrame, n: int, places: list[np.ndarray], similar: float = SIMILAR, whole: bool = True) -> DataFrame:
    """(a, b): pairs of the n nodes (node, root, sig, short, size and the words of WORDS) that meet in a table, have
    different roots, whose whole signatures differ in no more bits than those of a similar pair may, and whose
    parities and sizes don't rule out that the sets are similar: all of them, or but those of chains()."""
    spark, equal = ready(nodes.sparkSession), equal_bits(n)
    width = len(places[0]) - equal
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("nodes", "roots", "sigs", "sizes", "odds"))])
    q, bound = differing(similar), (1 - similar) / (1 + similar)
    most = int(SIGNATURE * q + DOUBT * math.sqrt(SIGNATURE * q * (1 - q)))

    def deal(batches):
        for batch in batches:
            node, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(node), -1)
            size = batch.column(3).to_numpy(zero_copy_only=False)
            odd = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(node), -1)
            rows = {name: [] for name in schema.names}
            for t, place in enumerate(places):
                to = taken(sig, place[:equal])
                order = np.argsort(to, kind="stable")
                for i in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                    rows["bucket"].append((t << equal) + int(to[i[0]]))
                    rows["nodes"].append(node[i].tobytes())
                    rows["roots"].append(root[i].tobytes())
                    rows["sigs"].append(sig[i].tobytes())
                    rows["sizes"].append(size[i].tobytes())
                    rows["odds"].append(odd[i].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def join(t: pa.Table) -> pa.Table:
        node, root, sig, size, odd = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("nodes", np.int64), ("roots", np.int64), ("sigs", np.uint8), ("sizes", np.int64), ("odds", np.uint64)))
        sig, odd = sig.reshape(len(node), -1), odd.reshape(len(node), -1)
        f, long = taken(sig, places[t.column("bucket")[0].as_py() >> equal][equal:]), sig.view(np.uint64)

        def like(i, j):
            ok = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), AT_ONCE // 8):
                x, y = i[k : k + AT_ONCE // 8], j[k : k + AT_ONCE // 8]
                unlike = (size[x] + size[y]) * bound + 1e-6
                some = np.flatnonzero(np.abs(size[x] - size[y]) <= unlike)
                x, y, unlike = x[some], y[some], unlike[some]
                own = (np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1) <= unlike) & (np.bitwise_count(long[x] ^ long[y]).sum(axis=1) <= most)
                ok[k + some[own]] = True
            return ok

        a, b = crossings(node, f, width, root, like) if whole else chains(node, f, width, 0, 0, root, like)
        return pa.table({"a": a, "b": b})

    dealt = nodes.select("node", "root", "sig", "size", "short").mapInArrow(deal, ", ".join(f"{c} {'long' if c == 'bucket' else 'binary'}" for c in schema.names))
    parts = min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(places) << equal))
    pairs = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(join, "a long, b long").distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(w).alias(f"{c}_{w}") for w in ("size", *WORDS)))
    apart = reduce(add, (F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS))
    # sets of sizes x and y with s in common differ in x + y - 2s hashes, and s >= similar * (x + y - s) bounds that
    unlike = (F.col("a_size") + F.col("b_size")) * F.lit(bound) + F.lit(1e-6)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= unlike).select("a", "b")


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similar: float = SIMILAR) -> DataFrame:
    """The rows of df of which one stays per component of texts that links of Jaccard similarity `similar` or more
    reach: that with the least doc_id, null after all, once if it is repeated.

    Texts with equal sets of shingles are one node; those without words (null and empty ones too) have the empty set.
    Nodes meet by SimHash as in links(), in tables of a longer signature's bits, as one fingerprint of 64 bits tells
    too little at such a similarity; every pair that the bound of parities_of() leaves is then verified by its whole
    sets, so no link rests on an estimate.
    A pair at `similar` is missed with a chance of MISSED, others with less. Texts of any length are taken whole.
    df's columns come back as they were; no rows, no result."""
    spark = ready(df.sparkSession)

    @F.arrow_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("odd", T.BinaryType()), T.StructField("short", T.BinaryType()), T.StructField("size", T.LongType())]))
    def sketch(a: pa.Array) -> pa.Array:
        sets = [shingles_of(x.as_py(), shingle) for x in a.cast(pa.binary())]
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        bits = [pa.array([of(s) for s in sets], pa.binary()) for of in (signature_of, parities_of, lambda s: parities_of(s, SHORT))]
        return pa.StructArray.from_arrays([pa.array(node), *bits, pa.array([len(s) for s in sets], pa.int64())], names=["node", "sig", "odd", "short", "size"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = rows.withColumn("s", sketch(text_of(F.col("row")[text]))).select("row", F.col("row")[doc_id].alias("id"), "s.node", "s.sig", "s.odd", "s.short", "s.size", F.monotonically_increasing_id().alias("rid"))
    rows = cut(rows)
    words = [F.conv(F.hex(F.substring(w[:3], 8 * int(w[3:]) + 1, 8)), 16, -10).cast("long").alias(w) for w in WORDS]
    nodes = rows.groupBy("node").agg(F.min("rid").alias("rid"), *(F.first(c).alias(c) for c in ("sig", "odd", "short", "size")))
    nodes = cut(nodes.select("node", F.col("node").alias("root"), "rid", "sig", "short", "size", *words))

    def verify(batches):
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(len(a)):
                some = []
                for k, c in ((a[i], 2), (b[i], 3)):
                    if k not in last:
                        if len(last) > 64:
                            last.clear()
                        last[k] = shingles_of(batch.column(c)[i].as_py().encode(), shingle)
                    some.append(last[k])
                x, y = some
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similar * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = rows.select("rid", text_of(F.col("row")[text]).alias("text")).join(nodes.join(asked, "node").select("rid", "node"), "rid").select("node", "text")
        both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")

    # the first tables join most of a group of near copies; then all are asked for all pairs across what is joined
    n = nodes.count()
    places = tables(n, similar)
    joined = cut(components(linked(cut(candidates(nodes, n, places[:FIRST], similar, whole=False)))).select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    across = nodes.drop("root").join(joined.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = joined.unionByName(linked(cut(candidates(cut(across), n, places, similar))))
    placed = rows.select("rid", "id", "node").join(components(links).withColumnRenamed("vertex", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("stays"))
    return rows.join(stay.select(F.col("stays.rid").alias("rid")), "rid", "left_semi").select("row.*")
