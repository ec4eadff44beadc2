"""Removal of passages that stand earlier in the corpus, by compressed FM-indexes per shard.

Windows of `span` words are cut into segments: runs of windows that share their least gram of GRAM words. Equal windows have equal least
grams, so their segments carry equal keys. A key that occurs once in the corpus can't hold a repeated window;
the segments of all others go to shards by key. A shard indexes its distinct segments (suffix order, BWT,
wavelet matrix) and streams them against the index by backward search. The matching statistic at each word,
held at `span` by dropping the last word where it would exceed it, gives the interval of all places of a
window; the window is repeated if an earlier place is among them.

A key with very many different segments (the rims of a passage that a great part of all documents holds) is
dealt again, by single windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, text_of

SPAN, GRAM = 20, 8
#: Words of a shard's distinct segments, about; distinct segments of a key beyond which it is dealt by windows.
SHARD_WORDS, KEY_SEGMENTS = 1_000_000, 20_000
#: Stored bytes of texts whose keys a bucket counts, about.
BUCKET_BYTES = 8_000_000
#: A segment that makes up more than one in so many is hot; so at most that many are.
HOT = 10_000
_U = np.uint64
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, GRAM, dtype=np.uint64) * _U(2) + _U(1)


def words_of(data: bytes) -> list[bytes]:
    return data.split()  # parts at exactly \x20 and \x09-\x0D


def segments(words: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows) of a text's segments: each run of windows whose leftmost least gram is the same
    one; with that gram's hash as key."""
    n, digest, gram = len(words), xxhash.xxh64_intdigest, min(gram, max(1, span // 2))
    if n < span:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = np.fromiter((digest(w) for w in words), np.uint64, n)
    g = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        g += h[k : n - gram + 1 + k] * _FACTORS[k]
    g ^= g >> _U(29)
    g *= _U(0xBF58476D1CE4E5B9)
    g ^= g >> _U(32)
    width = span - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(n - span + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[start]].view(np.int64), start, np.diff(np.concatenate([start, [len(at)]]))


class FmIndex:
    """An FM-index over a sequence of symbols 1.. with 0 between texts, for patterns of up to `depth` + 1."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = n = len(text)
        rank, k = text.astype(np.int64), 1
        half = 1 << (depth.bit_length() - 1)  # the largest power of two that depth holds
        at_half = rank if half == 1 else None
        while k <= depth + 1:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            _, rank = np.unique(rank * (n + 2 + int(rank.max(initial=0))) + after, return_inverse=True)
            k *= 2
            if k == half:
                at_half = rank
        self.order = np.argsort(rank, kind="stable")
        self.at_half, self.half = at_half, half
        bwt = text[self.order - 1]
        # wavelet matrix: a bit vector per bit of the symbols, with a running count per 64 bits
        self.bits = max(1, int(text.max(initial=1)).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (bwt >> b & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, dtype=bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(1 << self.bits)
        self.first = self._down(symbols, np.zeros(len(symbols), dtype=np.int64))
        count = np.bincount(text, minlength=len(symbols))
        self.before = np.cumsum(count) - count

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word, low = at >> 6, (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & low)
            at = np.where(c >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of c followed by what [lo, hi) stands for."""
        shift = self.before[c] - self.first[c]
        return self._down(c, lo) + shift, self._down(c, hi) + shift

    def groups(self, depth: int) -> np.ndarray:
        """The group number of each place in suffix order: equal where the next `depth` symbols are; half <=
        depth <= 2 half."""
        a = np.full(self.n + depth, -1, dtype=np.int64)
        a[: self.n] = self.at_half
        x, y = a[self.order], a[self.order + depth - self.half]
        return np.cumsum(np.concatenate([[0], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if self.n else np.zeros(0, np.int64)


def repeated(texts: list[list[bytes]], doc: np.ndarray, start: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each distinct segment (words, its first place) whether each of its windows has an earlier place."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code: dict[bytes, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code) + 1) for t in texts for w in t), np.int64, int(size.sum()))
    base = np.cumsum(size + 1) - size  # a 0 before each text
    text = np.zeros(int((size + 1).sum()) + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    text[np.arange(len(flat)) + owner + 1] = flat
    index = FmIndex(text, span - 1)
    # the place of each symbol in the corpus's order
    own = np.full(len(text), -1, dtype=np.int64)
    own[np.arange(len(flat)) + owner + 1] = owner
    off = np.arange(len(text)) - base[np.maximum(own, 0)]
    place = np.empty(len(text), dtype=np.int64)
    key_d, key_s = np.where(own >= 0, doc[np.maximum(own, 0)], np.iinfo(np.int64).max), np.where(own >= 0, start[np.maximum(own, 0)] + off, 0)
    ranked = np.lexsort((key_s, key_d))
    new = np.concatenate([[False], (key_d[ranked][1:] != key_d[ranked][:-1]) | (key_s[ranked][1:] != key_s[ranked][:-1])])
    place[ranked] = np.cumsum(new)
    shorter, full = index.groups(span - 1), index.groups(span)
    lows = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
    highs = np.concatenate([lows[1:], [len(text)]])
    least = np.minimum.reduceat(place[index.order], np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])))
    # all segments in step, from their last word to their first
    out = [np.zeros(max(0, int(s) - span + 1), dtype=bool) for s in size]
    live = np.arange(len(texts))
    lo, hi, depth = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), len(text), dtype=np.int64), 0
    for t in range(int(size.max(initial=0))):
        keep = size[live] > t
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if depth == span:  # drop the last word
            g = shorter[lo]
            lo, hi, depth = lows[g], highs[g], span - 1
        at = base[live] + size[live] - 1 - t
        lo, hi = index.step(text[at], lo, hi)
        depth += 1
        if depth == span:
            many = np.flatnonzero(hi - lo > 1)
            for k in many[least[full[lo[many]]] < place[at[many]]].tolist():
                out[live[k]][size[live[k]] - 1 - t] = True
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.astype(np.int64).tobytes() for a in arrays))


def _unpack(data: bytes, parts: int) -> list[np.ndarray]:
    return np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64), parts)


def stored_bytes(df: DataFrame) -> int:
    """The size of what df reads, as the optimiser knows it from the files; else the bytes of its texts, summed."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 50 else df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def shared_segments(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(rid, key, start, windows) of the segments of docs (rid, text) whose key occurs again.

    Keys travel with their places, packed by task and bucket. A key that a batch of documents holds twice is
    known to be repeated: its places are passed on at once and only one of them goes to its bucket, so a key
    that very many documents hold sends at most a row per batch there. Buckets are as many as the texts need, so
    that what one task counts doesn't grow with them."""
    spark = ready(docs.sparkSession)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(docs) // BUCKET_BYTES))
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("places", pa.binary())])

    def deal(batches):
        for batch in batches:
            keys, starts, windows, owner = [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                k, s, w = segments(words_of(t.as_py()), span)
                keys.append(k)
                starts.append(s)
                windows.append(w)
                owner.append(np.full(len(k), d, dtype=np.int64))
            if not keys:
                continue
            k, s, w, d = (np.concatenate(x).astype(np.int64) for x in (keys, starts, windows, owner))
            _, first, inverse, times = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            alone = np.ones(len(k), dtype=bool)
            alone[again] = False
            alone[first] = True
            to = (k.view(np.uint64) % _U(buckets)).astype(np.int64)
            rows = {"bucket": [], "known": [], "places": []}
            for known, some in ((False, np.flatnonzero(alone & ~again)), (True, np.flatnonzero(alone & again))):
                some = some[np.argsort(to[some], kind="stable")]
                cuts = np.flatnonzero(np.concatenate([[True], to[some][1:] != to[some][:-1]])).tolist() if len(some) else []
                for a, b in zip(cuts, [*cuts[1:], len(some)]):
                    i = some[a:b]
                    rows["bucket"].append(int(to[i[0]]))
                    rows["known"].append(known)
                    rows["places"].append(_pack(d[i], k[i], s[i], w[i]))
            rest = np.flatnonzero(again & ~alone)
            for i in np.array_split(rest, max(1, len(rest) // 20_000)) if len(rest) else []:
                rows["bucket"].append(int(np.bitwise_xor.reduce(d[i]) % buckets))  # anywhere
                rows["known"].append(None)
                rows["places"].append(_pack(d[i], k[i], s[i], w[i]))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def count(t: pa.Table) -> pa.Table:
        known = t.column("known").to_pylist()
        parts = [_unpack(x, 4) for x in t.column("places").to_pylist()]
        through = [p for p, x in zip(parts, known) if x is None]
        here = [(p, x) for p, x in zip(parts, known) if x is not None]
        if here:
            cols = [np.concatenate([p[c] for p, _ in here]) for c in range(4)]
            twice = np.concatenate([np.full(len(p[0]), 1 + x) for p, x in here])
            _, inverse = np.unique(cols[1], return_inverse=True)
            hit = np.bincount(inverse, weights=twice)[inverse] > 1
            through.append([c[hit] for c in cols])
        cols = [np.concatenate([p[c] for p in through]) for c in range(4)]
        return pa.table({"rid": cols[0], "key": cols[1], "start": cols[2], "windows": cols[3]})

    dealt = docs.select("rid", "text").mapInArrow(deal, "bucket int, known boolean, places binary")
    return dealt.groupBy("bucket").applyInArrow(count, "rid long, key long, start long, windows long")


def repeats(docs: DataFrame, span: int = SPAN, key_segments: int = KEY_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(rid, start, windows, mask): segments of docs (rid, doc, text, packed) with a bit for each window that has
    an earlier place. Segments without such a window are left out. rid tells different texts apart, and doc
    orders them."""
    ready(docs.sparkSession)
    if span - min(GRAM, max(1, span // 2)) + 1 > 62:
        raise ValueError("a segment's windows are a mask of 62 bits at most: choose a shorter span, or a longer GRAM")
    places = shared_segments(docs, span).groupBy("rid").agg(F.collect_set(F.struct("key", "start", "windows")).alias("places"))

    schema = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())])

    def fetch(batches):
        unzip, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest
        for batch in batches:
            out = {f.name: [] for f in schema}
            for r, d, data, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = words_of(unzip.decompress(data))
                for p in found:
                    content = b" ".join(words[p["start"] : p["start"] + p["windows"] + span - 1])
                    for name, x in (("rid", r), ("doc", d), ("key", p["key"]), ("start", p["start"]), ("windows", p["windows"]), ("digest", digest(content)), ("content", content)):
                        out[name].append(x)
                if len(out["doc"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out = {f.name: [] for f in schema}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    kinds = "rid long, doc long, key long, start long, windows long, digest binary, content binary"
    held = cut(docs.select("rid", "doc", "packed").join(places, "rid").select("rid", "doc", "packed", "places").mapInArrow(fetch, kinds))
    hot = held.select("key", "digest").distinct().groupBy("key").count().where(F.col("count") > key_segments).select("key")
    hot = cut(hot, 1)
    if hot.limit(1).count():
        pieces = F.split(F.decode("content", "UTF-8"), " ")
        single = held.join(hot, "key", "left_semi").withColumn("_w", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)))
        single = single.withColumn("content", F.encode(F.array_join(F.slice("_w", (F.col("_k") + 1).cast("int"), F.lit(span)), " "), "UTF-8"))
        digest = F.unhex(F.md5("content"))
        single = single.select("rid", "doc", F.xxhash64("content").alias("key"), (F.col("start") + F.col("_k")).alias("start"), F.lit(1).cast("long").alias("windows"), digest.alias("digest"), "content")
        held = cut(held.join(hot, "key", "left_anti").select(single.columns).union(single))
    place = F.struct("doc", "start", "rid")
    distinct = cut(held.groupBy("key", "digest").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.first("windows").alias("windows"), F.first("content").alias("content"), F.count(F.lit(1)).alias("n")))
    size, total = distinct.agg(F.coalesce(F.sum(F.col("windows") + span), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-size // shard_words))

    def search(t: pa.Table) -> pa.Table:
        doc, start = t.column("doc").to_numpy(), t.column("start").to_numpy()
        found = repeated([c.split(b" ") for c in t.column("content").to_pylist()], doc, start, span)
        mask = [int(sum(1 << i for i in np.flatnonzero(f).tolist())) for f in found]
        out = pa.table({"rid": t.column("rid"), "start": start, "windows": t.column("windows"), "mask": pa.array(mask, pa.int64())})
        return out.filter(pa.compute.greater(out.column("mask"), 0))

    by_shard = distinct.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.col("low.rid").alias("rid"), F.col("low.doc").alias("doc"), F.col("low.start").alias("start"), "windows", "content")
    firsts = cut(by_shard.groupBy("shard").applyInArrow(search, "rid long, start long, windows long, mask long"))
    # where a segment as a whole stands earlier, all its windows do; at the first place in a text of another
    # row with the same doc, the same windows do as in the first
    lows, light = distinct.where("low <> high").select("key", "digest", "low", "n"), held.select("rid", "doc", "key", "start", "windows", "digest")
    # the few segments that make up a large part of all are broadcast, at most HOT of them; no other key is hot
    hot, rest = F.broadcast(lows.where(F.col("n") * HOT > total)), lows.where(F.col("n") * HOT <= total)
    others = light.join(hot, ["key", "digest"]).unionByName(light.join(hot, ["key", "digest"], "left_anti").join(rest, ["key", "digest"]))
    others = others.where("rid <> low.rid or start <> low.start or doc <> low.doc")
    others = others.select("rid", "start", "windows", F.col("low.rid").alias("_rid"), ((F.col("doc") == F.col("low.doc")) & (F.col("start") == F.col("low.start"))).alias("_first"))
    later = others.where("not _first").select("rid", "start", "windows", F.expr("shiftleft(1L, cast(windows as int)) - 1").alias("mask"))
    twins = others.where("_first").select("rid", "start", "_rid").join(firsts.withColumnRenamed("rid", "_rid"), ["_rid", "start"])
    return firsts.union(later).union(twins.select("rid", "start", "windows", "mask"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, key_segments: int = KEY_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: the words of the whole text without those that lie in a
    window of `span` words whose sequence also starts earlier, joined by one space.

    Earlier is a smaller doc_id (null before all), or an earlier word of the same document; rows that share a
    doc_id are versions of one document, in which equal starts are equal places, but each text loses its own
    repeated windows only. Texts are told apart by a 64-bit hash of doc_id and text. Windows are judged on the
    input. Null, empty and short texts (below `span` words) lose nothing. No rows, no result; other columns
    are ignored."""
    ready(df.sparkSession)

    @F.arrow_udf("binary")
    def packed(a: pa.Array) -> pa.Array:
        zip_ = zstandard.ZstdCompressor(level=3)
        return pa.array([zip_.compress(x.as_py()) for x in a.cast(pa.binary())], pa.binary())

    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), text_of(text).alias("text")).withColumn("rid", F.xxhash64("doc", "text"))
    found = repeats(rows.select("rid", "doc", "text", packed("text").alias("packed")), span, key_segments, shard_words)
    found = found.groupBy("rid").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    out_schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {f.name: [] for f in out_schema}
            for d, data, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(unzip.decompress(data))
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for p in found or ():
                    for k in range(p["mask"].bit_length()):
                        if p["mask"] >> k & 1:
                            gone[p["start"] + k] += 1
                            gone[p["start"] + k + span] -= 1
                if found:
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                else:
                    kept = words
                out["doc"].append(d)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    light = rows.select("rid", "doc", packed("text").alias("packed")).join(found, "rid", "left").select("doc", "packed", "found")
    done = light.mapInArrow(remove, "doc long, n_words long, n_removed long, kept string")
    kind = df.schema[doc_id].dataType
    return done.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept")


def oracle(table: str = "documents", span: int = SPAN) -> str:
    """DuckDB SQL for op7_substrings: every window of every text by digest."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
win AS (SELECT rid, doc, i, md5(array_to_string(w[i:i + {span - 1}], ' ')) AS h FROM (SELECT rid, doc, w, unnest(range(1, len(w) - {span - 2})) AS i FROM d)),
low AS (SELECT h, min({{'doc': doc, 'i': i}}) AS low FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i FROM win JOIN low USING (h) WHERE doc > low.doc OR doc = low.doc AND i > low.i), (SELECT unnest(range(0, {span})) AS k)),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, count(gone.i) AS n, string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS t FROM word LEFT JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
