"""op8's files: the rows with their texts, cut as shards() cuts them, and bounds of each file."""

import glob
import math
import zlib
from collections import Counter

from papertrace.llm import sharding


def test_files_hold_the_texts(spark, tmp_path):
    made = [(None if i % 40 == 7 else i, None if i % 30 == 4 else f"é{i % 5} " * (i % 23 + 1), ["en", "fr", None][i % 3], f"s{i % 4}", f"x{i}", i) for i in range(300)]
    made += [(5, "same " * 20, "en", "s1", "y", 0)] * 60  # fully equal rows over several shards
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, _size string, shard long").repartition(3).cache()
    df, path = df.withColumnRenamed("shard", "extra"), str(tmp_path / "out")
    sharding.write(df, path, count=12)
    got = sharding.read(spark, path, df).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(made)
    want = sharding.shards(df, count=12).collect()
    key = lambda r: (r.doc_id, len((r.text or "").encode()) + 16, r.shard, r.slot)
    assert Counter(map(key, got)) == Counter((r.doc_id, r["size"], r.shard, r.slot) for r in want)
    assert len(glob.glob(f"{path}/rows/*/*.parquet")) == len({r.shard for r in got})
    for b in spark.read.parquet(f"{path}/bounds").collect():
        own = [r for r in got if r.shard == b.shard]
        assert b["rows"] == len(own) and b["bytes"] == sum(key(r)[1] for r in own)
        assert (b.min_lang, b.max_lang) == (min(r.lang for r in own if r.lang) if any(r.lang for r in own) else None, max((r.lang for r in own if r.lang), default=None))
        assert (b.min_size, b.max_size) == (min(key(r)[1] for r in own), max(key(r)[1] for r in own)) and b.min_source == min(r.source for r in own)
    sharding.write(df.limit(0), path + "0")
    assert sharding.read(spark, path + "0", df).count() == 0


def test_against_brute_force(spark):
    """Cells, order along the curve, cuts and slots, stated in Python; only the curve's table of places is taken from
    the operator, and checked to be a curve."""
    from pyspark.sql import functions as F

    n = 1 << sharding.BITS
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), (F.floor(F.col("id") / n) % n).alias("y"), F.floor(F.col("id") / n**2).alias("z"))
    place = {(r.x, r.y, r.z): r.h for r in cells.withColumn("h", sharding.hilbert([F.col("x"), F.col("y"), F.col("z")])).collect()}
    path = sorted(place, key=place.get)
    assert sorted(place.values()) == list(range(n**3)) and all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for a, b in zip(path, path[1:]))
    made = [(None if i % 41 == 7 else i % 380, None if i % 29 == 4 else f"é{i % 6} " * (i * i % 97), ["en", "fr", "de", None][i % 4], f"site{i * 7 % 90:02d}" if i % 13 else None) for i in range(400)]
    made += [(9, "x" * 40_000, "en", "site01"), (9, "", "xx", "site99")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(3)

    def cell(name, names):
        names = sorted({x for x in names if x is not None})
        return 0 if name is None else names.index(name) * n // max(len(names), n)

    rows = []
    for d, t, lang, source in made:
        b = (t or "").encode()
        size = len(b) + 16
        z = max(0, sum(c <= size for c in sharding.SIZES) - 1)
        rows.append((place[cell(lang, [m[2] for m in made]), cell(source, [m[3] for m in made]), z], (d is not None, d or 0), size, zlib.crc32(b)))
    rows.sort()
    total, before, want, at = float(sum(r[2] for r in rows)), 0, [], Counter()
    for curve, d, size, crc in rows:
        shard = min(39, math.floor((before + size / 2) * 40 / total))
        want.append((d[1] if d[0] else None, size, crc, curve, shard, at[shard]))
        at[shard] += 1
        before += size
    assert Counter(tuple(r) for r in sharding.shards(df).collect()) == Counter(want)
