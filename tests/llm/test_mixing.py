"""op9: the mix takes from every row what it counts, shard by shard; the permutation is one."""

from collections import Counter

from pyspark.sql import functions as F

from papertrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, upto string, rid string"


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n))


def table(spark):
    made = [(i, words(20 + i * 7 % 300, f"d{i}w"), f"s{i % 5}" if i % 11 else None) for i in range(120)]
    made += [(3, words(41, "d3w"), "s3"), (3, words(41, "d3w"), "s0"), (3, words(41, "d3w"), "s0"), (None, words(70, "n"), "s1"), (None, words(50, "m"), "s1"), (500, None, "s1"), (501, "", "s2"), (502, " \n", "none"), (503, words(6000, "long"), "s4")]
    made += [(7, words(90, "same"), "s2")] * 40
    return spark.createDataFrame([(*m, 1, "u", "r") for m in made], SCHEMA).repartition(4).cache()


def test_materialise_equals_mix(spark):
    df = table(spark)
    took, made, shard_of = Counter(), Counter(), Counter()
    mix = mixing.mix(df).collect()
    for r in mix:
        took[r.doc_id, r.source] += r.taken
        shard_of.update({k: n for k, n in enumerate(r.by_shard)})
        assert sum(r.by_shard) == r.taken
    out = mixing.materialise(df, shard="shard")
    assert out.columns == [*df.columns, "shard"]
    got, by_shard = out.collect(), Counter()
    known = {(r.doc_id, r.source, w) for r in df.collect() for w in (r.text or "").split()}
    for r in got:
        made[r.doc_id, r.source] += len(r.text.split())
        by_shard[r.shard] += len(r.text.split())
        assert all((r.doc_id, r.source, w) in known for w in r.text.split())
    assert made == +took and by_shard == +shard_of
    assert set(by_shard) == set(range(mixing.SHARDS)) and max(by_shard.values()) - min(by_shard.values()) <= 0.1 * sum(by_shard.values()) / mixing.SHARDS
    # per shard and source: quotas in blocks, short last blocks apart
    assert mixing.materialise(df.limit(0)).count() == 0
    whole = [r for r in got if r.doc_id == 503]
    assert whole and sum(len(r.text.split()) for r in whole) == took[503, "s4"]


def test_permutation(spark):
    sizes = [1, 2, 3, 4, 5, 6, 7, 10, 31, 50, 97, 100, 101, 333, 1000, 4097]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"))
    at = {}
    for r in df.select("n", "b", mixing.permuted(F.col("b"), F.col("n")).alias("y")).collect():
        at.setdefault(r.n, {})[r.b] = r.y
    for n in sizes:
        assert sorted(at[n].values()) == list(range(n)), n
    for n in (333, 1000, 4097):  # no long stretches: what half of the places take is spread
        taken = [at[n][b] < n // 2 for b in range(n)]
        runs = 1 + sum(x != y for x, y in zip(taken, taken[1:]))
        assert 0.4 * n < runs < 0.6 * n
