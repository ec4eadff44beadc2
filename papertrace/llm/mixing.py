"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's words, documents in seeded order one after the other, are cut into blocks of equal length. Blocks of
the mix are allotted to sources by highest quotients target / (2k + 1), which gives integer quotas; as
that method is house-monotone, quotas of consecutive output shards are differences of such allotments. A
source's blocks are then numbered, whole passes first, each in order, and a last one in the order of a keyed
permutation: its first shard takes the first numbers, as many as its quota, the next shard the next ones, and
what is left over is not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bind, cut, n_words, text_of
from .order import running_totals

#: Words of a block; passes over a source at most.
BLOCK_WORDS, PASSES = 32, 3
#: Output shards that the quotas are given for.
SHARDS = 8
SEED = 20_240_229
#: The permutation's modulus, a prime whose square fits 64 bits, and the keys of its rounds.
PRIME = (1 << 31) - 1
KEYS = tuple(SEED * k % PRIME for k in (48_271, 69_621, 39_373, 742_938))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target): sources in order of code points, null last, weigh by turns;
    targets share the sum of all sizes by weight, up to `passes` times a source's size, the excess shared
    again until no target is above. sizes: (source, source_size), a row per source.

    The fixed point is target = min(cap, level * weight): in order of cap / weight, level is what is left
    over what weight is left at the first source that it doesn't fill."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    s = sizes.select("source", F.col("source_size").cast("long"), F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("double").alias("weight"))
    s = s.withColumn("_cap", (F.col("source_size") * passes).cast("double"))
    ratio, whole = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()), Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / rest)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("_level").alias("l")))
    s = s.withColumn("_level", F.min(fits).over(whole)["l"])
    return s.select("source", "source_size", "weight", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), "_cap")).alias("target"))


def quotas(target: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """(source, shard, quota): whole blocks of each source for each output shard, by Sainte-Laguë.

    A block has `block` words, or on average as many as a column `unit` says of its source (whose last block
    may be short): the method shares out target / unit. For the first i of the shards together N_i blocks are allotted. With t the source's share of N_i, no
    source gets fewer than floor(t (1 - S / 2N) + 1/2) or more than floor(t (1 + S / 2N) + 1/2) blocks of S
    sources, so at most about 2 S seats are contested: those are ranked by quotient (ties by source)."""
    whole = Window.partitionBy()
    unit = F.col("unit") if "unit" in target.columns else F.lit(block)
    t = target.select("source", (F.col("target") / unit).alias("target"), (F.ceil(F.col("source_size") / block) * passes).alias("_most")).withColumn("_sum", F.sum("target").over(whole)).withColumn("_s", F.count(F.lit(1)).over(whole))
    t = t.where("target > 0").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("_n", F.round(F.round(F.col("_sum")) * F.col("shard") / shards).cast("long")).withColumn("_t", F.col("target") / F.col("_sum") * F.col("_n"))
    slack = F.col("_s") / (2.0 * F.greatest("_n", F.lit(1)))
    bound = lambda k: F.least("_most", F.greatest(F.lit(0), F.floor(F.col("_t") * k + 0.5))).cast("long")
    t = t.withColumn("_low", bound(F.greatest(F.lit(0.0), 1 - slack))).withColumn("_high", bound(1 + slack))
    t = t.withColumn("_open", F.greatest(F.lit(0), F.col("_n") - F.sum("_low").over(Window.partitionBy("shard"))))
    seat = t.where("_high > _low").withColumn("_k", F.explode(F.expr("sequence(_low, _high - 1)")))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc(), F.col("source").asc_nulls_last()))
    won = seat.withColumn("_r", rank).where("_r <= _open").groupBy("source", "shard").agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(F.col("source").alias("_src"), F.col("shard").alias("_sh"), "_won")
    t = t.join(won, F.col("source").eqNullSafe(F.col("_src")) & (F.col("shard") == F.col("_sh")), "left").withColumn("_upto", F.col("_low") + F.coalesce("_won", F.lit(0)))
    before = F.coalesce(F.lag("_upto").over(Window.partitionBy("source").orderBy("shard")), F.lit(0))
    return t.select("source", F.col("shard") - 1, (F.col("_upto") - before).alias("quota")).toDF("source", "shard", "quota")


def permuted(block: Column, blocks: Column) -> Column:
    """The place of a block in the keyed permutation of `blocks` blocks: a Feistel network over pairs (x div m, x
    mod m) with about as many rows as columns, walked on while it lands beyond the last block. Fewer pairs than
    rows lie there, so that a walk is at most that long; one beyond 64 steps is as likely as 64 in a row of events of
    1 in sqrt(blocks), and an error. JVM only."""
    rows = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    cols = F.ceil(blocks / rows).cast("long")

    def turn(y: Column, key: int) -> Column:
        return bind((y + F.lit(key)) % PRIME, lambda z: (z * z + F.lit(key)) % PRIME)

    def once(s: Column, x: Column) -> Column:
        def rounds(at: Column, k: int) -> Column:
            if k == len(KEYS):
                return at["l"] * s["cols"] + at["r"]
            if k % 2 == 0:
                new = F.struct(((at["l"] + turn(at["r"], KEYS[k])) % s["rows"]).alias("l"), at["r"].alias("r"))
            else:
                new = F.struct(at["l"].alias("l"), ((at["r"] + turn(at["l"], KEYS[k])) % s["cols"]).alias("r"))
            return bind(new, lambda n: rounds(n, k + 1))

        return bind(F.struct(F.floor(x / s["cols"]).cast("long").alias("l"), (x % s["cols"]).alias("r")), lambda at: rounds(at, 0))

    def walk(s: Column) -> Column:
        steps = F.sequence(F.lit(0), F.least(s["rows"] * s["cols"] - s["n"], F.lit(64)).cast("int"))
        start = F.struct(s["x"].alias("x"), F.lit(False).alias("in"))
        step = lambda acc, _: F.when(acc["in"], acc).otherwise(bind(once(s, acc["x"]), lambda y: F.struct(y.alias("x"), (y < s["n"]).alias("in"))))
        return bind(F.aggregate(steps, start, step), lambda a: F.when(a["in"], a["x"]).otherwise(F.raise_error(F.lit("permuted: a walk too long")).cast("long")))

    return bind(F.struct(block.cast("long").alias("x"), blocks.cast("long").alias("n"), rows.alias("rows"), cols.alias("cols")), walk)


def seeded(doc_id: Column, text: Column) -> Column:
    """The number that puts documents in order: 60 bits of the MD5 of seed, doc_id and text."""
    said = F.concat_ws("|", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), text_of(text))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def placed(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """rows (doc_id, source, size, _seeded, others) with source_size, target, first (the word of its source's stream
    at which a row begins), blocks, quota, upto (quotas of the shards added up) and pieces, an array of (number,
    shard, start, end): the words [start, end) of the row that the source's block of that number gives to a shard."""
    rows = running_totals(rows, ["source", "_seeded", "doc_id"], "size", "first", "_place", group="source")
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")
    share = quotas(goal.withColumn("unit", F.greatest(F.lit(1), F.col("source_size")) / blocks))
    # a number per shard and source
    share = share.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("_quotas"))
    upto = F.aggregate("_quotas", F.array().cast("array<bigint>"), lambda a, q: F.concat(a, F.array(q + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")))))
    share = share.select(F.col("source").alias("_q"), upto.alias("upto"))
    goal = goal.join(share, F.col("source").eqNullSafe(F.col("_q")), "left")
    none = F.array_repeat(F.lit(0).cast("long"), SHARDS)
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", blocks.alias("blocks"), F.coalesce("upto", none).alias("upto"))
    goal = cut(goal.withColumn("quota", F.element_at("upto", -1)))
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_place")
    return out.withColumn("pieces", pieces())


def pieces() -> Column:
    """The pieces of a row that placed() describes, in order of passes and words."""

    def of(s: Column) -> Column:
        end = s["first"] + s["size"]
        touched = F.when(s["size"] > 0, F.sequence(F.floor(s["first"] / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))).otherwise(F.array().cast("array<bigint>"))
        whole = F.floor(s["quota"] / s["blocks"])
        shard = lambda n: F.size(F.filter(s["upto"], lambda u: u <= n))
        piece = lambda b, n: F.struct(n.alias("number"), shard(n).alias("shard"), (F.greatest(b * BLOCK_WORDS, s["first"]) - s["first"]).alias("start"), (F.least((b + 1) * BLOCK_WORDS, end) - s["first"]).alias("end"))
        passes = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1)).otherwise(F.array().cast("array<bigint>"))
        full = lambda t: F.flatten(F.transform(passes, lambda p: F.transform(t, lambda b: piece(b, p * s["blocks"] + b))))
        last = lambda t: F.filter(F.transform(t, lambda b: bind(whole * s["blocks"] + permuted(b, s["blocks"]), lambda n: piece(b, n))), lambda x: x["number"] < s["quota"])
        rest = F.when(s["quota"] % s["blocks"] > 0, touched).otherwise(F.array().cast("array<bigint>"))
        return bind(touched, lambda t: F.concat(full(t), last(rest)))

    return bind(F.struct("first", "size", "blocks", "quota", "upto"), of)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """df's rows as (doc_id, source, size, source_size, target, first, blocks, quota, taken, by_shard).

    size is the number of words (null text: 0); taken counts the row's words in the mix, repeats counted, and
    by_shard those of each output shard. A null source is a source, and the last. Rows without words are never
    taken. A text of any length may span any number of blocks; a row is taken as often as its source is passed
    over, at most PASSES times. Documents come in seeded order of doc_id and text, fully equal rows in any;
    each of them is a row of its own. Sources are metadata, a row each: their table fits a task. Documents of a source
    are not gathered. Other columns are ignored; an empty table gives none. JVM only."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), seeded(F.col(doc_id), F.col(text)).alias("_seeded"))
    rows = placed(rows, weights)
    words = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), lambda k: words(F.filter("pieces", lambda x: x["shard"] == k)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "first", "blocks", "quota", words(F.col("pieces")).alias("taken"), by_shard.alias("by_shard"))


def materialise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard: str | None = None) -> DataFrame:
    """The mix itself, with df's columns: for each pass over a row and each output shard a row with the words that
    go there, joined by one space; where a pass takes the whole row to one shard, with the text as it was. Rows that
    the mix doesn't take are left out. `shard` names a column for the shard. The rows are stored once and numbered,
    so that each, also of equal ones, gets the part that mix() counts for it."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    held = cut(df.select(row.alias("row"), F.monotonically_increasing_id().alias("rid")))
    t = F.col("row")[text]
    rows = held.select("rid", F.col("row")[doc_id].alias("doc_id"), F.col("row")[source].alias("source"), n_words(t).alias("size"), seeded(F.col("row")[doc_id], t).alias("_seeded"))
    rows = placed(rows)
    # pieces of one pass and shard together
    spot = lambda p, blocks: F.struct(F.floor(p["number"] / blocks).alias("pass"), p["shard"].alias("shard"))
    spots = F.array_distinct(F.transform("pieces", lambda p: spot(p, F.col("blocks"))))
    grouped = F.transform(spots, lambda k: F.struct(k["shard"].alias("shard"), F.filter("pieces", lambda p: spot(p, F.col("blocks")) == k).alias("spans")))
    rows = held.join(rows.select("rid", "size", grouped.alias("parts")), "rid")

    def said(words: Column, part: Column) -> Column:
        some = F.flatten(F.transform(part["spans"], lambda x: F.slice(words, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
        n = F.aggregate(part["spans"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        return F.struct(part["shard"].alias("shard"), F.when(n == F.col("size"), t).otherwise(F.array_join(some, " ")).alias("text"))

    out = bind(F.regexp_extract_all(text_of(t), F.lit(WORD), F.lit(0)), lambda w: F.transform("parts", lambda p: said(w, p)))
    rows = rows.select("row", F.explode(out).alias("out"))
    cols = [F.col("out")["text"].alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns]
    return rows.select(*cols, *([F.col("out")["shard"].alias(shard)] if shard else []))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for op9_mixing: all seats ranked by quotient, all blocks walked through the permutation."""
    f = lambda y, k: f"((({y} + {KEYS[k]}) % {PRIME}) * (({y} + {KEYS[k]}) % {PRIME}) + {KEYS[k]}) % {PRIME}"
    once = lambda x: f"{x} // m AS l0, {x} % m AS r0, (l0 + {f('r0', 0)}) % a AS l1, (r0 + {f('l1', 1)}) % m AS r1, (l1 + {f('r1', 2)}) % a AS l2, (r1 + {f('l2', 3)}) % m AS r2, l2 * m + r2 AS y"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size, CAST('0x' || md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, '')))[1:15] AS BIGINT) AS h FROM {table}),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS f FROM d),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, CAST(source_size * {PASSES} AS DOUBLE) AS cap FROM d GROUP BY source),
v AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight FROM z),
e AS (SELECT min({{'r': cap / weight, 'l': rest_size / rest_weight}}) FILTER (WHERE rest_size / rest_weight * weight <= cap) AS b FROM v),
t AS (SELECT z.source, source_size, least(cap, coalesce(b.l * weight, cap)) AS target, greatest(1, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT)) AS n, target / (greatest(1, source_size) / CAST(n AS DOUBLE)) AS u FROM z, e),
seats AS (SELECT source, u / (2 * k + 1) AS q FROM (SELECT source, u, unnest(range(0, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) * {PASSES})) AS k FROM t WHERE target > 0)),
won AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS i FROM seats) WHERE i <= (SELECT round(sum(u)) FROM t WHERE target > 0) GROUP BY source),
s AS (SELECT t.*, coalesce(quota, 0) AS quota, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a, CAST(ceil(n / a) AS BIGINT) AS m FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source),
w AS (SELECT source, n, a, m, b, y FROM (SELECT source, n, a, m, b, {once('b')} FROM (SELECT source, n, a, m, unnest(range(0, n)) AS b FROM s))
  UNION ALL SELECT source, n, a, m, b, y FROM (SELECT source, n, a, m, b, {once('x')} FROM (SELECT source, n, a, m, b, y AS x FROM w WHERE y >= n))),
k AS (SELECT w.source, b, quota // s.n + CASE WHEN y < quota % s.n THEN 1 ELSE 0 END AS times FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source WHERE y < w.n),
p AS (SELECT rid, source, f, f + size AS g, unnest(range(CAST(f AS BIGINT) // {BLOCK_WORDS}, (CAST(f + size AS BIGINT) - 1) // {BLOCK_WORDS} + 1)) AS b FROM r WHERE size > 0),
o AS (SELECT rid, sum(times * (least((p.b + 1) * {BLOCK_WORDS}, g) - greatest(p.b * {BLOCK_WORDS}, f))) AS taken FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source AND p.b = k.b GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN o USING (rid)
"""
