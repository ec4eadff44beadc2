"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard of a label.

Each shard's graph is built once, stored in the shared folder, and queried by all vectors of its label, in
blocks. Queries of a block walk the graph in step, so that each step is a few NumPy calls for hundreds of
them. Where a beam holds links only there may be more behind it: the graph is followed on through the nodes that
link, so that a group of near copies costs its links, not wider and wider beams. A block's beams are widened until
an audit against brute force finds the recall asked for. Equal vectors are one node and one query; those links are
exact and take no part in the audit, which draws queries until AUDIT of them have true links, and weighs each of
these alike. Links are verified by cosine in double precision. What leaves a task is a count per query and a
spanning forest.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready
from .components import components, forest

#: Vectors of a shard, queries of a block, at most (about; they are dealt by hash).
SHARD_ROWS, BLOCK_ROWS = 32_768, 65_536
#: Bytes of a shard's vectors as doubles, at most about; longer vectors make smaller shards and blocks.
SHARD_BYTES = 64_000_000
#: Blocks at least, so that a label's queries spread over tasks.
LEAST_BLOCKS = 4
#: Neighbours of a node (twice as many on the lowest layer), beam when building and when querying.
DEGREE, BUILD_BEAM, BEAM = 12, 48, 32
#: Queries with true links that are audited in a block, the mean recall of a query asked for, and queries in step.
AUDIT, RECALL, STEP = 64, 0.995, 256


#: Numbers of vectors that are gathered at once.
PIECE = 65_536
#: A key of no node: below all others, nothing to expand.
NONE = np.iinfo(np.int64).min


def dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """x[i] * y[j] by rows, summed; a piece at a time, as large arrays cost more to allocate than to fill."""
    out, piece = np.empty(len(i), dtype=x.dtype), max(1, PIECE // x.shape[1])
    for k in range(0, len(i), piece):
        out[k : k + piece] = np.einsum("rd,rd->r", x[i[k : k + piece]], y[j[k : k + piece]])
    return out


def packed(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Keys of nodes to be expanded, that sort as their similarities do."""
    s = sims.astype(np.float32).view(np.int32)
    return ((s ^ (s >> 31 & 0x7FFFFFFF)).astype(np.int64) << 32) + (nodes << 1) + 1


def unpacked(keys: np.ndarray) -> np.ndarray:
    """The similarities of keys."""
    s = (keys >> 32).astype(np.int32)
    return (s ^ (s >> 31 & 0x7FFFFFFF)).view(np.float32)


class Graph:
    """A navigable small-world graph over unit vectors, in arrays: near[layer][node] are neighbours or -1."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.near, self.entry = np.ascontiguousarray(x, dtype=np.float32), near or [], entry
        if near is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        rng = np.random.default_rng(7)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int), 5)
        self.near = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        if not n:
            return
        self.entry, top, done = 0, int(level[0]), 1
        while done < n:
            new = np.arange(done, min(n, done + max(1, min(STEP, done // 2))))
            at = np.full((len(new), 1), self.entry, dtype=np.int64)
            for layer in range(top, -1, -1):
                own, passing = np.flatnonzero(level[new] >= layer), np.flatnonzero(level[new] < layer)
                to = np.full((len(new), 4), -1, dtype=np.int64)
                if len(passing):
                    to[passing] = self.walk(self.x[new[passing]], at[passing], layer, 4)[0]
                if len(own):
                    ids, sims = self.walk(self.x[new[own]], at[own], layer, BUILD_BEAM)
                    to[own] = ids[:, :4]
                    peers = new[own]  # what is put in at once may be linked as well
                    k = min(8, len(peers))
                    s = self.x[peers] @ self.x[peers].T
                    np.fill_diagonal(s, -np.inf)
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s = np.take_along_axis(s, best, axis=1)
                    c_ids = np.concatenate([ids, np.where(np.isfinite(s), peers[best], -1)], axis=1)
                    c_sims = np.concatenate([sims, s], axis=1)
                    self._link(peers, *self._choose(c_ids, c_sims, self.near[layer].shape[1]), layer)
                at = to
            if (high := int(level[new].max())) > top:
                top, self.entry = high, int(new[np.argmax(level[new])])
            done = int(new[-1]) + 1

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates those nearer to the row than to any chosen one, filled up with the next best."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        nearer = np.empty((rows, width, -(-width // 64)), dtype=np.uint64)  # a bit for each that is nearer to a candidate than the row
        piece = max(1, PIECE // (width * max(width, self.x.shape[1])))
        for k in range(0, rows, piece):
            v = self.x[np.maximum(ids[k : k + piece], 0)]
            some = np.zeros((len(v), width, 64 * nearer.shape[2]), dtype=bool)
            np.greater(v @ v.transpose(0, 2, 1), sims[k : k + piece, :, None], out=some[:, :, :width])
            nearer[k : k + piece] = np.packbits(some, axis=2, bitorder="little").view(np.uint64)
        bits, many = np.zeros((rows, nearer.shape[2]), dtype=np.uint64), np.zeros(rows, dtype=np.int64)
        chosen, valid = np.zeros((rows, width), dtype=bool), ids >= 0
        for c in range(width):
            take = valid[:, c] & (many < most) & ~(nearer[:, c] & bits).any(axis=1)
            chosen[:, c] = take
            bits[:, c // 64] |= take.astype(np.uint64) << np.uint64(c % 64)
            many += take
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        ids, sims = np.take_along_axis(np.where(valid, ids, -1), order, 1), np.take_along_axis(sims, order, 1)
        if ids.shape[1] < most:
            pad = ((0, 0), (0, most - ids.shape[1]))
            ids, sims = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf)
        return ids, sims

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        near = self.near[layer]
        near[new] = ids
        a, b = np.repeat(new, ids.shape[1]), ids.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, many = np.unique(b, return_index=True, return_counts=True)
        by = np.argsort(-many, kind="stable")  # rows of about the same width together
        to, first, many = to[by], first[by], many[by]
        for k in range(0, len(to), STEP):
            t, m = to[k : k + STEP], many[k : k + STEP]
            fresh = first[k : k + STEP, None] + np.arange(m[0])
            fresh = np.where(np.arange(m[0]) < m[:, None], a[np.minimum(fresh, len(a) - 1)], -1)
            c = np.concatenate([near[t].astype(np.int64), fresh], axis=1)
            c = -np.sort(-c, axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            s = dots(self.x, np.maximum(c, 0).ravel(), self.x, np.repeat(t, c.shape[1])).reshape(c.shape)
            s = np.where(c >= 0, s, np.float32(-np.inf))
            near[t] = self._choose(c, s, near.shape[1])[0]

    def walk(self, q: np.ndarray, at: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes met for each query from its entries `at`, best first; -1 fills up.

        A beam is a sorted row of keys: similarity, node and, in the last bit, whether the node is still to be expanded."""
        n, near, width = len(self.x), self.near[layer], max(beam, at.shape[1])
        keys, seen = np.full((len(q), width), NONE, dtype=np.int64), np.zeros(len(q) * n, dtype=bool)
        live, met = np.arange(len(q)), (np.arange(len(q))[:, None] * n + at)[at >= 0]
        while True:
            met = np.sort(met[~seen[met]])
            met = met[np.diff(met, prepend=-1) != 0]
            seen[met] = True
            row, node = np.divmod(met, n)
            new = packed(dots(self.x, node, q, row), node)
            better = new > keys[row, 0]
            row, new = row[better], new[better]
            if len(row):
                rows, first, many = np.unique(row, return_index=True, return_counts=True)
                merged = np.full((len(rows), width + int(many.max())), NONE, dtype=np.int64)
                merged[:, :width] = keys[rows]
                merged[np.repeat(np.arange(len(rows)), many), width + np.arange(len(row)) - np.repeat(first, many)] = new
                merged.sort(axis=1)
                keys[rows] = merged[:, -width:]
            open_ = (keys[live, ::-1] & 1).astype(bool)
            some = open_.any(axis=1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            r, c = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= 4))
            r, c = live[r], width - 1 - c
            near_by = near[keys[r, c] >> 1 & 0x7FFFFFFF]
            keys[r, c] -= 1
            met = (r[:, None] * n + near_by)[near_by >= 0]
        keys = keys[:, ::-1][:, :beam]
        return np.where(keys == NONE, -1, keys >> 1 & 0x7FFFFFFF), np.where(keys == NONE, np.float32(-np.inf), unpacked(keys))

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, dtype=np.int64)
        for layer in range(len(self.near) - 1, 0, -1):
            at = self.walk(q, at, layer, 4)[0]
        return self.walk(q, at, 0, beam)

    def links(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs whose similarity is about `least` or more. Behind a beam that holds nothing else the
        graph is followed through all nodes that link. A beam of a quarter of the nodes is all of them."""
        near = least - 1e-4
        if 4 * beam >= len(self.x):
            return np.nonzero(q @ self.x.T >= near)
        ids, sims = self.query(q, beam)
        full = (sims[:, -1] >= near) & (ids[:, -1] >= 0)
        r, c = np.nonzero((sims >= near) & (ids >= 0) & ~full[:, None])
        out_q, out_n = [r], [ids[r, c]]
        full = np.flatnonzero(full)
        for k in range(0, len(full), STEP):
            some = full[k : k + STEP]
            a, b = self.flood(q[some], ids[some], near)
            out_q.append(some[a])
            out_n.append(b)
        return np.concatenate(out_q), np.concatenate(out_n)

    def flood(self, q: np.ndarray, at: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of at least the similarity `near` among the nodes `at`, and the nodes reached from there
        through nodes that have such pairs, along the lowest layer's edges in both directions. The queries go together:
        what one of them reaches is compared with all, once."""
        out_q, out_n, new = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.unique(at[at >= 0])
        met = np.zeros(len(self.x), dtype=bool)
        while len(new):
            met[new] = True
            r, c = np.nonzero(q @ self.x[new].T >= near)
            out_q.append(r)
            out_n.append(new[c])
            go = new[np.unique(c)]
            reached = np.zeros(len(self.x), dtype=bool)
            to = self.near[0][go]
            reached[to[to >= 0]] = True
            start, end = self.into[1][go], self.into[1][go + 1]
            each = np.repeat(start - np.cumsum(end - start) + end - start, end - start)
            reached[self.into[0][each + np.arange(len(each))]] = True
            new = np.flatnonzero(reached & ~met)
        return np.concatenate(out_q), np.concatenate(out_n)

    @cached_property
    def into(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes with an edge to each node on the lowest layer, node by node, and where each node's begin."""
        a, b = np.nonzero(self.near[0] >= 0)
        to = self.near[0][a, b]
        return a[np.argsort(to, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(self.x)))])

    def to_bytes(self) -> bytes:
        return b"".join([np.array([len(self.near), self.entry, len(self.x)], np.int64).tobytes(), *(a.tobytes() for a in self.near)])

    @classmethod
    def of_bytes(cls, x: np.ndarray, data: bytes) -> Graph:
        layers, entry, n = np.frombuffer(data, np.int64, 3).tolist()
        flat, at, near = np.frombuffer(data, np.int32, offset=24), 0, []
        for k in range(layers):
            w = DEGREE * (2 if k == 0 else 1)
            near.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(x, near, entry)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles, scaled to unit length."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("rd,rd->r", v, v))[:, None]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, node): the first row of each different vector, in order of rows, and each row's number among those."""
    flat = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    _, first, inverse = np.unique(flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return first[order], number[inverse.ravel()]


def audited(g: Graph, q: np.ndarray, same: np.ndarray, least: float) -> tuple[int, tuple[np.ndarray, np.ndarray] | None, int, float]:
    """(beam, links, asked, recall): the first beam at which the recall, averaged over AUDIT queries with true links,
    is RECALL; how many were asked, and the recall that they had.

    same is the node equal to each query, or -1, and is no link here. Queries are drawn in seeded order; if all
    are drawn before AUDIT have links, the links found by brute force are whole, and returned."""
    order = np.random.default_rng(11).permutation(len(q))
    drawn, true_q, true_n, many = 0, [], [], 0
    while drawn < len(q) and many < AUDIT:
        some = order[drawn : drawn + STEP]
        drawn += len(some)
        r, c = np.nonzero(q[some] @ g.x.T >= least - 1e-4)
        other = same[some[r]] != c
        true_q.append(some[r[other]])
        true_n.append(c[other])
        many += len(np.unique(true_q[-1]))
    true_q, true_n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (true_q, true_n))
    if drawn == len(q):
        return BEAM, (true_q, true_n), len(np.unique(true_q)), 1.0
    asked, at, count = np.unique(true_q, return_inverse=True, return_counts=True)
    truth, beam, n, recall = true_q * len(g.x) + true_n, BEAM, len(g.x), 1.0
    while 4 * beam < n:
        a, b = g.links(q[asked], least, beam)
        hit = np.isin(truth, asked[a] * n + b)
        recall = float((np.bincount(at, weights=hit) / count).mean())
        if recall >= RECALL:
            break
        beam, recall = beam * 2, 1.0  # from a quarter of the shard on, a beam is brute force
    return beam, None, len(asked), recall


def linked(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, metrics: str | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of df.

    Rows link when labels are equal and not null, the vectors have the same length, and their cosine is
    found to be `least` or more. A vector that is null, empty, all zero, or holds a null or non-finite
    component links with nothing: no links, its own component, kept. component_id is the least vec_id that
    links reach; kept says that this is the row's own (a null vec_id is not kept, and names no component that
    has another). Repeated rows are vectors of their own and link with each other. An empty table gives none.
    Other columns of df are ignored. Shards and blocks hold at most shard_rows and block_rows vectors, and fewer of
    great length. `metrics` names a path for what the audits found: a row (shard, block, asked, beam, recall) per search."""
    spark = ready(df.sparkSession)
    good = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    rows = cut(rows.select("vec_id", "label", "v", F.coalesce(good, F.lit(False)).alias("good"), F.monotonically_increasing_id().alias("rid")))
    fit = rows.where("good").select("rid", "label", F.size("v").alias("dim"), "v")
    per = fit.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    fits = lambda rows: F.least(F.lit(rows), F.greatest(F.lit(256), F.floor(SHARD_BYTES / (8 * F.col("dim")))))
    per = per.select("label", "dim", F.ceil(F.col("n") / fits(shard_rows)).cast("int").alias("shards"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / fits(block_rows))).cast("int").alias("blocks"))
    fit = fit.join(per, ["label", "dim"])

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rid")
        x = matrix(t.column("v"))
        first, node = distinct(x)
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "blocks": t.column("blocks")[:1], "rids": [t.column("rid").to_numpy().tobytes()], "node": [node.tobytes()], "x": [x[first].tobytes()], "graph": [Graph(x[first]).to_bytes()]})

    kind = rows.schema["label"].dataType.simpleString()
    sharded = fit.withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    index = cut(sharded.groupBy("label", "dim", "shard").applyInArrow(build, f"label {kind}, dim int, shard int, blocks int, rids binary, node binary, x binary, graph binary"))
    asked = fit.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards", "blocks")
    served = index.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"rid": [], "n": [], "root": [], "audit": []}
        if left.num_rows and right.num_rows:
            rid, q = left.column("rid").to_numpy(), matrix(left.column("v"))
            own, node = (np.frombuffer(right.column(c)[0].as_py(), np.int64) for c in ("rids", "node"))
            x = np.frombuffer(right.column("x")[0].as_py(), np.float64).reshape(int(node.max()) + 1, -1)
            g = Graph.of_bytes(x, right.column("graph")[0].as_py())
            copies, lead = np.bincount(node), own[np.unique(node, return_index=True)[1]]
            first, which = distinct(q)
            q, asker = q[first], rid[first]
            at = {v.tobytes(): k for k, v in enumerate(x + 0.0)}
            same = np.fromiter((at.get(v.tobytes(), -1) for v in q + 0.0), np.int64, len(q))
            q32 = q.astype(np.float32)
            beam, whole, drawn, recall = audited(g, q32, same, least)
            n = np.zeros(len(q), dtype=np.int64)  # links of a query, itself among them
            trees: list[tuple[np.ndarray, np.ndarray]] = []

            def take(a: np.ndarray, b: np.ndarray) -> None:
                for m in range(0, len(a), 1 << 18):
                    i, j = a[m : m + (1 << 18)], b[m : m + (1 << 18)]
                    ok = dots(q, i, x, j) >= least
                    i, j = i[ok], j[ok]
                    n[:] += np.bincount(i, weights=copies[j], minlength=len(q)).astype(np.int64)
                    i, j = asker[i], lead[j]
                    if (i != j).any():
                        trees.append(forest(i[i != j], j[i != j]))

            if whole:
                take(*whole)
            else:
                for k in range(0, len(q), STEP):
                    a, b = g.links(q32[k : k + STEP], least, beam)
                    a = a + k
                    other = same[a] != b
                    take(a[other], b[other])
            equal = np.flatnonzero(same >= 0)
            take(equal, same[equal])
            order = np.argsort(own)
            here = own[order[np.minimum(np.searchsorted(own[order], rid), len(own) - 1)]] == rid
            linking = n > 0
            # a query's copies link with the same vectors, and so do a node's, which it stands for
            for a, b, ok in ((rid, asker[which], linking[which]), (own, lead[node], np.full(len(own), True))):
                ok = ok & (a != b)
                if ok.any():
                    trees.append(forest(a[ok], b[ok]))
            n = n[which] - (here & linking[which])
            some = np.flatnonzero(n)
            out["rid"] += rid[some].tolist()
            out["n"] += n[some].tolist()
            out["root"] += [None] * len(some)
            out["rid"].append(None)
            out["n"].append(None)
            out["root"].append(None)
            audit = {"shard": right.column("shard")[0].as_py(), "block": left.column("block")[0].as_py(), "asked": drawn, "beam": len(x) if whole else beam, "recall": recall}
            if trees:
                a, b = forest(np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]))
                out["rid"] += a.tolist()
                out["n"] += [0] * len(a)
                out["root"] += b.tolist()
            out["audit"] = [audit if r is None else None for r in out["rid"]]
        return pa.table(out, schema=pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("audit", pa.struct([("shard", pa.int32()), ("block", pa.int32()), ("asked", pa.int64()), ("beam", pa.int64()), ("recall", pa.float64())]))]))

    keys = ["label", "dim", "shard", "block"]
    found = cut(asked.groupBy(keys).cogroup(served.groupBy(keys)).applyInArrow(search, "rid long, n long, root long, audit struct<shard:int,block:int,asked:long,beam:long,recall:double>"))
    if metrics:
        found.where("audit is not null").select("audit.*").write.mode("overwrite").parquet(metrics)
    links = found.where("root is null and rid is not null").groupBy("rid").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("root is not null"), "rid", "root").withColumnRenamed("vertex", "rid")
    placed = rows.select("rid", "vec_id").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    lows = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(lows, "root").join(links, "rid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle(table: str = "embeddings", least: float = 0.98) -> str:
    """DuckDB SQL for op10_neighbors: all pairs of a label, and reachability."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {table}),
fit AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= {least}),
r(rid, root) AS (SELECT rid, rid FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.rid),
c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.root GROUP BY r.rid),
n AS (SELECT a AS rid, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
