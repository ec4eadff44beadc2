"""op10's audit and its groups of copies."""

import numpy as np

from papertrace.llm import neighbors


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_audit_weighs_queries_alike():
    """A third of the queries have hundreds of links, always found; the others' single links are missed below a
    beam of 256. Pooled over pairs that was a pass at the first beam."""
    r = np.random.default_rng(3)
    base = unit(r.normal(size=(1500, 24)))
    hot = unit(base[:1] + r.normal(size=(700, 24)) * 0.004)
    pairs = unit(base + r.normal(size=base.shape) * 0.01)

    class Blind(neighbors.Graph):
        def links(self, q, least, beam):
            a, b = np.nonzero(q @ self.x.T >= least - 1e-4)
            many = np.bincount(a, minlength=len(q))
            ok = (many[a] > 100) | (beam >= 256)
            return a[ok], b[ok]

    x = np.concatenate([pairs, hot, unit(r.normal(size=(2000, 24)))]).astype(np.float32)
    q = np.concatenate([hot, base]).astype(np.float32)
    beam, whole, asked, recall = neighbors.audited(Blind(x, [], 0), q, np.full(len(q), -1), 0.98)
    assert beam == 256 and whole is None and asked >= neighbors.AUDIT and recall >= neighbors.RECALL


def test_rare_links_are_audited_without_self_matches():
    r = np.random.default_rng(5)
    x = unit(r.normal(size=(3000, 24))).astype(np.float32)
    x[10] = unit(x[:1] + 0.001)[0]
    g = neighbors.Graph(x, [], 0)  # never walked: brute force over all is what it finds
    beam, whole, *_ = neighbors.audited(g, x, np.arange(len(x)), 0.98)
    assert whole is not None and set(zip(*map(list, whole))) == {(0, 10), (10, 0)}


def test_copies_do_not_hide_others(spark):
    """200 equal vectors, in a shard with pairs: every link counts, and the graph has one node for the copies."""
    r = np.random.default_rng(7)
    some = unit(r.normal(size=(150, 16)))
    x = np.concatenate([np.repeat(some[:1], 200, axis=0), some, unit(some + r.normal(size=some.shape) * 0.01)]).astype(np.float32)
    got = {row.vec_id: row for row in neighbors.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    y = unit(x.astype(float))
    link = y @ y.T >= 0.98
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert all(got[i].component_id == min(i, *np.flatnonzero(link[i]).tolist()) for i in range(len(x)))
    first, node = neighbors.distinct(y)
    assert len(first) == 300 and (first[node[:201]] == 0).all()


def test_many_shards_and_blocks(spark, tmp_path):
    """One label over several shards and blocks, in graphs: recall at least 0.99 of brute force, no link below the
    limit, and the audits' figures."""
    r = np.random.default_rng(11)
    base = unit(r.normal(size=(900, 20)))
    x = unit(np.concatenate([base, base[:600] + r.normal(size=(600, 20)) * 0.02, base[:300] + r.normal(size=(300, 20)) * 0.03, np.repeat(base[:1], 80, axis=0)])).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {row.vec_id: row for row in neighbors.linked(df, shard_rows=600, block_rows=500, metrics=str(tmp_path / "m")).collect()}
    y = unit(x.astype(float))
    link = y @ y.T >= 0.98
    np.fill_diagonal(link, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= link.sum(axis=1)).all() and found.sum() >= 0.99 * link.sum() > 0
    audits = spark.read.parquet(str(tmp_path / "m")).collect()
    assert len({(a.shard, a.block) for a in audits}) == len(audits) == 4 * 4
    assert all(a.recall >= neighbors.RECALL for a in audits) and sum(a.asked for a in audits) > 300


def test_groups_of_near_copies_are_followed_not_asked_again():
    """400 and 60 near copies, all linked, among 4,000 vectors: every link, with the first beam asked once. Wider beams
    over the whole graph took most of the time, and as the square of a group's size."""
    r = np.random.default_rng(13)
    some = unit(r.normal(size=(4000, 32)))
    x = unit(np.concatenate([some, some[:1] + r.normal(size=(400, 32)) * 0.01, some[1:2] + r.normal(size=(60, 32)) * 0.01])).astype(np.float32)
    x = x[r.permutation(len(x))]
    beams = []

    class Told(neighbors.Graph):
        def query(self, q, beam):
            beams.append((len(q), beam))
            return super().query(q, beam)

    a, b = Told(x).links(x, 0.98, neighbors.BEAM)
    want = np.nonzero(x @ x.T >= 0.98 - 1e-4)
    assert len(want[0]) > 150_000 and sorted(zip(a.tolist(), b.tolist())) == list(zip(*(w.tolist() for w in want)))
    assert beams == [(len(x), neighbors.BEAM)]
