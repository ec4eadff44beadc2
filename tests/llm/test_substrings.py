"""op7 on rows that share a doc_id, or have none, with different texts."""

import random
from collections import Counter

import pytest

from papertrace.llm import substrings


def removed(table, span):
    """As in test_llm: a window is repeated if its words stand at an earlier place (doc, start)."""
    low, out = {}, []
    for d, t in table:
        w = t.split()
        for k in range(len(w) - span + 1):
            low[tuple(w[k : k + span])] = min(low.get(tuple(w[k : k + span]), (d, k)), (d, k))
    for d, t in table:
        w, gone = t.split(), set()
        for k in range(len(w) - span + 1):
            if low[tuple(w[k : k + span])] < (d, k):
                gone |= set(range(k, k + span))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("key_segments,shard_words", [(20_000, 1_000_000), (2, 300)])
def test_rows_that_share_an_id(spark, key_segments, shard_words):
    r = random.Random(4)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b = own(60), own(45)
    rows = [(None, own(150) + " " + a + " " + a), (None, own(30)), (None, own(200)), (None, b + " " + a), (None, b + " " + a), (7, own(90) + " " + b), (7, own(25)), (7, own(140)), (7, b + " " + own(9) + " " + b), (7, b + " " + own(70)), (3, a)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), key_segments=key_segments, shard_words=shard_words).collect()
    null = -(1 << 63)
    want = removed([(null if d is None else d, t) for d, t in rows], 20)
    assert Counter((null if x.doc_id is None else x.doc_id, x.n_words, x.n_removed, x.kept) for x in got) == Counter(want)
    assert sum(w[2] > 0 for w in want) >= 5 and sum(w[2] == 0 for w in want) >= 4
