"""op4: fences come from the group's sketches, drawn towards the language's and all texts'; against brute force."""

import math
import random

from papertrace.llm import quality

KEYS = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}


def text(r, symbols, dups, repeats, length, n=400):
    w = ["".join(r.choice("abcdefghijklmnop") for _ in range(max(1, int(r.gauss(length, 1))))) + f"{i:03d}" for i in range(n)]
    w = [x + "#" * (r.random() < symbols) for x in w]
    for _ in range(int(repeats * n / 6)):
        k = r.randrange(n - 6)
        w[k : k + 3] = w[k + 3 : k + 6] = ["the", "same", "phrase"]
    lines = [" ".join(w[i : i + 4]) for i in range(0, n, 4)]
    for k in r.sample(range(len(lines) - 1), int(dups * len(lines) / 2)):
        lines[k] = "one line"
    return "\n".join(lines)


def brute(rows):
    """kept per row, from the counts."""
    ok = [r for r in rows if not r["base_failed"]]
    rate = lambda r, k: r[KEYS[k][0]] / float(max(r[KEYS[k][1]], 1))

    def fence(some, k):
        x = sorted(rate(r, k) for r in some)
        at = lambda p: x[math.ceil(p * len(x)) - 1]
        return at(0.9) + 2.0 * (at(0.9) - at(0.5))

    out = []
    for r in rows:
        own = [o for o in ok if (o["lang"], o["source"]) == (r["lang"], r["source"])]
        lang = [o for o in ok if o["lang"] == r["lang"]]
        bad = r["base_failed"]
        for k in KEYS:
            if bad:
                break
            wide = (len(lang) * fence(lang, k) + 100 * fence(ok, k)) / (len(lang) + 100)
            f = (len(own) * fence(own, k) + 100 * wide) / (len(own) + 100)
            n, p = float(max(r[KEYS[k][1]], 1)), min(f, 1.0)
            bad = rate(r, k) > f + 4 * math.sqrt(p * (1 - p) / n) + 16 / n
        out.append(not bad)
    return out


def test_verdicts_follow_the_group(spark):
    r, made = random.Random(3), []
    usual = {"prose": (0.0, 0.0, 0.0, 5), "code": (0.25, 0.0, 0.0, 5), "lists": (0.0, 0.4, 0.0, 5), "legal": (0.0, 0.0, 0.25, 5), "names": (0.0, 0.0, 0.0, 9)}
    for source, (s, d, p, n) in usual.items():
        for _ in range(250):
            made.append((len(made), text(r, s * r.random(), d * r.random(), p * r.random(), n + r.random(), r.randrange(90, 300) * 4), "en", source))
    odd = {}
    for source in usual:
        for k, kind in enumerate(usual):
            odd[len(made)] = (source, kind)
            made.append((len(made), text(r, *[(0.3, 0.9, 0.3, 10)[k - 1] if k and j == k - 1 else (0.0, 0.0, 0.0, 5)[j] for j in range(4)], 600), "en", source))
    made += [(-1, text(r, 0.5, 0, 0, 5), "xx", None), (-2, text(r, 0, 0, 0, 5), None, "few"), (-3, None, "en", "code"), (-4, "few words", "en", "code")]
    got = quality.judge(spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    rows = [x.asDict() for x in got]
    assert [x["kept"] for x in rows] == brute(rows)
    kept = {x["doc_id"]: x["kept"] for x in rows}
    out = {odd[i] for i in odd if not kept[i]}
    # what is usual in one source is no fault there, and is one in prose
    assert {("prose", k) for k in ("code", "lists", "legal", "names")} <= out
    assert not {(k, k) for k in usual} & out and not kept[-3] and not kept[-4]
    assert sum(kept.values()) > 0.98 * 1250
