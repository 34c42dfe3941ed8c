import random
from fractions import Fraction

import pytest

from tracewright.llm import mixing


def clamp_and_share(sizes, weights, budget, epochs):
    """Targets by the definition: share by weight, clamp at the cap, share the excess again, until none is above."""
    caps = [epochs * s for s in sizes]
    clamped = set()
    while True:
        rest = budget - sum(caps[i] for i in clamped)
        total = sum(weights[i] for i in range(len(sizes)) if i not in clamped)
        target = [Fraction(caps[i]) if i in clamped else Fraction(rest) * weights[i] / total for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in clamped and target[i] > caps[i]}
        if not above:
            return target
        clamped |= above
        if len(clamped) == len(sizes):
            return [Fraction(c) for c in caps]


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    sources = ["b", "a", None, "", "Z", "é"][: r.randint(1, 6)]
    rows = [(i, r.choice(sources[: 1 + i % len(sources)]), r.choice([None, "", "one", "a b\tc", "w " * r.choice([5, 50, 300])]), "clash", 1) for i in range(r.choice([3, 60, 300]))]
    rows += [rows[0], (None, sources[0], "null id here", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string, level int")
    got = mixing.mix(df, [3, 1, 2]).collect()
    size = lambda t: len((t or "").split())
    order = sorted({x[1] for x in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(x[2]) for x in rows if x[1] == s) for s in order]
    want = clamp_and_share(sizes, [[3, 1, 2][i % 3] for i in range(len(order))], Fraction(sum(sizes) * 150, 100), 2)
    assert len(got) == len(rows)
    for s, n, t in zip(order, sizes, want):
        own = [g for g in got if g.source == s]
        assert all(g.source_size == n and abs(g.target - float(t)) < 1e-6 for g in own)
        assert all(0 <= g.repeats <= 2 for g in own)
        taken = sum(g.repeats * g.size for g in own)
        assert abs(taken - float(t)) <= max(g.size for g in own)
    key = lambda g: (g.doc_id is None, g.doc_id or 0, g.source is None, g.source or "", g.size, g.repeats)
    again = sorted(mixing.mix(df.repartition(5), [3, 1, 2]).collect(), key=key)
    assert [key(g) for g in again] == sorted(key(g) for g in got)


def test_sample_repeats_rows(spark):
    rows = [(i, "s", f"some words {i}", "x") for i in range(40)] + [(1, "s", "some words 1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    out = mixing.sample(df, [1]).collect()
    mixed = mixing.mix(df, [1]).collect()
    assert sum(m.repeats for m in mixed) == len(out) and set(out[0].asDict()) == {"doc_id", "source", "text", "lang"}
    assert mixing.sample(df.limit(0), [1]).collect() == []
