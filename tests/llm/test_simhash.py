import random
import re

import numpy as np
import pytest
import xxhash

from tracewright.llm import simhash


def slow_fingerprint(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, bits=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def texts(seed, n=150):
    r = random.Random(seed)
    words = ["alpha", "Beta", "été", "x", "ÀB", "the one", "kw"] + [f"w{i}" for i in range(200)]
    out = ["", None, " \t\n", "one", "one two", "A b", "a B", "word " * 2000]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 40, 300, 700]))]
        out.append(r.choice([" ", "\n", "  ", "\t"]).join(base))
        for _ in range(r.randrange(3)):
            if len(base) > 100:
                base[r.randrange(len(base))] = "edit"
            out.append(" ".join(base))
    return out[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints_equal_the_definition(seed):
    cases = texts(seed)
    got = simhash.fingerprint([(t or "").encode() for t in cases], 3, 42)
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in cases]


def test_near_groups_equal_brute_force(spark):
    cases = texts(5, 220)
    schema = "doc_id long, text string, fp string, component_id string, a int"
    rows = [(1000 - i, t, "x", "y", 1) for i, t in enumerate(cases)] + [(None, "one two", "", "", 0), (1000, "", "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(df).collect()}
    fps = [slow_fingerprint(t[1]) for t in rows]
    roots = slow_groups(fps)
    smallest = {}
    for r, row in zip(roots, rows):
        if row[0] is not None:
            smallest[r] = min(smallest.get(r, row[0]), row[0])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == {(row[0], f): smallest[r] for row, f, r in zip(rows, signed, roots)}


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("dense", [False, True])
def test_index_connects_what_brute_force_connects(spark, dense):
    r = np.random.Generator(np.random.PCG64(3))
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    if dense:
        fps = np.concatenate([fps[:50], *[fps[:10] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in r.integers(0, 64, (60, 2))]])
    else:
        fps = np.concatenate([fps, *[fps ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (2, 3, 4)]])
    fps = np.unique(fps)
    from tracewright.llm.graph import components

    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {x.node: x.root for x in components(simhash.links(df, 3)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = slow_groups([int(x) for x in fps])
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


def slow_similar_groups(cases, similarity):
    sets = []
    for t in cases:
        w = (t or "").lower().split()
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(cases)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) and len(a & b) >= similarity * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(cases))]


@pytest.mark.parametrize("crowd", [0, 60])
def test_near_copies_are_those_of_brute_force(spark, crowd):
    r = random.Random(crowd)
    word = lambda: f"w{r.randrange(5000)}"
    cases = ["", None, "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(90):  # one changed word in k changes up to five shingles: similarities all around 0.8
        base = [word() for _ in range(r.choice([40, 120, 300]))]
        cases.append(" ".join(base))
        for at in r.sample(range(len(base)), max(1, len(base) * r.randrange(10, 45) // 1000)):
            base[at] = word()
        cases.append(" ".join(base))
    base = [word() for _ in range(150)]
    for _ in range(crowd):  # many that meet under the same keys, of which not all are similar
        other = list(base)
        for at in r.sample(range(150), r.choice([0, 1, 3, 4, 6, 9])):
            other[at] = word()
        cases.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    want = slow_similar_groups(cases, 0.8)
    assert {x.doc_id: x.component_id for x in simhash.similar_groups(df).collect()} == dict(enumerate(want))
    assert {x.doc_id for x in simhash.drop_near_copies(df).collect()} == set(want)


def test_near_copies_with_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, node int, keys string, root int, fp string"
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text), (None, text), (2, None), (3, ""), (4, text + "eleven"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", 1, "f") for r in rows], schema)
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, text), (2, None)]
    assert simhash.drop_near_copies(df.limit(0)).collect() == []
