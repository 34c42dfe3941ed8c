import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(20))
def test_two_stage_is_the_suffix_array(seed):
    r = random.Random(seed)
    data = bytes(r.choice([[1, 2], [97, 98, 99], range(1, 256), [7]][seed % 4]) for _ in range(r.randint(1, 400)))
    if seed % 3 == 0:
        data = data * 4
    got = sd.two_stage(np.frombuffer(data, np.uint8), depth=len(data) + 8).tolist()
    assert got == sorted(range(len(data)), key=lambda i: data[i:])


def slow(rows):
    """Per row: (n_bytes, n_removed, n_spans, digest), by looking every window up."""
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, digest(rows[i][1])))
    seen, out = set(), [None] * len(rows)
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\0") for _ in range(r.randint(1, 8)))
    passage = [" ".join(word() for _ in range(n)) for n in (15, 25, 60, 200)]
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (None, passage[1]), (6, "ab" * 300), (7, "ab" * 120 + "c" + "ab" * 120)]
    for i in range(10, 70):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            p = r.choice(passage)
            a, b = sorted(r.sample(range(len(p)), 2))
            parts.insert(r.randrange(3), p if r.random() < 0.5 else p[a:b])
        rows.append((i, r.choice([" ", ""]).join(parts)))
    rows += [(100 + i, rows[r.randrange(len(rows))][1]) for i in range(10)]
    r.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, did string, dig int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect())
    assert got == Counter((r[0], *out) for r, out in zip(rows, slow(rows)))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_against_every_window(spark, seed, monkeypatch):
    if seed == 2:  # few anchors at a time
        monkeypatch.setattr(sd, "SORT_BYTES", 3000)
    if seed == 3:  # one anchor's segments are sorted in parts; records go on in small lots
        monkeypatch.setattr(sd, "SORT_BYTES", 300)
        monkeypatch.setattr(sd, "RECORDS", 50)
    check(spark, corpus(seed))


@pytest.mark.parametrize("ids", ["null", "repeated"])
def test_rows_without_an_id_of_their_own(spark, ids):
    """1,000 different texts that no doc_id tells apart, half of them with a shared passage."""
    r = random.Random(ids)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(22))
    rows = []
    for i in range(1000):
        own = [" ".join(f"w{r.randrange(10**9)}" for _ in range(12)) for _ in range(2)]
        rows.append((None if ids == "null" else i % 3, f" {passage} ".join(own) if i % 2 else " ".join(own)))
    check(spark, rows + [rows[0]])


def test_suffixes_are_sorted_where_bytes_run_on():
    data = np.frombuffer(b"a" * 3000 + b"b" + b"a" * 200 + bytes(500) + b"ab" * 400, np.uint8)
    got = sd.two_stage(data, depth=100)
    heads = [data[i : i + 100].tobytes() for i in got.tolist()]
    assert heads == sorted(heads) and sorted(got.tolist()) == list(range(len(data)))


def test_repeated_rows_and_empty_table(spark):
    text = "some words that go on and on " * 8
    df = spark.createDataFrame([(1, text), (1, text), (1, "short"), (1, "short"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed == r.n_bytes) for r in sd.remove_repeats(df).collect())
    assert got == [(1, 5, False), (1, 5, False), (1, len(text), False), (1, len(text), True), (2, 0, True)]
    assert sd.remove_repeats(df.limit(0)).collect() == []
