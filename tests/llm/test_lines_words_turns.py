"""Line dedup, spelling variants and conversation repair against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from tracewright.llm import line_dedup, queries, repair, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word int, key string, gone int"


def documents(spark, rows):
    """With columns named like the operators' own."""
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], DOCS)


# --- lines -------------------------------------------------------------------------------------------------------


def key(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def without_repeats(rows, min_length=10):
    """Brute force: (doc_id, n_lines, n_dropped, kept) per row."""
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_length or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def dropped(df, **options):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(df, **options).collect())


LINES = [
    (5, "A line that repeats\nown line of five"), (3, "  a LINE that repeats\t\nshort\nshort"), (None, "a line that repeats\nonly nobody says this"),
    (None, "only nobody says this"), (9, None), (8, ""), (7, "\n\n"), (3, "a line that repeats\nmore of three"), (4, "ÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜß"), (6, "ÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜß\näöüäöüäöüß"),
    (10, "own line of five\r\nown line of five"), (10, "own line of five\r\nown line of five"), (11, "a line that repeats"),
]


def test_lines_with_nulls_repeats_and_white_space(spark):
    got = dropped(documents(spark, LINES).repartition(5))
    assert got == without_repeats(LINES)
    assert got[(None, 2, 1, "only nobody says this")] and got[(11, 1, 1, "")] and got[(10, 2, 2, "")] == 2


def test_lines_of_no_documents(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, LINES[:1]).limit(0)).collect() == []


@pytest.mark.parametrize("max_bits", [1 << 16, line_dedup.MAX_BITS])
def test_lines_of_many_documents(spark, max_bits):
    """One line in every document, and filters far too small for the rest: more is suspected, the results are the same."""
    rng = random.Random(3)
    pool = [f"Repeated line {i} " + "x" * (i % 40) for i in range(300)]
    rows = [(i, "\n".join(["the line of all documents", *rng.choices(pool, k=3), *(f"line {i} {j} of its own" for j in range(60))])) for i in range(400)]
    assert dropped(documents(spark, rows).repartition(7), max_bits=max_bits) == without_repeats(rows)


def test_only_suspected_lines_move(spark):
    """All repeats are suspected and few others, whether the two documents are in one task or in two."""
    rows = [(i, "\n".join([f"twice {i // 2} and no more", *(f"line {i} {j} of its own" for j in range(50))])) for i in range(400)]
    for parts in (1, 8):
        docs = documents(spark, rows).repartition(parts)
        bits = line_dedup.filter_bits(docs)
        seen = spark.sparkContext.broadcast(line_dedup.repeated_filter(docs, bits, 10))
        keys = [bytes(r.key).decode() for r in line_dedup.suspects(docs, seen, bits, 10).collect()]
        assert sum(k.startswith("twice") for k in keys) == 400
        assert len(keys) - 400 < 0.02 * 20_000


def test_very_long_document(spark):
    text = "\n".join(f"line {i % 70_000} of a long text" for i in range(140_000))
    rows = [(1, text), (2, "line 69999 of a long text\nother words here")]
    assert dropped(documents(spark, rows)) == without_repeats(rows)


# --- words -------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    """Brute force: {word: (n, n_near, form, form_n, root)}."""
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    n = {w: c for w, c in found.items() if len(w) >= 5 and c >= 3}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, those in beside.items():
        best = min(those, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n[w], len(beside[w]), form[w], n.get(form[w]), root(w)) for w in n}


def grouped(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df).collect()}


def test_words_of_a_small_alphabet(spark):
    """Short words over few letters: many neighbours, repeated letters, long chains of forms, ties."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = ["".join(rng.choices("abÀé", [6, 3, 1, 1], k=rng.randint(3, 8))) for _ in range(40)]
        rows.append((i if i % 7 else None, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    rows += [(1000, "aaaaaaa " * 40), (1001, "aaaaaab " * 90), (1002, "aaaaabb " * 400), (1003, None), (1004, ""), (1003, None)]
    got, want = grouped(documents(spark, rows).repartition(3)), words_of(rows)
    assert got == want
    assert sum(v[2] is not None for v in want.values()) > 50 and len({v[4] for v in want.values()}) > 3
    assert any(v[4] != v[2] for v in want.values() if v[2])


def test_words_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.QUERIES["op11_full_neighbourhood"](spark, SF).collect()} == words_of(rows)


def test_no_words(spark):
    assert grouped(documents(spark, [(1, None), (2, "a few 123 ..."), (None, "")])) == {}
    assert grouped(documents(spark, [(1, "x")]).limit(0)) == {}


def test_every_distinct_neighbour_is_emitted_once():
    rng = random.Random(5)
    for _ in range(200):
        w = "".join(rng.choices("abc", k=rng.randint(5, 9)))
        size, alphabet = len(w), "abcd"
        half = size // 2
        for f in (spelling.deletions, lambda *x: spelling.replacements(*x, alphabet), lambda *x: spelling.insertions(*x, alphabet)):
            more = f is not spelling.deletions and len(next(iter(f(w, 0, 1)))) > size
            parts = [*f(w, 0, half), *f(w, half, size + more)]
            assert len(parts) == len(set(parts)) and all(near(w, v) for v in parts)
        every = {w[:i] + w[i + 1 :] for i in range(size)}
        assert set(spelling.deletions(w, 0, size)) == every
        assert set(spelling.insertions(w, 0, size + 1, alphabet)) == {w[:i] + c + w[i:] for i in range(size + 1) for c in alphabet}


# --- turns -------------------------------------------------------------------------------------------------------


def cheapest(kinds):
    """Brute force by recursion: (cost, audit)."""
    lead = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    given = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, put):
        options = [(0, "")] if i == len(kinds) and state in (0, 3) else []
        if put < 3:
            c, a = best(i, given[state], put + 1)
            options.append((c + 5, "I" + a))
        if i < len(kinds):
            k, cut = kinds[i].lower(), 5 * kinds[i].isupper()
            c, a = best(i + 1, state, 0)
            options.append((c + 2, "D" + a))
            if k != "-":
                c, a = best(i + 1, given[state], 0)
                options.append((c + 1 + cut, "R" + a))
                if (state, k) in lead:
                    c, a = best(i + 1, lead[state, k], 0)
                    options.append((c + cut, "K" + a))
        return min(options, default=(10**9, ""))

    return best(0, 0, 0)


def test_layers_give_the_cheapest_and_least_audit():
    rng = random.Random(2)
    for kinds in ["", "-", "s", "a", "S", "sUA", "x", "XX", "uuuu", "aaaa", "ssss"] + ["".join(rng.choices("-suaxSUAX", k=rng.randint(1, 12))) for _ in range(4000)]:
        assert repair.repair(kinds) == cheapest(kinds), kinds


def test_layers_hold_every_state():
    """DEPTH layers suffice: the top one holds all states, after whatever turns."""
    seen, front = set(), {repair.last()[1]}
    while front:
        seen |= front
        front = {repair.step(layers, k)[1] for layers in front for k in "-suaxSUAX"} - seen
    assert all(layers[-1] == 15 for layers in seen) and len(seen) < 2000


def test_long_conversation():
    kinds = "su" + "ua-AxU" * 40_000
    cost, audit = repair.repair(kinds)
    assert sum(e != "I" for e in audit) == len(kinds) and cost > 0


def judged(rows):
    """Brute force: conv_id -> the query's columns."""
    space = " \t\n\v\f\r"
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        told = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        seen, kinds, counts = set(), "", Counter()
        for _, role, text in own:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.strip(space)[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest(kinds)
        state, lines, left = 0, [], iter(own)
        for e in audit:
            _, role, text = next(left) if e != "I" else (0, "", "")
            if e == "D":
                continue
            if e in "RI":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    rows = repair.repair_conversations(repair.damage(df)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_repair_of_random_conversations(spark):
    """Nulls in every column, repeated rows, ties of turns, other roles, and columns named like the operator's own."""
    rng = random.Random(8)
    texts = ["Fine.", "Cut off", "  ", "", None, "Why? ", "Näh!\n", "a. b\t"]
    rows = []
    for conv in [None, *range(300)]:
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, t, t + 3, 2, None, -1])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "u"]), rng.choice(texts)))
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "kind", 1, True) for r in rows], "conv_id long, turn long, role string, text string, kind string, nth int, gone boolean")
    assert repaired(df.repartition(5)) == judged(rows)
    assert repaired(df.limit(0)) == {}


def test_repair_of_the_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.QUERIES["op12_cost_layers"](spark, SF).collect()}
    assert got == judged(rows)


def test_conversation_of_dropped_rows_only(spark):
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert repaired(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
