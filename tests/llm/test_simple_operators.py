import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import chat, exact_dedup, sharding, urlfilter, vafile
from tracewright.llm.queries import URL_RULES

# --- sharding ----------------------------------------------------------------------------------------------------


def test_external_shuffle(spark):
    rows = [(i, f"text {i % 7} " * (i % 50), "clash", 5) for i in range(500)] + [(None, None, "", 0), (3, "", "", 0), (3, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.external_shuffle(df.drop("slot"), 5, bucket_bytes=4000).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert set(by_shard) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    more = {r.doc_id: r.shard for r in sharding.external_shuffle(df.drop("slot"), 6).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in got)
    again = sharding.external_shuffle(df.drop("slot").repartition(7), 5, bucket_bytes=4000).collect()
    key = lambda r: (r.shard, r.slot, r.doc_id, r.text)
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, got)))
    in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert in_order != sorted(in_order)
    assert sharding.external_shuffle(df.drop("slot").limit(0), 5).collect() == []


# --- chat --------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi", "\\b\\h\\e", "### ", "</turn", ">", "", None, "a: b", "\\", "é\n", "</turn>\n"]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b", "### x", None, "assistant"]), r.choice(nasty), "x") for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "assistant", "lost", ""), (5, None, "user", "no turn", ""), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    from pyspark.sql import functions as F

    got = {x.conv_id: x for x in chat.gathered(chat.examples(out)).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted(((x[1] is not None, x[1] or 0), x[2] or "", x[3] or "") for x in rows if x[0] == c)
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].trained == "".join(t[2] for t in turns if t[1] == "assistant")
    contexts = Counter()
    for e in chat.examples(out).where("turn_no IS NOT NULL").collect():
        assert e.formatted.startswith(e.context + e.target) and e.context.count("</turn>\n") == e.turn_no
        contexts[e.conv_id] += len(e.context)
    assert {c: x.context_chars for c, x in got.items()} == {c: contexts[c] for c in got}
    assert chat.format_conversations(df.limit(0)).collect() == []


# --- exact dedup -------------------------------------------------------------------------------------------------


def test_colliding_chunk_names_are_given_anew(spark):
    """Names of one byte: chunks of the same name are told apart by their bytes, and all are named by another seed."""
    texts = [f"{i} " * 400 for i in range(24)]
    df = spark.createDataFrame([(i, texts[i % 24]) for i in range(48)], "doc_id long, text string")
    rows, ids = exact_dedup.identified(df, name_bytes=1)
    assert ids.count() == ids.select("name").distinct().count()
    assert rows.count() == 48 and {len(x.names) for x in rows.collect()} == {len(exact_dedup.boundaries(exact_dedup.cut_points(np.frombuffer(t.encode(), np.uint8)), 0, len(t))) for t in texts}
    with pytest.raises(RuntimeError, match="names"):
        exact_dedup.identified(spark.createDataFrame([(i, str(i)) for i in range(300)], "doc_id long, text string"), name_bytes=1, tries=2)


def test_exact_groups(spark):
    r = random.Random(1)
    long = ["".join(r.choice("abc \n") for _ in range(n)) for n in (600, 5000, 60000)] + ["x" * 40000]
    pool = ["", None, "a", "A", " a", "é", *long, long[1] + "x", "x" + long[1]]
    rows = [(i, r.choice(pool), "x", b"y") for i in range(200)] + [(None, "only null id", "", b""), (7, "rep", "", b""), (7, "rep", "", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, names binary")
    got = exact_dedup.groups(df).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want, stays = Counter(), set()
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (t or "") not in stays  # of rows repeated in full one stays
        stays |= {t or ""} if kept else set()
        want[(i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), keep, len(ids), kept)] += 1
    assert Counter(map(tuple, got)) == want
    kept = exact_dedup.drop_copies(df).collect()
    assert len(kept) == len(groups) and set(kept[0].asDict()) == {"doc_id", "text", "keep_id", "names"}
    assert exact_dedup.groups(df.limit(0)).collect() == []
    store = exact_dedup.chunk_store(df).collect()
    assert len({bytes(s.bytes) for s in store}) == len(store) == len({bytes(s.name) for s in store})


def test_equal_content_is_cut_alike():
    r = random.Random(0)
    body = bytes(r.randrange(256) for _ in range(50_000))
    a = [p for _, p in exact_dedup.chunks([b"head", body])][1]
    b = [p for _, p in exact_dedup.chunks([body])][0]
    assert a == b and b"".join(a) == body
    moved = [p for _, p in exact_dedup.chunks([b"inserted" + body])][0]
    assert len(set(moved) & set(b)) > len(b) // 2


# --- vectors -----------------------------------------------------------------------------------------------------


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 64)
    r = np.random.Generator(np.random.PCG64(1))
    rows = [(i, [float(x) for x in r.normal(size=6)], "c") for i in range(300)]
    rows += [(i, [0.5] * 6, "tie") for i in range(300, 320)]
    rows += [(1000, None, ""), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (1100, [float("nan")] * 6, ""), (1150, [float("inf")] + [0.0] * 5, ""), (1200, [1.0, 2.0], ""), (1201, [3.0, 1.0], ""), (1250, [], ""), (None, [1.0] * 6, "")]
    rows += [(50, [8 * x for x in rows[50][1]], "again"), (50, [0.25] * 6, "same id"), (51, rows[51][1], "again")] + [(2000 + i, [0.5] * 6, "tie") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    from pyspark.sql import functions as F

    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in vafile.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sum(r[0] == 50 for r in want) == 15 and any(r[0] == r[2] for r in want)
    assert got == sorted(want)
    assert vafile.top_k(df.limit(0), F.lit(True), 5).collect() == []


def test_few_exact_vectors_are_read(spark):
    from pyspark.sql import functions as F

    r = np.random.Generator(np.random.PCG64(2))
    exact = np.floor(256 * r.normal(size=(4000, 16))).astype(np.int64)
    codes, low, step = vafile.approximate(exact)
    assert (low + codes * step <= exact).all() and (exact < low + (codes + 1) * step).all()
    upper, width = vafile.upper_bounds(exact[:50], codes, low, step)
    scores = exact[:50] @ exact.T
    assert (scores <= upper).all() and (upper - width[:, None] <= scores).all()
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in enumerate(exact)], "vec_id long, embedding array<double>")
    reads = {x.query_id: x.n_read for x in vafile.top_k(df, F.col("vec_id") % 50 == 0, 5, count_reads=True).collect()}
    assert set(reads) == set(range(0, 4000, 50)) and sum(reads.values()) < 4000 * 80 * 0.02


def test_what_leaves_the_scan_of_exact_vectors(spark):
    """Rows asked for, and hardly any other."""
    table = spark.range(20_000).selectExpr("id AS row", "array(id, id) AS v").repartition(4)
    asked = spark.range(300).selectExpr("id * 61 AS row")
    left = {r.row for r in vafile.fetch(table, asked).collect()}
    assert left >= {i * 61 for i in range(300)} and len(left) < 300 + 100
    assert vafile.fetch(table, asked.limit(0)).count() == 0


def test_scores_beyond_a_long_are_an_error(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        vafile.top_k(df, F.col("vec_id") == 0, 5).collect()


# --- urls --------------------------------------------------------------------------------------------------------


def slow_judgement(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://", "http://A.EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "http://com/", "http://xcom/", "http://a.com", "ftp://q.net/es/1", "http://q.net/es", "http://q.net?x=/fr/", "http://h#f/x", "http://é.com/ü"]
    urls += [f"http://good{i}.site.com/page/{i}" for i in range(80)] + [f"http://bad{i}.spam.net/fr/casino/{i}" for i in range(80)]
    urls += [f"http://good{i}.site.org/page/{i}" for i in range(20)] + [f"http://bad{i}.spam.org/fr/casino/{i}" for i in range(20)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = slow_judgement(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    unfitted = [r for r in got.values() if r.rule is None and r.url and ".org/" in r.url]
    right = sum((r.verdict == "allow") == ("good" in r.url) for r in unfitted)
    assert right >= 0.9 * len(unfitted)
    assert {r.verdict for r in urlfilter.judge(df.where("url like '%site.com%'"), URL_RULES).collect()} == {"allow"}
    assert urlfilter.judge(df.limit(0), URL_RULES).collect() == []


def test_character_model_is_a_distribution():
    model = urlfilter.CharModel(["abab", "abc", "b"], 2, 5)
    for context in ("", "a", "ab", "zz", "\x02\x02"):
        seen = sum(np.exp(model.log(context, c)) for c in "abc\x03")
        assert 0 < seen <= 1 + 1e-9


# --- shared folder -----------------------------------------------------------------------------------------------


def test_written_tables_can_be_forgotten(spark):
    from tracewright.llm import common

    common.forget(spark)
    df = common.materialize(spark.range(5).toDF("x"), "five")
    assert df.count() == 5 and common.forget(spark) == 1
    assert common.forget(spark) == 0
