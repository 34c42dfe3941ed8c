"""The stored vector index and the stored inverted index, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import channels, postings, vectorindex
from tracewright.operators.manifests import VectorIndex
from tracewright.sources.tables import Catalog

# --- vectors -----------------------------------------------------------------------------------------------------


def clustered(n, dimension=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dimension))
    return centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, dimension))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three epochs: 3,000 vectors, 200 of them again with other values, then one document revised without a vector."""
    c, manifest = Catalog(spark, str(tmp_path_factory.mktemp("vectors"))), VectorIndex("e1", overfetch=4)
    x, y = clustered(3000), clustered(200, seed=2)
    rows = [(i, v.tolist(), [f"f{i % 5}"]) for i, v in enumerate(x)] + [(3000, [0.0] * 16, ["f0"]), (3001, None, ["f0"])]
    first = vectorindex.quantized(spark.createDataFrame(rows, "version_id long, vector array<double>, facets array<string>"))
    vectorindex.provision(c, manifest, first, lists=40)
    vectorindex.put(c, manifest, first)
    again = [(i, v.tolist(), [f"f{i % 5}"]) for i, v in enumerate(y)]
    vectorindex.put(c, manifest, vectorindex.quantized(spark.createDataFrame(again, "version_id long, vector array<double>, facets array<string>")))
    latest = {i: v for i, v in enumerate(x)} | {i: v for i, v in enumerate(y)}
    return c, manifest, latest


def quantized(v):
    norm = math.sqrt(sum(float(z) * float(z) for z in v))
    return [int(math.copysign(math.floor(abs(float(z) / norm * 1_000_000) + 0.5), z)) for z in v] if norm else None


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(40))]
    return spark.createDataFrame(rows, "query_id long, vector array<double>").select("query_id", S.quantize(F.col("vector"), S.PPM).alias("qv"))


def nearest(latest, queries, limit, fits=lambda q, i: True):
    docs = {i: np.array(quantized(v), np.int64) for i, v in latest.items() if quantized(v)}
    ids = np.array(sorted(docs))
    every = np.array([docs[i] for i in ids])
    out = set()
    for r in queries.collect():
        scores = every @ np.array(r.qv, np.int64)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0 and fits(r.query_id, i))[:limit]
        out |= {(r.query_id, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    return out


def hits(df):
    return {(r.query_id, r.version_id, r.score, r["rank"]) for r in df.collect()}


def test_exact_search_equals_brute_force(stored, asked):
    c, manifest, latest = stored
    index = vectorindex.open_index(c, manifest)
    found = vectorindex.search(index, asked, 10, exact=True)
    assert hits(found) == nearest(latest, asked, 10)


def test_pool_search_recalls(stored, asked, spark):
    c, manifest, latest = stored
    found = vectorindex.search(vectorindex.open_index(c, manifest), asked, 10)
    true = spark.createDataFrame([x[:2] for x in nearest(latest, asked, 10)], "query_id long, version_id long")
    assert vectorindex.recall(found, true) >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()


def test_earlier_epoch_facets_and_revised_documents(stored, asked, spark):
    c, manifest, latest = stored
    first = vectorindex.open_index(c, manifest, as_of=0)
    old = {i: v for i, v in enumerate(clustered(3000))}
    assert hits(vectorindex.search(first, asked, 5, exact=True)) == nearest(old, asked, 5)
    restricted = asked.withColumn("facets", F.when(F.col("query_id") % 2 == 0, F.array(F.concat(F.lit("f"), F.col("query_id") % 5))))
    fits = lambda q, i: q % 2 or i % 5 == q % 5
    index = vectorindex.open_index(c, manifest)
    assert hits(vectorindex.search(index, restricted, 10, exact=True)) == nearest(latest, asked, 10, fits)
    # documents 0 to 9 were revised in epoch 5 and have no vector of that revision
    epochs = index.rows.select("version_id", "epoch").unionByName(spark.range(10).select(F.col("id").alias("version_id"), F.lit(5).cast("long").alias("epoch")))
    left = {i: v for i, v in latest.items() if i >= 10}
    assert hits(vectorindex.search(index, asked, 10, documents=epochs, exact=True)) == nearest(left, asked, 10)


def test_the_manifest_names_the_index(stored, spark, asked):
    c, manifest, _ = stored
    assert vectorindex.provision(c, manifest, None) == manifest.table()
    other = VectorIndex("e1", overfetch=9)
    assert other.table() != manifest.table()
    empty = vectorindex.quantized(spark.createDataFrame([], "version_id long, vector array<double>"))
    vectorindex.provision(c, other, empty)
    vectorindex.put(c, other, empty)
    assert vectorindex.search(vectorindex.open_index(c, other), asked, 5).collect() == []


def test_few_lists_are_opened(stored, asked):
    """Most vectors stay unopened: the lists that bounds leave, not the whole table, meet a query."""
    c, manifest, latest = stored
    index = vectorindex.open_index(c, manifest)
    lists = vectorindex.distances(index, asked)
    kth = vectorindex.search(index, asked, 5, exact=True).where("rank = 5").select("query_id", F.col("score").alias("kth"))
    reached = lists.join(kth, "query_id").where("bound >= kth").agg(F.sum("n").alias("n")).first().n
    assert reached < 0.7 * 40 * len(latest)


# --- words -------------------------------------------------------------------------------------------------------


def texts(n, seed=4):
    """A stop word in every text, words of all frequencies, and some rare ones."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return ["the " + " ".join(rng.choices(pool, weights, k=rng.randint(5, 40))) + (f" Rare{i % 50}" if i % 3 == 0 else "") for i in range(n)]


def bm25(docs, queries, limit, k1=1.2, b=0.75):
    toks = {i: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for i, t in docs.items()}
    tf = {i: Counter(t) for i, t in toks.items()}
    df = Counter(w for t in tf.values() for w in t)
    n, average = len(docs), sum(map(len, toks.values())) / len(docs)
    out = set()
    for q, text in queries:
        scores = defaultdict(float)
        for w in set(text.lower().split()):
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            for i in tf:
                if tf[i][w]:
                    scores[i] += idf * tf[i][w] * (k1 + 1) / (tf[i][w] + k1 * (1 - b + b * len(toks[i]) / average))
        best = sorted((-math.floor(s * 1_000_000 + 0.5), i) for i, s in scores.items())[:limit]
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(best)}
    return out


def test_inverted_index_by_epochs(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    old, new = dict(enumerate(texts(1500))), dict(enumerate(texts(300, seed=9), 1400))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "version_id long, task string")
    postings.publish(c, frame(old))
    postings.publish(c, frame(new | {5: "nothing of what was"}))
    queries = [(1, "the rare1 w3 w77"), (2, "the"), (3, "w1 w2 the w9 w30 w200 w333"), (4, "unknown words"), (5, "rare7 rare8 the w0")]
    q = spark.createDataFrame(queries, "query_id long, task string")
    got = lambda as_of: hits(postings.search(*postings.current(c, as_of), q, 10))
    assert got(0) == bm25(old, queries, 10)
    assert got(None) == bm25(old | new | {5: "nothing of what was"}, queries, 10)


def test_stop_word_blocks_stay_closed(spark):
    docs = {i: t + (f" rare{i % 7}" * 3 if i % 400 == 0 else "") for i, t in enumerate(texts(20_000, seed=6))}
    d = spark.createDataFrame(sorted(docs.items()), "version_id long, task string").cache()
    q = spark.createDataFrame([(1, "the rare3"), (2, "the rare4 w399")], "query_id long, task string")
    blocks, sizes = postings.build(d).cache(), postings.lengths(d)
    chosen, scored = postings.opened(blocks, sizes, q, 5)
    stop = chosen.where("term = 'the'").count()
    assert stop < 0.8 * 2 * blocks.where("term = 'the'").count()
    assert hits(channels.ranked(scored, "bm25", 5)) == hits(channels.bm25(d, q, 5))


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_facets_against_brute_force(spark, limit):
    r = random.Random(limit)
    value = lambda n: None if r.random() < 0.05 else f"v{min(r.randrange(n), r.randrange(n))}"
    some = lambda: None if r.random() < 0.05 else [f"c{min(r.randrange(9), r.randrange(9))}" for _ in range(r.randrange(4))]
    docs = [(i * 7919 % 997, value(3), value(4), some()) for i in range(400)]
    asked = [(i, value(3), value(4), some()) for i in range(25)] + [(99, None, None, None)]
    got = channels.facet(spark.createDataFrame(docs, "version_id long, environment string, harness string, contracts array<string>"), spark.createDataFrame(asked, "query_id long, environment string, harness string, contracts array<string>"), limit)
    want = set()
    for q, e, h, c in asked:
        scored = [(4 * (e is not None and e == e2) + 2 * (h is not None and h == h2) + bool(set(c or ()) & set(c2 or ())), v) for v, e2, h2, c2 in docs]
        best = sorted((x for x in scored if x[0]), key=lambda x: (-x[0], x[1]))[:limit]
        want |= {(q, v, s, k + 1) for k, (s, v) in enumerate(best)}
    assert {(x.query_id, x.version_id, x.score, x["rank"]) for x in got.collect()} == want


def test_a_facet_that_all_share_meets_few_versions(spark):
    docs = spark.range(20_000).selectExpr("id AS version_id", "if(id < 0, 'x', 'prod') AS environment", "if(id < 0, 'x', 'h') AS harness", "array(if(id < 0, 'x', 'c')) AS contracts")
    asked = spark.range(200).selectExpr("id AS query_id", "if(id < 0, 'x', 'prod') AS environment", "if(id < 0, 'x', 'h') AS harness", "array(if(id < 0, 'x', 'c')) AS contracts")
    out = channels.facet(docs, asked, 3)
    assert {(r.version_id, r.score) for r in out.where("query_id = 7").collect()} == {(0, 7), (1, 7), (2, 7)} and out.count() == 600
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
