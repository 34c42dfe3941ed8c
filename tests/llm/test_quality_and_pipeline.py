import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import quality


def corpus(n=900, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    insults = ["vilewort", "grubnard", "skumble"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        kind = r.random()
        if kind < 0.12:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(insults)
        elif kind < 0.18:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.24:
            words = [w for w in words[:10] for _ in range(12)]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, int(not 0.12 <= kind < 0.24), int(kind < 0.12)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9000, None, "", "", 0), (None, "", "", "", 0), rows[3]], SCHEMA)
    shown = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, shown).collect()}
    assert len(out) == 902
    held = [x for x in labels if x[0] % 3 == 0]
    good = [out[i].kept for i, q, t in held if q and not t]
    bad = [out[i].kept for i, q, t in held if not q or t]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1
    kept = quality.keep_good(docs, shown)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.classify(docs, shown).collect())


def test_without_labels_and_empty(spark):
    rows, _ = corpus(120)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(out) == 120 and sum(r.kept for r in out) >= 80
    assert quality.classify(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_estimates_recover_planted_accuracies():
    r = np.random.Generator(np.random.PCG64(1))
    bad = r.random(200_000) < 0.1
    recall, false = np.array([0.9, 0.7, 0.5]), np.array([0.01, 0.02, 0.001])
    votes = r.random((200_000, 3)) < np.where(bad[:, None], recall, false)
    pattern, count = np.unique((votes * [1, 2, 4]).sum(1), return_counts=True)
    posterior, e = quality.expectation_maximisation(pattern, count.astype(float), (0, 1, 2))
    assert abs(e["prior"] - 0.1) < 0.02 and np.abs(e["recall"] - recall).max() < 0.05 and np.abs(e["false"] - false).max() < 0.01


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    base = tmp_path_factory.mktemp("sf")
    rows, labels = corpus(400, 3)
    clean = [x for x, y in zip(rows, labels) if y[1] and not y[2]]
    rows += [(1000 + k, x[1], "en", x[3], 0) for k, x in enumerate(clean[:30])]
    rows += [(2000 + k, x[1] + " tail", "en", x[3], 0) for k, x in enumerate([c for c in clean if len(c[1].split()) > 60][:30])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows, labels, clean


def test_stages(spark, folder):
    base, rows, labels, clean = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, base)
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        after[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == list(after)
    assert all(after[n].columns == columns for n in list(after)[:-1])
    first = {r.doc_id for r in after["quality classifier"].collect()}
    assert len({x[0] for x in clean} - first) <= 0.02 * len(clean)
    toxic = {y[0] for y in labels if y[2]}
    assert len(toxic & first) <= 0.15 * len(toxic)
    texts = [r.text for r in after["exact dedup"].collect()]
    assert len(texts) == len(set(texts)) == len({x[1] for x in rows if x[0] in first})
    near = {r.doc_id for r in after["near dedup"].collect()}
    assert not any(i >= 2000 for i in near)
    mixed = after["mixing"].collect()
    assert 0 < len(mixed) and {r.doc_id for r in mixed} <= near
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    total = words(after["near dedup"].collect())
    assert abs(words(mixed) - 1.5 * total) <= 0.02 * total
    pieces = after["packing"].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed}
    assert sum(p.piece == 0 for p in pieces) == len(mixed)
    fill = after["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(f.n == f.end <= 1024 for f in fill)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def through(spark, docs, base):
    """The pipeline's stages over docs; the rows of each."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, base)
        assert stage is corpus_pipeline.STAGES[-1][1] or docs.columns == columns
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        out.append(docs.collect())
    return out


def test_stages_with_nulls_long_texts_and_clashing_columns(spark, folder):
    base, rows, _, clean = folder
    odd = [(None, clean[0][1], "en", "a", 1), (9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, " ".join(x[1] for x in clean), "en", None, 5)]
    docs = spark.createDataFrame([*rows[:200], *odd, odd[0]], SCHEMA).withColumns({"kept": F.lit(1), "node": F.lit("x"), "key": F.lit(2), "size": F.lit(3), "text_sha256": F.lit("y")})
    good, exact, near, mixed, pieces = through(spark, docs, base)
    assert len({r.text for r in exact}) == len(exact) and {r.text or "" for r in exact} == {r.text or "" for r in good}
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact} and {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    assert sum(r.piece == 0 for r in pieces) == len(mixed) and all(r.kept == 1 and r.node == "x" for r in mixed)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    assert through(spark, docs, folder[0]) == [[]] * 5
