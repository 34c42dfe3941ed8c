import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.sources import tables
from tracewright.streaming import jobs


def test_catalog_epochs(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame([(i, t) for i, t in x], "id int, tenant string")
    assert c.head("t") == -1
    assert c.append("t", rows((1, "a")), expected=-1) == 0 and c.append("t", rows((2, "b"), (3, "a"))) == 1
    with pytest.raises(RuntimeError):
        c.append("t", rows((4, "a")), expected=0)
    assert sorted((r.id, r.epoch) for r in c.read("t").collect()) == [(1, 0), (2, 1), (3, 1)]
    assert [r.id for r in c.read("t", as_of=0).collect()] == [1]
    assert c.erase("t", "tenant", "a") == 2 and [r.id for r in c.read("t").collect()] == [2]


def test_migrations(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    first = [(1, "a", "x INT"), (2, "b", "y STRING")]
    assert c.migrate(first) == [1, 2] and c.migrate(first) == [] and c.migrate([*first, (3, "a", "x INT, z INT")]) == [3]
    with pytest.raises(ValueError):
        c.migrate([(1, "a", "x BIGINT"), *first[1:]])
    with pytest.raises(ValueError):
        c.migrate([(2, "b", "y STRING")])


def test_archive(spark, tmp_path):
    body = lambda s: (s, hashlib.sha256(s.encode()).hexdigest())
    df = lambda *x: spark.createDataFrame([("acme", "v1", h, b) for b, h in x], "tenant_id string, schema_version string, content_hash string, body string")
    first, second = body("one"), body("two two")
    assert [r.reused for r in tables.archive_put(df(first), str(tmp_path)).collect()] == [False]
    assert {r.content_hash: r.reused for r in tables.archive_put(df(first, second), str(tmp_path)).collect()} == {first[1]: True, second[1]: False}
    with pytest.raises(ValueError):
        tables.archive_put(df(("one", second[1])), str(tmp_path))
    wanted = spark.createDataFrame([(first[1],), (second[1],)], "content_hash string")
    assert [r.body for r in tables.archive_get(spark, str(tmp_path), wanted, 4).collect()] == ["one"]


def test_wipe_and_journal(spark, tmp_path):
    rows = [(t, "v1", hashlib.sha256(t.encode()).hexdigest(), t) for t in ("acme", "other")]
    tables.archive_put(spark.createDataFrame(rows, "tenant_id string, schema_version string, content_hash string, body string"), str(tmp_path / "a")).count()
    assert tables.archive_wipe(spark, str(tmp_path / "a"), "acme") and tables.archive_wipe(spark, str(tmp_path / "a"), "acme")
    assert [r.body for r in spark.read.parquet(str(tmp_path / "a/canonical")).collect()] == ["other"]
    assert tables.journal(spark, str(tmp_path / "j"), "erase-acme", {"tenant": "acme"}) and not tables.journal(spark, str(tmp_path / "j"), "erase-acme", {"tenant": "acme"})
    with pytest.raises(ValueError):
        tables.journal(spark, str(tmp_path / "j"), "erase-acme", {"tenant": "x"})


def test_strict_json(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"job_id": "a", "attempts": 1}\n')
    assert tables.load_json(spark, str(tmp_path / "q.json"), "queue").first().job_id == "a"
    (tmp_path / "bad.json").write_text('{"job_id": "a", "attempts": "x"}\n')
    with pytest.raises(Exception):
        tables.load_json(spark, str(tmp_path / "bad.json"), "queue").collect()


def test_batch_identities():
    batch = tables.build_batch("t", {"task": "x", "environment": None}, [{"kind": "tool"}, {"kind": "tool"}])
    trace = batch["trace"] | {"id": ""}
    assert batch["trace"]["id"] == "tr_" + hashlib.sha256(json.dumps({"tenant_id": "t", "trace": trace}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert batch["events"][0]["id"] != batch["events"][1]["id"] and batch["events"][1]["position"] == 1
    assert canonical.dumps(batch).startswith('{"events":[{"id":"ev_')


def test_authorization(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"token_hash": hashlib.sha256(b"s").hexdigest(), "tenant_id": "t", "scopes": ["read"], "consent": "deny", "region": "eu"}))
    known = tables.credentials(spark, str(tmp_path / "c.json"))
    requests = spark.createDataFrame([("s", 1), ("x", 2)], "token string, id int")
    assert [r.id for r in tables.authorize(requests, known, "read").collect()] == [1]
    assert tables.authorize(requests, known, "write").isEmpty()


def test_ingest_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", "b", 3), ("k", "a", 2), ("k", "a", 1), ("l", "c", 1), ("m", None, 1), ("m", None, 2), ("m", "d", 3)], "key string, hash string, n int")

    def drain():
        out = jobs.ingest_status(jobs.source(spark, str(tmp_path / "in"), rows.schema), "key", "hash", "n")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain()
    rows.where("key = 'l'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain()
    got = {(r.key, r.hash, r.status): r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("key", "hash", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {("k", "a", "accepted"): 1, ("k", "a", "duplicate"): 1, ("k", "b", "conflict"): 1, ("l", "c", "accepted"): 1, ("l", "c", "duplicate"): 1, ("m", None, "accepted"): 1, ("m", None, "duplicate"): 1, ("m", "d", "conflict"): 1}


def test_relay_and_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 't' AS tenant_id, id % 2 = 0 AS unsafe FROM (SELECT explode(sequence(0, 119)) AS id)")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema)
    jobs.relay(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 120
    w = jobs.exposure_windows(stream, "ts", 3600, "1 hour")
    w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.exposures, r.unsafe) for r in spark.sql("SELECT * FROM w").collect()) == [(60, 30), (60, 30)]
    jobs.first_seen(stream, "tenant_id", "ts").writeStream.format("memory").queryName("f").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT * FROM f").count() == 1
