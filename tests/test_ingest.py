import pytest

from tracewright.operators.evidence import CLASSES
from tracewright.plans import ingest
from tracewright.sources.tables import Catalog


def test_ingest_is_idempotent(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "tables"))
    requests = spark.createDataFrame([("t", "k1", "a", "do it", "learn_and_recall"), ("t", "k2", "b", "do", "deny"), ("t", "k3", "c", "gap", "learn_and_recall"), ("t", "k4", "none", "x", "learn_and_recall")], "tenant_id string, idempotency_key string, trace_key string, task string, consent string")
    events = spark.createDataFrame([("t", "a", 0, "w", True, "password = hunter2hunter2"), ("t", "a", 1, "r", True, "ok"), ("t", "b", 0, "w", True, ""), ("t", "c", 1, "w", True, "")], "tenant_id string, trace_key string, position int, tool_name string, succeeded boolean, value string")
    status = lambda: {r.idempotency_key: r.status for r in ingest.ingest(c, str(tmp_path / "archive"), requests, events).collect()}
    want = {"k1": "accepted", "k2": "rejected:consent", "k3": "rejected:positions", "k4": "rejected:events,positions,value_size"}
    assert status() == want
    assert [r.value for r in c.read("events").orderBy("position").collect()] == ["password = [REDACTED]", "ok"]
    assert status() == want | {"k1": "duplicate"} and c.head("events") == 0
    events = events.selectExpr("tenant_id", "trace_key", "position", "concat(tool_name, trace_key) AS tool_name", "succeeded", "value")
    assert status() == want | {"k1": "conflict"}


def test_outcomes_to_promotion(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    facts = spark.createDataFrame([(f"o{i}", f"i{i}", "p", CLASSES[0], "satisfied", 1000) for i in range(12)], "outcome_id string, injection_id string, predicate string, class string, verdict string, observed_at long")
    selections = spark.createDataFrame([(f"i{i}", "v", 900, 2000, True) for i in range(12)], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    assert {r.credit_class for r in ingest.record_outcomes(c, facts, selections, 1000).collect()} == {"causal_success"}
    assert [r.next_state for r in ingest.promote(c, 1000).collect()] == ["trial"]
    assert ingest.promote(c, 1100).collect() == []
    assert [r.next_state for r in ingest.promote(c, 9000).collect()] == ["active"]


def test_learned_identity_does_not_depend_on_the_trace(spark):
    rows = [(t, p, r, p > 0, p < 2, True, p == 2) for t in ("x", "y") for p, r in enumerate(["a", "a", "a"])]
    df = spark.createDataFrame(rows, "trace_id string, position int, resource string, reads boolean, writes boolean, succeeded boolean, goal boolean")
    got = ingest.learn(df).collect()
    assert len(got) == 2 and got[0].version_id == got[1].version_id and got[0].steps == ["a", "a", "a"]


def test_tables_of_one_commit_appear_together(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "x"), (2, "y")], "n int, tenant_id string")
    assert c.commit({"a": one, "b": one}) == {"a": 0, "b": 0}

    def crash(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:  # stopped after the data and before the commit: nothing is seen, and it can be repeated
        m.setattr(Catalog, "_publish", crash)
        with pytest.raises(OSError):
            c.commit({"a": one, "b": one})
    assert c.head("a") == c.head("b") == 0 and c.read("a").count() == 2
    assert c.commit({"a": one, "b": one}, {"a": 0}) == {"a": 1, "b": 1}
    with pytest.raises(RuntimeError):
        c.append("a", one, expected=0)
    assert not c._publish(1, {("a", 9): "9-0"}) and c.head("a") == 1
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", crash)
        with pytest.raises(OSError):
            c.erase("a", "tenant_id", "x")
    assert c.read("a").count() == 4
    assert c.erase("a", "tenant_id", "x") == 2 and [r.n for r in c.read("a", as_of=0).collect()] == [2] and c.read("b").count() == 4


def test_a_crash_inside_ingest_converges(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "tables"))
    requests = spark.createDataFrame([("t", "k1", "a", "do it", "learn_and_recall")], "tenant_id string, idempotency_key string, trace_key string, task string, consent string")
    events = spark.createDataFrame([("t", "a", 0, "w", True, "ok")], "tenant_id string, trace_key string, position int, tool_name string, succeeded boolean, value string")
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.ingest(c, str(tmp_path / "archive"), requests, events)
    assert c.head("events") == -1
    for want in ("accepted", "duplicate"):
        assert [r.status for r in ingest.ingest(c, str(tmp_path / "archive"), requests, events).collect()] == [want]
        assert c.read("events").count() == c.read("receipts").count() == c.read("outbox").count() == 1


def test_unsafe_versions_are_quarantined(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    facts = spark.createDataFrame([("o", "i", "p", CLASSES[0], "satisfied", 1000)], "outcome_id string, injection_id string, predicate string, class string, verdict string, observed_at long")
    selections = spark.createDataFrame([("i", "v", 900, 2000, True)], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    ingest.record_outcomes(c, facts, selections, 1000)
    harm = spark.createDataFrame([("v", 1)], "version_id string, unsafe long")
    assert [r.next_state for r in ingest.promote(c, 1000, unsafe=harm).collect()] == ["quarantined"]
