import pyarrow.parquet as pq
import pytest

from tracewright.plans import ingest
from tracewright.sources.erasure import Erasure
from tracewright.sources.tables import Catalog, ReadersHold


def filled(spark, root):
    c = Catalog(spark, f"{root}/tables")
    requests = spark.createDataFrame([(t, "k", "a", f"task of {t}", "learn_and_recall") for t in ("acme", "other")], "tenant_id string, idempotency_key string, trace_key string, task string, consent string")
    events = spark.createDataFrame([(t, "a", 0, "w", True, f"value of {t}") for t in ("acme", "other")], "tenant_id string, trace_key string, position int, tool_name string, succeeded boolean, value string")
    ingest.ingest(c, f"{root}/archive", requests, events)
    c.append("notes", spark.createDataFrame([("acme", 1), ("acme", 2), ("other", 3)], "tenant_id string, n int"))
    c.append("notes", spark.createDataFrame([("other", 4)], "tenant_id string, n int"))
    c.append("plain", spark.createDataFrame([(1,)], "n int"))
    return c, Erasure(c, f"{root}/archive", f"{root}/journal"), requests, events


def on_disk(root):
    """Rows of the tenant in any file below root, published or not."""
    held = 0
    for f in root.rglob("*.parquet"):
        t = pq.read_table(f, partitioning=None).to_pylist()
        held += sum("acme" in str(r) and "request_id" not in r for r in t)
    return held


WANT = {"traces": 1, "events": 1, "notes": 2, "outbox": 1, "receipts": 1}


def settled(c, root, receipt):
    assert on_disk(root) == 0 and receipt["rows"] == WANT and receipt["archive_objects"] == 1
    assert sorted(r.n for r in c.read("notes").collect()) == [3, 4] and c.read("events").count() == 1 and c.read("plain").count() == 1
    assert [r.n for r in c.read("notes", as_of=0).collect()] == [3]


@pytest.mark.parametrize("phase", ["intend", "fence", "clear_archive", "clear_tables", "clear_folders"])
def test_a_stop_after_any_phase_is_made_good(spark, tmp_path, monkeypatch, phase):
    c, erasure, _, _ = filled(spark, tmp_path)
    assert on_disk(tmp_path) > 4
    done = getattr(Erasure, phase)

    def stop(self, *args):
        done(self, *args)
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Erasure, phase, stop)
        with pytest.raises(OSError):
            erasure.erase("r1", "acme", 100)
    receipt = erasure.erase("r1", "acme", 200)
    settled(c, tmp_path, receipt)
    assert erasure.erase("r1", "acme", 300) == receipt and erasure.resume(400) == [receipt]


@pytest.mark.parametrize("when", ["before the commit", "after the commit"])
def test_a_stop_inside_the_rewrite_is_made_good(spark, tmp_path, monkeypatch, when):
    c, erasure, _, _ = filled(spark, tmp_path)
    publish, fences = Catalog._publish, []

    def stop(self, number, names):
        if any(t == "_fences" for t, _ in names):
            return publish(self, number, names)
        if when == "after the commit":
            assert publish(self, number, names)
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", stop)
        with pytest.raises(OSError):
            erasure.erase("r1", "acme", 100)
    assert not fences and on_disk(tmp_path) > 0
    settled(c, tmp_path, erasure.resume(200)[0])


def test_readers_keep_their_folders_until_they_let_go(spark, tmp_path):
    c, erasure, _, _ = filled(spark, tmp_path)
    view, later = c.pin(until=1000), c.pin(until=150)
    with pytest.raises(ReadersHold):
        erasure.erase("r1", "acme", 100)
    assert view.read("notes").count() == later.read("notes").count() == 4 and c.read("notes").count() == 2
    after = c.pin(until=10_000)  # taken after the commit: does not hold what it cannot see
    view.unpin()
    with pytest.raises(ReadersHold):
        erasure.erase("r1", "acme", 149)
    settled(c, tmp_path, erasure.erase("r1", "acme", 150))
    assert after.read("notes").count() == 2


def test_no_write_passes_a_fence(spark, tmp_path, monkeypatch):
    c, erasure, requests, events = filled(spark, tmp_path)
    write = Catalog._publish
    late = Catalog(spark, c.root)

    def fenced_meanwhile(self, number, names):
        if self is late:
            monkeypatch.setattr(Catalog, "_publish", write)
            erasure.fence("r1", "acme")
            with pytest.raises(RuntimeError):  # the commit number is taken, and the fences have moved
                assert not write(self, number, names)
                raise RuntimeError
        return write(self, number, names)

    monkeypatch.setattr(Catalog, "_publish", fenced_meanwhile)
    try:
        late.append("notes", spark.createDataFrame([("acme", 9), ("other", 9)], "tenant_id string, n int"))
    except RuntimeError:
        pass
    monkeypatch.setattr(Catalog, "_publish", write)
    erasure.erase("r1", "acme", 100)
    assert on_disk(tmp_path) == 0
    c.append("notes", spark.createDataFrame([("acme", 5), ("other", 6)], "tenant_id string, n int"))
    assert c.read("notes").where("tenant_id = 'acme'").isEmpty() and not c.read("notes").where("n = 6").isEmpty()
    c.commit({"notes": spark.createDataFrame([("acme", 7)], "tenant_id string, n int"), "new": spark.createDataFrame([("acme",)], "tenant_id string")})
    again = {r.tenant_id: r.status for r in ingest.ingest(c, str(tmp_path / "archive"), requests.withColumn("idempotency_key", requests.trace_key), events).collect()}
    assert again == {"acme": "rejected:tenant_erased", "other": "accepted"} and on_disk(tmp_path) == 0


def test_one_request_one_tenant(spark, tmp_path):
    _, erasure, _, _ = filled(spark, tmp_path)
    erasure.erase("r1", "acme", 100)
    for request, tenant in (("r1", "other"), ("r2", "acme")):
        with pytest.raises(ValueError):
            erasure.erase(request, tenant, 100)


def test_tenants_by_number(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "tables"))
    c.append("jobs", spark.createDataFrame([(7, 1), (8, 2)], "tenant_id long, n int"))
    c.append("notes", spark.createDataFrame([("7", 1), ("x", 2)], "tenant_id string, n int"))
    receipt = Erasure(c, str(tmp_path / "archive"), str(tmp_path / "journal")).erase("r", "7", 1)
    assert receipt["rows"] == {"jobs": 1, "notes": 1} and receipt["archive_objects"] == 0
    c.append("jobs", spark.createDataFrame([(7, 1), (9, 2)], "tenant_id long, n int"))
    assert sorted(r.tenant_id for r in c.read("jobs").collect()) == [8, 9]
