import pytest
from pyspark.sql import functions as F

from tracewright.operators.leases import Queue
from tracewright.plans import adapters as A
from tracewright.plans import retrieve as R
from tracewright.plans import runs
from tracewright.sources.tables import Catalog
from tracewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def filled(spark, root, n=6):
    q = Queue(Catalog(spark, str(root)))
    rows = spark.createDataFrame([("t", f"j{i}", "synthesize" if i % 2 else "expire", i, i) for i in range(n)], "tenant_id string, job_id string, kind string, available_at long, created_at long")
    assert q.add(rows).where("added").count() == n and q.add(rows).where("added").isEmpty()
    return q


def results(spark, leases, ok, error=None, owner=None):
    return spark.createDataFrame([("t", r.job_id, owner or r.owner, r.generation, ok, error) for r in leases], "tenant_id string, job_id string, owner string, generation int, ok boolean, error string")


def outcomes(df):
    return {r.job_id: r.outcome for r in df.collect()}


def test_two_claimers_at_once(spark, tmp_path, monkeypatch):
    """The second claimer publishes between the first one's read and commit: the first takes other jobs."""
    q, other = filled(spark, tmp_path), Queue(Catalog(spark, str(tmp_path)))
    append, taken = Catalog.append, {}

    def meanwhile(self, *args, **options):
        if self is q.catalog and not taken:
            taken["b"] = [r.job_id for r in other.claim("b", 100, 30, 2).collect()]
        return append(self, *args, **options)

    monkeypatch.setattr(Catalog, "append", meanwhile)
    mine = [r.job_id for r in q.claim("a", 100, 30, 3).collect()]
    assert taken["b"] == ["j0", "j1"] and mine == ["j2", "j3", "j4"]
    assert {r.job_id: (r.owner, r.state) for r in q.jobs().collect()} == {"j0": ("b", "leased"), "j1": ("b", "leased"), "j2": ("a", "leased"), "j3": ("a", "leased"), "j4": ("a", "leased"), "j5": (None, "pending")}
    assert [r.job_id for r in q.claim("c", 100, 30, 9).collect()] == ["j5"] and q.claim("c", 100, 30, 9).collect() == []


def test_a_lost_lease_counts_for_nothing(spark, tmp_path):
    q = filled(spark, tmp_path, 2)
    old = q.claim("a", 100, 30, 1, ["expire"]).collect()
    assert [r.job_id for r in old] == ["j0"]
    assert outcomes(q.settle(results(spark, old, True, owner="x"), 110)) == {"j0": "stale_lease"}
    new = q.claim("b", 131, 30, 1, ["expire"]).collect()
    assert [(r.job_id, r.generation, r.attempts) for r in new] == [("j0", 2, 2)]
    assert outcomes(q.settle(results(spark, old, True), 132)) == {"j0": "stale_lease"}
    assert outcomes(q.settle(results(spark, new, True), 132)) == {"j0": "completed"} == outcomes(q.settle(results(spark, new, True), 133))
    assert outcomes(q.settle(results(spark, new, False, "late"), 133)) == {"j0": "stale_lease"}
    late = q.claim("b", 200, 30, 1).collect()
    assert outcomes(q.settle(results(spark, late, True), 230)) == {"j1": "stale_lease"}  # the lease had run out


def test_dead_letters_are_stored(spark, tmp_path):
    q, now = filled(spark, tmp_path, 1), 100
    for attempt in range(1, 4):
        leases = q.claim("a", now, 30, 1).collect()
        want = "dead_letter" if attempt == 3 else "pending"
        assert outcomes(q.settle(results(spark, leases, False, f"e{attempt}"), now, most_attempts=3)) == {"j0": want}
        assert q.claim("a", now, 30, 1).collect() == []  # it waits
        now += 2 ** (attempt - 1)
    assert [(r.job_id, r.attempts, r.error) for r in q.dead_letters().collect()] == [("j0", 3, "e3")] and q.claim("a", 10**6, 30, 1).collect() == []
    assert q.revive(F.col("error") == "e3", 500).count() == 1 and [r.attempts for r in q.claim("a", 500, 30, 1).collect()] == [1]


# --- runs --------------------------------------------------------------------------------------------------------


def test_runs_are_stored_once_and_replayed(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path))
    docs, requests = A.documents(spark, SF), A.requests(spark, SF).where("query_id < 6")
    bound = spark.createDataFrame([("exact", 0), ("facet", 3)], "channel string, index_id long")
    none = spark.createDataFrame([(0, "exact", "deadline_exceeded")], "query_id long, channel string, code string")
    served = []

    def serve(asked):
        served.append(sorted(r.query_id for r in asked.select("query_id").collect()))
        return R.answer(docs, docs, asked, 1_700_000_000, (bound, bound), none, required=("exact", "facet"))

    snapshot = runs.snapshot_id(1_700_000_000, bound)
    half = requests.where("query_id % 2 = 0")
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.answer(c, "acme", half, snapshot, serve, 100)
    assert runs.stored(c, "retrieval_runs").isEmpty() and runs.stored(c, "run_hits").isEmpty()
    first = {r.query_id: (r.run_id, r.body) for r in runs.answer(c, "acme", half, snapshot, serve, 100).collect()}
    assert set(first) == {0, 2, 4} and '"disposition":"failed"' in first[0][1]
    served.clear()
    both = {r.query_id: (r.replayed, r.run_id, r.body) for r in runs.answer(c, "acme", requests, snapshot, serve, 200).collect()}
    assert served == [[1, 3, 5]] and {q: v[1:] for q, v in both.items() if v[0]} == first
    assert runs.stored(c, "retrieval_runs").count() == 6
    again = runs.record(c, "acme", requests, serve(requests), snapshot, 300)
    assert {r.outcome for r in again.collect()} == {"known"} and runs.stored(c, "retrieval_runs").count() == 6
    other = R.answer(docs, docs, requests, 1_700_000_000, (bound, bound), none.withColumn("query_id", F.lit(1).cast("long")), required=("exact", "facet"))
    assert "conflict" in {r.outcome for r in runs.record(c, "acme", requests, other, snapshot, 300).collect()}
    told = runs.explain(c, "acme", spark.createDataFrame([(v[1],) for v in both.values()], "run_id string")).collect()
    chosen = {}
    for r in told:
        assert r.version_id is None or len(r.hits) >= 1
        if r.selected:
            chosen.setdefault(r.run_id, []).append((r["rank"], r.version_id))
    for r in runs.stored(c, "retrieval_runs").collect():
        assert [v for _, v in sorted(chosen.get(r.run_id, []))] == r.selected
    assert runs.tampered(c, "acme").isEmpty() and runs.explain(c, "other", again).isEmpty()
    forged = runs.stored(c, "retrieval_runs").where("size(selected) > 0").limit(1).withColumn("run_id", F.lit("run_x")).withColumn("body", F.lit("{}")).drop("epoch")
    c.append("retrieval_runs", forged)
    assert {(r.run_id, r.reason) for r in runs.tampered(c, "acme").collect()} == {("run_x", "content_hash_mismatch"), ("run_x", "selected_without_gate")}


# --- streams -----------------------------------------------------------------------------------------------------


def test_state_of_keys_ends(spark, tmp_path):
    day = lambda d: f"timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,{d})"
    batches = [[("k", "a", 0)], [("k", "a", 1), ("l", "b", 20)], [("m", "c", 21)], [("k", "z", 22)], [("k", "z", 23)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, i) for r in rows], "key string, hash string, d int, n int")
        df.selectExpr("key", "hash", "n", f"{day('d')} AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        out = jobs.ingest_status(jobs.source(spark, str(tmp_path / "in"), schema), "key", "hash", "n", "ts", keep_seconds=5 * 86400)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.key, r.hash, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # after day 20 the state of k is gone: z is new there
    assert got == sorted([("k", "a", "accepted"), ("k", "a", "duplicate"), ("l", "b", "accepted"), ("m", "c", "accepted"), ("k", "z", "accepted"), ("k", "z", "duplicate")])


def test_late_rows_go_aside(spark, tmp_path):
    fresh, late = [], []
    take = lambda out: lambda rows, n: out.append((n, sorted(r.d for r in rows.collect())))
    handle = jobs.late_aside(str(tmp_path / "seen"), "ts", 2 * 86400, take(fresh), take(late))
    frame = lambda *days: spark.createDataFrame([(d,) for d in days], "d int").selectExpr("d", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,d) AS ts")
    for n, days in enumerate([(5, 1), (6, 4, 2), (9,), (7, 6)]):
        handle(frame(*days), n)
    handle(frame(7, 6), 3)  # handed on again after a crash: the same parts
    assert fresh == [(0, [1, 5]), (1, [4, 6]), (2, [9]), (3, [7]), (3, [7])] and late == [(0, []), (1, [2]), (2, []), (3, [6]), (3, [6])]
