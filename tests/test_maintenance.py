from pyspark.sql import functions as F

from tracewright.operators.evidence import CLASSES
from tracewright.operators.leases import Queue
from tracewright.plans import ingest, maintenance, runs
from tracewright.sources.tables import Catalog


def graph(spark, *rows):
    return spark.createDataFrame(rows, "tenant_id string, epoch_no long, planner string, policy string, src string, dst string, kind string")


def test_all_kinds_run_from_the_queue(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    q = Queue(c)
    jobs = [(t, f"{k}-{t}", k, 0, 0) for k in maintenance.KINDS for t in ("t", "u")]
    q.add(spark.createDataFrame(jobs, "tenant_id string, job_id string, kind string, available_at long, created_at long"))
    # runs: one of t is over
    held = [(t, r, 1, "h", "s", "abstained", None, [], [], "{}", "x", 0, e) for t, r, e in (("t", "r1", 50), ("t", "r2", 5000), ("u", "r3", 5000))]
    c.append("retrieval_runs", spark.createDataFrame(held, runs.TABLES["retrieval_runs"]))
    c.append("run_hits", spark.createDataFrame([("t", "r1", "exact", 1, 1, 1), ("t", "r2", "exact", 1, 1, 1)], runs.TABLES["run_hits"]))
    # credits of a version that may rise to trial; nothing is active, so there is nothing to roll back
    facts = spark.createDataFrame([(f"o{i}", f"i{i}", "p", CLASSES[0], "satisfied", 1000) for i in range(5)], "outcome_id string, injection_id string, predicate string, class string, verdict string, observed_at long")
    selections = spark.createDataFrame([(f"i{i}", "v", 900, 2000, True) for i in range(5)], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    ingest.record_outcomes(c, facts, selections, 1000)
    # exposure: u's counter is wrong
    assigned = spark.createDataFrame([("t", 0, False), ("t", 0, True), ("u", 0, False)], "tenant_id string, window_start long, unsafe boolean")
    budgets = spark.createDataFrame([("t", 0, 2, 1), ("u", 0, 7, 0)], "tenant_id string, window_start long, exposures long, unsafe long")
    # projection: what is rebuilt for u differs
    maintenance.publish(c, "documents", spark.createDataFrame([("t", "a", "1"), ("t", "b", "2"), ("u", "a", "3")], "tenant_id string, id string, body string"), "g1")
    shadow = spark.createDataFrame([("t", "b", "2"), ("t", "a", "1"), ("u", "a", "forged")], "tenant_id string, id string, body string")
    edges = graph(spark, ("t", 1, "p", "q", "x", "y", "k"), ("u", 1, "p", "q", "x", "y", "k"))
    handlers = {
        "transient_expiry": maintenance.expire_runs(c), "lifecycle_evaluation": maintenance.evaluate_lifecycle(c), "lifecycle_rollback": maintenance.roll_back(c),
        "exposure_aggregation": maintenance.audit_exposure(assigned, budgets), "projection_rebuild": maintenance.rebuild(c, "documents", lambda: shadow, "g2"), "compatibility_projection": maintenance.project_compatibility(c, edges),
    }
    assert set(handlers) == set(maintenance.KINDS)
    assert maintenance.run_once(q, handlers, "w", 1000) == {"completed": 8, "pending": 4}
    errors = {r.job_id: r.error for r in q.jobs().where("error IS NOT NULL").collect()}
    assert errors == {"exposure_aggregation-u": "exposure_mismatch:0", "projection_rebuild-u": "changed:a", "lifecycle_rollback-t": "nothing_to_roll_back", "lifecycle_rollback-u": "nothing_to_roll_back"}
    assert {r.run_id for r in runs.stored(c, "retrieval_runs").collect()} == {"r2", "r3"} and [r.run_id for r in runs.stored(c, "run_hits").collect()] == ["r2"]
    assert {(r.tenant_id, r.id, r.generation) for r in maintenance.active(c, "documents").collect()} == {("t", "a", "g2"), ("t", "b", "g2"), ("u", "a", "g1")}
    assert [r.next_state for r in c.read("decisions").collect()] == ["trial"] and maintenance.read_graphs(c)[0].count() == 2


def test_what_a_handler_raises_fails_its_batch_alone(spark, tmp_path):
    q = Queue(Catalog(spark, str(tmp_path)))
    q.add(spark.createDataFrame([("t", "a", "transient_expiry", 0, 0), ("t", "b", "projection_rebuild", 0, 0)], "tenant_id string, job_id string, kind string, available_at long, created_at long"))
    assert maintenance.run_once(q, {"transient_expiry": lambda jobs, now: 1 / 0, "projection_rebuild": lambda jobs, now: None}, "w", 10) == {"completed": 1, "pending": 1}
    assert [r.error for r in q.jobs().where("job_id = 'a'").collect()] == ["ZeroDivisionError: division by zero"]


def test_graphs_are_unique_and_checked_when_read(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    first = graph(spark, ("t", 1, "p", "q", "x", "y", "k"), ("t", 1, "p", "q", "y", "z", "k"), ("t", 2, "p", "q", "x", "y", "k"))
    say = lambda df: {r.epoch_no: r.outcome for r in maintenance.publish_graphs(c, df).collect()}
    assert say(first) == {1: "stored", 2: "stored"} and say(first.unionByName(first)) == {1: "known", 2: "known"}
    assert say(graph(spark, ("t", 1, "p", "q", "x", "y", "k"))) == {1: "conflict"}
    good, bad = maintenance.read_graphs(c)
    assert good.count() == 3 and bad.isEmpty()
    ids = {r.epoch_no: r.graph_id for r in c.read("graphs").collect()}
    c.append("graph_edges", spark.createDataFrame([("t", ids[2], "x", "forged", "k"), ("t", "graph_none", "a", "b", "k")], maintenance.GRAPHS["graph_edges"]))
    good, bad = maintenance.read_graphs(c)
    assert {r.graph_id: r.reason for r in bad.collect()} == {ids[2]: "edges_changed", "graph_none": "edges_without_graph"}
    assert {r.epoch_no for r in good.select(F.col("epoch_no")).collect()} == {1}
