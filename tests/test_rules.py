"""Rules of stored records: each breaks for its own fault alone; hashes and counts against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import records, rules


def broken(df, key, checks):
    return sorted((r[0], r[1]) for r in records.violations(df, key, checks).collect())


def test_decisions(spark):
    schema = "key int, version_id string, policy_id string, prior_state string, next_state string, reasons array<string>, wilson_ppm long, cutoff_at long, evaluated_at long"
    good = ["pv_1", "p1", "trial", "active", ["a", "b"], 900_000, 5, 5]

    def but(key, **changes):
        row = dict(zip(["version_id", "policy_id", "prior_state", "next_state", "reasons", "wilson_ppm", "cutoff_at", "evaluated_at"], good, strict=True)) | changes
        return (key, *row.values())

    rows = [but(0), but(1, version_id="bad id"), but(2, next_state="gone"), but(3, reasons=["b", "a"]), but(4, reasons=[]), but(5, reasons=["a", "a"]), but(6, wilson_ppm=1_000_001), but(7, cutoff_at=6), but(8), but(9, reasons=None)]
    d = spark.createDataFrame(rows, schema).withColumn("content_hash", F.sha2(rules.decision_content(), 256)).withColumn("id", F.concat(F.lit("lcd_"), "content_hash"))
    d = d.withColumn("wilson_ppm", F.when(F.col("key") == 8, 1).otherwise(F.col("wilson_ppm")))
    want = [(1, "names"), (2, "states"), (3, "reasons"), (4, "reasons"), (5, "reasons"), (6, "confidence"), (7, "cutoff_before_evaluation"), (8, "hash"), (9, "reasons")]
    assert broken(d, "key", rules.decision_rules()) == want
    assert broken(d.where("false"), "key", rules.decision_rules()) == []


def test_evidence(spark):
    rows = [(0, None, None, 5, ["a"]), (1, 6, None, 5, []), (2, 5, 6, 5, []), (3, 5, 5, 5, ["b", "a"]), (4, 5, 5, None, [])]
    e = spark.createDataFrame(rows, "key int, latest_causal_at long, trial_started_at long, cutoff_at long, triggers array<string>")
    assert broken(e, "key", rules.evidence_rules()) == [(1, "causal_before_cutoff"), (2, "trial_before_cutoff"), (3, "triggers"), (4, "causal_before_cutoff"), (4, "trial_before_cutoff")]


def test_edges(spark):
    rows = [(0, "t", 1, "t", 1, "a", "b", ["prov_1"], ["req_1"]), (1, "t", 1, "u", 1, "a", "b", ["prov_1"], ["req_1"]), (2, "t", 2, "t", 1, "a", "b", ["prov_1"], ["req_1"]), (3, "t", 1, "t", 1, "a", "a", ["prov_1"], ["req_1"]), (4, "t", 1, "t", 1, "a", "b", ["prov_*"], []), (5, "t", 1, "t", 1, "a", "b", ["req_1"], ["req_2", "req_1"])]
    e = spark.createDataFrame(rows, "key int, tenant_id string, epoch_no int, graph_tenant_id string, graph_epoch_no int, src string, dst string, provisions array<string>, requirements array<string>")
    assert broken(e, "key", rules.edge_rules()) == [(1, "tenant"), (2, "epoch"), (3, "ends"), (4, "provisions"), (4, "requirements"), (5, "provisions"), (5, "requirements")]


def test_selections(spark):
    own, other, short = ("p", "h", ["b", "a"]), ("p", "x", ["a", "b"]), ("p", "h", ["a"])
    rows = [
        (0, True, "exact", 0, 0, own, None, None), (1, True, "partial", 0, 0, own, "e", "x"), (2, True, "exact", 1, 0, own, None, None), (3, True, "bridged", 1, 0, None, None, None), (4, True, "exact", 0, 0, other, None, None),
        (5, True, "exact", 0, 0, short, None, None), (6, False, "partial", 1, 2, None, None, None), (7, False, "partial", 0, 0, own, "e", None),
    ]
    s = spark.createDataFrame(rows, "key int, complete boolean, novelty string, bridges int, gaps int, schedule struct<plan_id:string,plan_hash:string,steps:array<string>>, experiment_id string, assignment_id string")
    s = s.withColumns({"plan_id": F.lit("p"), "plan_hash": F.lit("h"), "steps": F.array(F.lit("a"), F.lit("b"))})
    assert broken(s, "key", rules.selection_rules()) == [(1, "novelty"), (2, "novelty"), (3, "schedule"), (4, "schedule_of_plan"), (5, "schedule_of_plan"), (7, "experiment"), (7, "gaps"), (7, "schedule")]


def test_planning_facts(spark):
    schema = "key int, version_id string, interface_hash string, lifecycle string, policy_id string, goals array<string>, reads array<string>, writes array<string>, exclusive array<string>, mutexes array<string>, evidence_strength int, tool_cost int"
    h = "0" * 64
    rows = [
        (0, " v1 ", h, "trial", "p", [" g2", "g1 "], ["res_b", "res_a"], [], [], ["m"], 0, 1), (1, "v1", h, "trial", "p ", ["g1", "g2"], ["res_a ", "res_b", "res_b"], [], [], ["m", "m"], 0, 1),
        (2, "v1", h, "trial", "p", ["g1", "g1 "], [], [], [], [], 0, 1), (3, "v1", h, "trial", "p", [], ["file_a"], [], [], [], 0, 1), (4, "v1", h, "trial", "p", [], [], [], [], [], 0, 0), (5, "v1", "xyz", "trial", "p", [], [], [], [], [], 0, 1),
        (6, "v1", h, "trial", "p", [f"g{i}" for i in range(1025)], [], [], [], [], 0, 1), (7, "v1", h, "trial", "p", [f"g{i}" for i in range(1024)], [], [], [], [], 0, 1), (8, None, h, "trial", "p", [], [], [], [], [], 0, 1),
        (9, "v1", h, "trial", "p", [], [], [], [], [f"m{i}" for i in range(16_385)], 0, 1),
    ]
    got = dict(rules.planning_facts(spark.createDataFrame(rows, schema)).select("key", "facts_hash").collect())
    body = {"evidence_strength": 0, "exclusive": [], "goals": ["g1", "g2"], "interface_hash": h, "lifecycle": "trial", "mutexes": ["m"], "policy_id": "p", "reads": ["res_a", "res_b"], "tool_cost": 1, "version_id": "v1", "writes": []}
    assert got[0] == got[1] == hashlib.sha256(json.dumps(body, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert [k for k in got if got[k] is None] == [2, 3, 4, 5, 6, 8, 9]


def test_counts_goals_and_generations(spark):
    docs = spark.createDataFrame([("a", 3), ("a", 1), ("b", None), ("c", 0)], "version_id string, unsafe int")
    seen = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "version_id string")
    assert sorted(map(tuple, rules.effective_unsafe(docs, seen).collect())) == [("a", 3), ("b", 2), ("c", 0)]
    support = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "version_id string, outcome_id int")
    assert [tuple(r) for r in rules.supporting_outcomes(support).collect()] == [("a", 2, 3)]
    facts = spark.createDataFrame([(1, "q", "satisfied", 1), (1, "p", "satisfied", 2), (1, "p", "satisfied", 1), (1, "r", "satisfied", 3), (2, "p", "failed", 1)], "outcome_id int, predicate string, verdict string, class_rank int")
    assert [tuple(r) for r in rules.goals(facts).collect()] == [(1, ["p", "q"])]
    done = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 9)], "scope string, batch int")
    before = spark.createDataFrame([("s", 4)], "scope string, generation long")
    assert sorted(map(tuple, rules.checkpoints(done, before).collect())) == [("s", 6, 2), ("t", 1, 9)]
    paths = spark.createDataFrame([("v", "neg_1"), ("v", "neg_1"), ("w", "neg_1")], "version_id string, path_id string")
    ids = {r.version_id: r.record_id for r in rules.negative_path_records(paths).collect()}
    assert ids["v"] == "negpv_" + hashlib.sha256(b'{"path_id":"neg_1","procedure_version_id":"v"}').hexdigest() and ids["w"] != ids["v"] and len(ids) == 2
    with pytest.raises(ValueError):
        rules.retained(done, "batch", 31 * 86_400)


def test_candidate_sets_hash_alike_in_any_order(spark):
    rows = [("t", "b", "2"), ("t", "a", "1"), ("u", "a", "1")]
    one = lambda r: {x.tenant: x.set_hash for x in rules.candidate_set_hash(spark.createDataFrame(r, "tenant string, version string, facts string"), ["tenant"], "version", F.concat_ws("=", "version", "facts")).collect()}
    assert one(rows) == one(rows[::-1] + rows[:1]) == {"t": hashlib.sha256(b"a=1;b=2").hexdigest(), "u": hashlib.sha256(b"a=1").hexdigest()}


def test_failed_branches(spark):
    nodes = spark.createDataFrame([(1, 0, False, False, "c", ["i"], ["r2", "r1"]), (1, 1, True, False, "c", [], []), (1, 2, False, True, None, [], []), (1, 3, False, False, "c", ["i"], ["r1", "r2"])], "trace_id int, position int, succeeded boolean, opaque boolean, contract string, inputs array<string>, resources array<string>")
    results = spark.createDataFrame([(1, 0, "failed", 2)], "trace_id int, position int, state string, exit_code int")
    got = {r.position: r for r in rules.failed_branches(nodes, results).collect()}
    assert sorted(got) == [0, 3] and got[3].unresolved and got[3].predicate is None
    assert got[0].predicate == "tool_failure:c:" + hashlib.sha256(b'{"exit_code":2,"state":"failed"}').hexdigest()
    assert got[0].tool_hash == got[3].tool_hash and got[0].resource_hash == got[3].resource_hash
    effects = spark.createDataFrame([(1, True, "write"), (2, True, "none"), (3, False, "external"), (4, True, "irreversible")], "position int, succeeded boolean, side_effect string")
    assert [r.position for r in rules.required_effects(effects).collect()] == [1, 4]
