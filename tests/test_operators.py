import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import causal, channels, compose, evidence, gates, ranking, tables

# --- ranking -----------------------------------------------------------------------------------------------------

RANKER = ranking.Ranker({"exact": 2_000_000, "lexical": 1_000_000}, features=(ranking.Feature("freshness", -10, 10, -10, 2), ranking.Feature("success", 0, 1000, 0, 3)))


def test_weights_and_terms(spark):
    hits = spark.createDataFrame([(1, "a", "exact", 1), (1, "a", "lexical", 2), (1, "b", "exact", 2)], "query_id long, version_id string, channel string, rank long")
    got = {r.version_id: r.rrf for r in ranking.rrf(hits, RANKER).collect()}
    assert got == {"a": 2_000_000 * 10**6 // 61 + 10**12 // 62, "b": 2 * 10**12 // 62}


def test_order_does_not_depend_on_input_order(spark):
    r = random.Random(3)
    rows = [(1, f"v{i:02}", 1000 * (i % 3), None if i % 4 == 0 else i % 10, i % 5, i % 2 == 0, i * 10) for i in range(40)]
    seen = set()
    for k in range(4):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "query_id long, version_id string, rrf long, freshness int, verification_strength int, observed boolean, success int").repartition(1 + k)
        seen.add(tuple(x.version_id for x in ranking.total_order(ranking.fuse(df, RANKER)).orderBy("rank").collect()))
    assert len(seen) == 1
    final = lambda x: x[2] + (-10 if x[3] is None else x[3]) * 2 + x[6] * 3
    assert list(seen.pop()) == [x[1] for x in sorted(rows, key=lambda x: (-final(x), -x[4], not x[5], x[1]))]


def test_out_of_range_feature_raises(spark):
    df = spark.createDataFrame([(1, "a", 1, 11, 0)], "query_id long, version_id string, rrf long, freshness int, success int")
    with pytest.raises(Exception, match="out of range"):
        ranking.fuse(df, RANKER).collect()
    with pytest.raises(ValueError):
        ranking.Ranker({"exact": 2**62})


def test_selection_and_disposition(spark):
    rows = [(1, "a", 50, 1, True), (1, "b", 40, 2, False), (1, "c", 30, 3, False), (2, "d", 5, 1, False)]
    df = spark.createDataFrame(rows, "query_id long, version_id string, final long, rank long, advisory boolean")
    assert [r.version_id for r in ranking.select_top(df, 35, 1).where("selected").collect()] == ["b"]
    queries = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    c = spark.createDataFrame([(1, True, False, 50), (2, True, False, 5), (3, False, False, 50), (4, True, True, 50)], "query_id long, eligible boolean, advisory boolean, final long")
    got = {r.query_id: (r.disposition, r.reason) for r in ranking.disposition(queries, c, 10).collect()}
    assert got == {1: ("selected", None), 2: ("abstained", "below_confidence_threshold"), 3: ("abstained", "no_eligible_candidates"), 4: ("abstained", "advisory_only"), 5: ("abstained", "no_candidates")}


# --- gates -------------------------------------------------------------------------------------------------------

GOOD = {
    "version_id": "v", "owner": "t", "tenant": "t", "shared_with": None, "lifecycle": "active", "superseded_by": None, "risk": 1, "maximum_risk": 2, "harness": "h", "harness_version": "1",
    "required_harness": "h", "required_harness_version": "", "validated_at": 1000, "as_of": 2000, "validation_policy": "default", "query_recall": True, "recall": True, "region": "eu", "query_regions": ["eu"],
    "tools": [("x", "1")], "required_tools": [("x", "1")], "resources": [("file", "n", "i", "s1")], "required_resources": [("file", "n", "i", "")], "effects": ["write"], "forbidden_effects": ["delete"],
    "environment": [("os", "linux")], "required_environment": [("os", "linux")],
}
PAIR = "array<struct<name:string,contract:string>>"
RES = "array<struct<type:string,namespace:string,identity:string,schema:string>>"
ENV = "array<struct<name:string,value:string>>"
KINDS = {
    "shared_with": "array<string>", "risk": "int", "maximum_risk": "int", "validated_at": "long", "as_of": "long", "query_recall": "boolean", "recall": "boolean", "query_regions": "array<string>",
    "tools": PAIR, "required_tools": PAIR, "resources": RES, "required_resources": RES, "effects": "array<string>", "forbidden_effects": "array<string>", "environment": ENV, "required_environment": ENV,
}
CHANGES = {
    "": ({}, []),
    "owner": ({"owner": "u"}, ["tenant_scope_denied"]),
    "shared": ({"owner": "u", "shared_with": ["t"]}, []),
    "share": ({"owner": "u", "shared_with": ["w"]}, ["sharing_scope_denied"]),
    "unknown owner": ({"owner": None}, ["candidate_invalid", "tenant_scope_denied"]),
    "lifecycle": ({"lifecycle": "retired"}, ["lifecycle_ineligible"]),
    "unknown lifecycle": ({"lifecycle": None}, ["candidate_invalid", "lifecycle_ineligible"]),
    "superseded": ({"superseded_by": "w"}, ["superseded"]),
    "risk": ({"risk": 3}, ["risk_budget_exceeded"]),
    "request risk": ({"maximum_risk": 1, "risk": 2}, ["risk_budget_exceeded"]),
    "no risk": ({"risk": None}, ["candidate_invalid", "risk_budget_exceeded"]),
    "harness": ({"harness": "g"}, ["harness_incompatible"]),
    "harness version": ({"required_harness_version": "2"}, ["harness_incompatible"]),
    "never validated": ({"validated_at": None}, ["validation_missing"]),
    "future": ({"validated_at": 3000}, ["validation_stale"]),
    "old": ({"as_of": 1000 + 91 * 86400}, ["validation_stale"]),
    "policy": ({"validation_policy": None}, ["policy_incompatible"]),
    "consent": ({"recall": None}, ["consent_denied"]),
    "region": ({"query_regions": ["us"]}, ["residency_denied"]),
    "tool": ({"tools": []}, ["tool_unavailable"]),
    "contract": ({"tools": [("x", "2")]}, ["tool_contract_incompatible"]),
    "two contracts": ({"tools": [("x", "1"), ("x", "2")]}, ["tool_contract_incompatible"]),
    "resource": ({"resources": []}, ["resource_precondition_missing"]),
    "schema": ({"required_resources": [("file", "n", "i", "s2")]}, ["resource_schema_incompatible"]),
    "effect": ({"effects": ["write", "delete"]}, ["forbidden_effect"]),
    "environment": ({"environment": [("os", "mac")]}, ["environment_incompatible"]),
    "two values": ({"environment": [("os", "mac"), ("os", "linux")]}, ["environment_incompatible"]),
    "many": ({"risk": 4, "harness": "g", "recall": False}, ["consent_denied", "harness_incompatible", "risk_budget_exceeded"]),
}


def test_every_gate_fails_closed(spark):
    schema = "case string, " + ", ".join(f"{k} {KINDS.get(k, 'string')}" for k in GOOD)
    rows = [(name, *(GOOD | change).values()) for name, (change, _) in CHANGES.items()]
    out = gates.evaluate(spark.createDataFrame(rows, schema), gates.Policy())
    got = {r["case"]: r for r in out.withColumn("codes", gates.codes(F.col("rejections"))).collect()}
    for name, (_, want) in CHANGES.items():
        assert got[name].codes == want, name
        assert got[name].eligible == (not want)
    assert got["resource"].rejections[0].subject == "file:n"


def test_candidates_are_advice_only(spark):
    schema = ", ".join(f"{k} {KINDS.get(k, 'string')}" for k in GOOD)
    df = spark.createDataFrame([tuple((GOOD | {"lifecycle": "candidate"}).values())], schema)
    assert gates.evaluate(df, gates.Policy()).select("eligible", "advisory").first()[:] == (True, True)
    assert gates.evaluate(df, gates.Policy(advisory_candidates=False)).select("eligible", "advisory").first()[:] == (False, False)
    with pytest.raises(ValueError):
        gates.Policy(lifecycles=("retired",))


def test_safe_without_promotion(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", 2)], "version_id string, risk int")
    steps = spark.createDataFrame([("a", "read", "low"), ("b", "read", "low"), ("b", None, None), ("c", "read", "low")], "version_id string, side_effect string, risk string")
    assert [r.version_id for r in gates.safe_without_promotion(docs, steps).collect()] == ["a"]


# --- evidence, credit, lifecycle ---------------------------------------------------------------------------------


def test_outcome_states(spark):
    c = evidence.CLASSES
    rows = [
        ("success", "p", c[1], "satisfied"), ("failure", "p", c[1], "failed"), ("conflict", "p", c[2], "satisfied"), ("conflict", "p", c[2], "failed"), ("weak", "p", c[3], "satisfied"),
        ("weak conflict", "p", c[3], "satisfied"), ("weak conflict", "p", c[3], "failed"), ("stronger", "p", c[0], "satisfied"), ("stronger", "p", c[1], "failed"), ("nothing", "p", c[0], "unknown"),
        ("partly", "p", c[0], "satisfied"), ("partly", "q", c[4], "satisfied"), ("weak failure", "p", c[3], "failed"),
    ]
    facts = spark.createDataFrame(rows, "outcome_id string, predicate string, class string, verdict string")
    got = {r.outcome_id: r.state for r in evidence.outcome_state(evidence.by_predicate(facts)).collect()}
    assert got == {
        "success": "verified_success", "failure": "verified_failure", "conflict": "inconclusive", "weak": "provisional_success", "weak conflict": "provisional_success", "stronger": "verified_success",
        "nothing": "inconclusive", "partly": "provisional_success", "weak failure": "inconclusive",
    }
    required = spark.createDataFrame([("success", "p"), ("success", "absent"), ("failure", "other")], "outcome_id string, predicate string")
    got = {r.outcome_id: r.state for r in evidence.outcome_state(evidence.by_predicate(facts.where("outcome_id IN ('success', 'failure')")), required).collect()}
    assert got == {"success": "provisional_success", "failure": "inconclusive"}


def test_credit(spark):
    rows = [("verified_success", True, True, True, False), ("verified_success", False, True, True, False), ("verified_success", True, True, False, False), ("verified_failure", True, True, False, True), ("provisional_success", True, False, True, False), ("inconclusive", True, True, False, False)]
    df = spark.createDataFrame(rows, "state string, temporal boolean, complete boolean, goals_satisfied boolean, goals_failed boolean")
    got = [(r.credit_class, r.reasons) for r in evidence.credit(df).collect()]
    assert got == [
        ("causal_success", []), ("associated_success", ["outside_attribution_window"]), ("associated_success", ["goal_evidence_missing"]), ("causal_failure", []),
        ("associated_success", ["partial_plan", "provisional_evidence"]), ("unattributable", ["inconclusive_outcome"]),
    ]


def test_lifecycle(spark):
    now, fresh, old = 10**9, 10**9 - 100, 10**9 - 100 * 86400
    cases = [
        (("retired", 9, 0, 0, fresh, None), "retired", ["terminal_state_unchanged"]),
        (("active", 50, 0, 1, fresh, None), "quarantined", ["immediate_quarantine_triggered"]),
        (("active", 50, 0, 0, fresh, None), "active", ["state_maintained"]),
        (("active", 50, 0, 0, old, None), "retired", ["active_version_rolled_back", "causal_evidence_stale"]),
        (("active", 3, 3, 0, fresh, None), "retired", ["active_version_rolled_back", "insufficient_causal_samples", "wilson_lower_bound_below_threshold"]),
        (("candidate", 3, 0, 0, fresh, None), "trial", ["candidate_promoted_to_trial"]),
        (("candidate", 2, 0, 0, fresh, None), "candidate", ["insufficient_causal_samples", "wilson_lower_bound_below_threshold"]),
        (("candidate", 3, 0, 0, None, None), "candidate", ["causal_evidence_stale"]),
        (("trial", 10, 0, 0, fresh, now - 7200), "active", ["trial_promoted_to_active"]),
        (("trial", 10, 0, 0, fresh, now - 60), "trial", ["minimum_trial_duration_incomplete"]),
        (("trial", 4, 0, 0, fresh, now - 7200), "trial", ["insufficient_causal_samples", "wilson_lower_bound_below_threshold"]),
        (("trial", 1, 5, 0, fresh, now - 7200), "candidate", ["trial_version_demoted", "wilson_lower_bound_below_threshold"]),
    ]
    df = spark.createDataFrame([(i, *c[0], now) for i, c in enumerate(cases)], "i int, prior_state string, successes long, failures long, unsafe long, latest_causal_at long, trial_started_at long, cutoff_at long")
    got = [(r.next_state, r.reasons) for r in evidence.transition(df).orderBy("i").collect()]
    assert got == [(c[1], c[2]) for c in cases]


def test_challenger_share(spark):
    e = evidence.Experiment("tenant_a", "proc_a", 1, "champion", ("challenger",), 100_000)
    rows = spark.range(10_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("low").alias("risk"), F.lit(0).alias("concurrent"), *[F.lit(0).alias(c) for c in ("tenant_exposure", "global_exposure", "tenant_unsafe", "global_unsafe")], F.lit(1_700_000_000).alias("assigned_at")
    )
    out = evidence.assign(rows, e)
    n = out.where("challenger").count()
    assert 900 < n < 1100 and out.where("challenger AND bucket >= 100000").count() == 0
    assert evidence.assign(rows.withColumn("risk", F.lit("critical")), e).where("challenger").count() == 0


# --- causal graphs -----------------------------------------------------------------------------------------------


def slow_closure(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        t, n = todo.pop()
        for a, b, c in edges:
            if a == t and c == n and (t, b) not in seen:
                seen.add((t, b))
                todo.append((t, b))
    return seen


def test_flow_and_closure(spark):
    r = random.Random(4)
    rows = [(t, f"r{r.randrange(3)}", p, r.random() < 0.7, r.random() < 0.5) for t in range(3) for p in range(12)]
    df = spark.createDataFrame(rows, "trace_id int, resource string, position int, reads boolean, writes boolean")
    want = set()
    for t, res, p, reads, _ in rows:
        before = [q for tt, rr, q, _, w in rows if tt == t and rr == res and w and q < p]
        if reads and before:
            want.add((t, max(before), p))
    edges = causal.flow_edges(df)
    assert {(e.trace_id, e.src, e.dst) for e in edges.collect()} == want
    roots = spark.createDataFrame([(0, 11), (1, 10)], "trace_id int, position int")
    assert {(x.trace_id, x.position) for x in causal.ancestors(edges, roots).collect()} == slow_closure(want, [(0, 11), (1, 10)])


def test_cycles(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 2), (2, 2, 3), (2, 3, 2)], "trace_id int, src int, dst int")
    assert {(r.trace_id, r.position) for r in causal.on_cycles(e).collect()} == {(2, 2), (2, 3)}
    n = spark.createDataFrame([(1, 1), (1, 2)], "trace_id int, position int")
    assert {(r.trace_id, r.src, r.dst) for r in causal.broken_edges(e.where("trace_id = 1"), n).collect()} == {(1, 2, 3)}


@pytest.mark.parametrize("rounds", [2, 16])
def test_chains_deeper_than_the_rounds(spark, rounds):
    chain = [(1, i, i + 1) for i in range(300)] + [(1, 0, 300), (2, 1, 2), (2, 2, 3), (2, 3, 2), (2, 3, 4)]
    e = spark.createDataFrame(chain, "trace_id long, src long, dst long")
    roots = spark.createDataFrame([(1, 299), (2, 3)], "trace_id long, position long")
    found = causal.ancestors(e, roots, rounds)
    assert sorted((r.trace_id, r.position) for r in found.collect()) == [(1, i) for i in range(300)] + [(2, 1), (2, 2), (2, 3)]
    left = causal.on_cycles(e, rounds)
    assert sorted((r.trace_id, r.position) for r in left.collect()) == [(2, 2), (2, 3), (2, 4)]


def test_deep_traces_take_rounds_by_their_logarithm(spark, monkeypatch):
    """A chain of 5,000 steps and a cycle of 3,000: no walk in one task, and few rounds."""
    from tracewright.sources import tables

    calls, real = [], tables.checkpoint
    monkeypatch.setattr(tables, "checkpoint", lambda df: calls.append(1) or real(df))
    e = spark.range(5000).selectExpr("1 AS trace_id", "id AS src", "id + 1 AS dst")
    roots = spark.createDataFrame([(1, 5000)], "trace_id int, position long")
    assert causal.ancestors(e, roots).agg({"position": "count"}).first()[0] == 5001
    assert len(calls) < 100
    del calls[:]
    ring = spark.range(3000).selectExpr("2 AS trace_id", "id AS src", "(id + 1) % 3000 AS dst")
    tail = spark.range(40).selectExpr("2 AS trace_id", "2999 + id + IF(id > 0, 1000, 0) AS src", "4000 + id AS dst")
    nodes = causal.cyclic(ring.unionByName(tail)).collect()
    assert sorted(n.position for n in nodes) == list(range(3000))
    assert len(calls) < 200


def slow_cyclic(edges):
    reach = {(t, a): set() for t, a, _ in edges}
    for t, a, b in edges:
        reach[t, a].add(b)
    on = set()
    for t, a in reach:
        seen, todo = set(), [a]
        while todo:
            for b in reach.get((t, todo.pop()), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if a in seen:
            on.add((t, a))
    return on


@pytest.mark.parametrize("seed,rounds", [(1, 1), (2, 4)])
def test_cyclic_nodes_against_brute_force(spark, seed, rounds):
    r = random.Random(seed)
    rows = sorted({(t, r.randrange(30), r.randrange(30)) for t in range(6) for _ in range(12 + 6 * t)})
    e = spark.createDataFrame(rows, "trace_id int, src int, dst int")
    assert {(x.trace_id, x.position) for x in causal.cyclic(e, rounds).collect()} == slow_cyclic(rows)
    behind, todo = set(slow_cyclic(rows)), list(slow_cyclic(rows))
    while todo:
        t, a = todo.pop()
        for t2, x, y in rows:
            if (t2, x) == (t, a) and (t, y) not in behind:
                behind.add((t, y))
                todo.append((t, y))
    assert {(x.trace_id, x.position) for x in causal.on_cycles(e, rounds).collect()} == behind
    assert causal.cyclic(e.where("false")).count() == 0


def test_slicing(spark):
    nodes = spark.createDataFrame([(1, 0, True, False, False), (1, 1, True, True, False), (1, 2, False, False, False), (1, 3, True, True, False), (1, 4, True, False, True)], "trace_id int, position int, succeeded boolean, irrelevant boolean, failed_branch boolean")
    kept = spark.createDataFrame([(1, 3)], "trace_id int, position int")
    assert [(r.position, r.ordinal, r.uncertain_necessity) for r in causal.slice_steps(nodes, kept).orderBy("position").collect()] == [(0, 0, True), (3, 1, False)]


def test_contract_resolution(spark):
    contracts = spark.createDataFrame([("a1", "t", 10, 5, 15), ("a2", "t", 12, 8, 20), ("b", "u", 3, 3, 4)], "contract_id string, name string, version int, minimum int, maximum int")
    calls = spark.createDataFrame([(1, "t", 10), (2, "t", 9), (3, "t", 18), (4, "t", 30), (5, "w", 1)], "call_id int, name string, version int")
    assert {r.call_id: (r.contract_id, r.opaque) for r in causal.resolve_contracts(calls, contracts).collect()} == {1: ("a1", False), 2: ("a2", False), 3: ("a2", False), 4: (None, True), 5: (None, True)}


def test_ordered_containment(spark):
    rows = [(["a", "b"], [("a", False), ("x", True), ("b", False)], True), (["a", "b"], [("a", False), ("x", False), ("b", False)], False), (["a", "b"], [("b", False), ("a", False)], False), ([], [("x", True)], True)]
    df = spark.createDataFrame(rows, "planned array<string>, executed array<struct<contract:string,read_only:boolean>>, want boolean")
    assert all(r.want == r.folds for r in causal.contained_in_order(df).collect())


# --- composition -------------------------------------------------------------------------------------------------


def test_compatibility(spark):
    p = spark.createDataFrame([("A", "p1", "r", "s1", ["x", "y"]), ("B", "p2", "r", "", ["x"]), ("C", "p3", "r", "s2", ["x"])], "version_id string, provision_id string, resource string, schema string, predicates array<string>")
    r = spark.createDataFrame([("D", "q1", "r", "s1", ["x"]), ("A", "q2", "r", "s1", []), ("E", "q3", "r", "s1", ["z"])], "version_id string, requirement_id string, resource string, schema string, predicates array<string>")
    assert [(x.source, x.target) for x in compose.compatibility(p, r).collect()] == [("A", "D")]
    rules = spark.createDataFrame([("s2", "s1")], "provided string, required string")
    assert {(x.source, x.target) for x in compose.compatibility(p, r, rules).collect()} == {("A", "D"), ("C", "D"), ("C", "A")}


def candidate(i, seed=False, goals=(), requirements=(), strength=1000, observed=True):
    return {"version_id": i, "seed": seed, "goals": list(goals), "requirements": list(requirements), "evidence_strength": strength, "observed": observed, "risk_cost": 1, "tool_cost": 1}


def test_beam_search_bridges_a_gap():
    c = [candidate("a", True, ["g1"], ["need"]), candidate("b", False, ["g2"]), candidate("c", False)]
    edges = [{"source": "b", "target": "a", "requirement_ids": {"need"}}, {"source": "c", "target": "b", "requirement_ids": set()}]
    best, limits = compose.beam_search(compose.Planner(), c, edges, {"g1", "g2"}, set())
    assert best["complete"] and best["nodes"] == ["b", "a"] and best["strength"] == 900 and limits == []
    best, limits = compose.beam_search(compose.Planner(depth=1), c, edges, {"g1", "g2"}, set())
    assert best["gaps"] == ["uncovered_goal|||g2", "unsatisfied_requirement|a|need|"] and limits == ["depth_exhausted"]
    assert compose.beam_search(compose.Planner(), [candidate("z")], [], set(), set())[0] is None


def test_beam_search_ignores_input_order():
    r = random.Random(1)
    c = [candidate(f"v{i}", i < 3, [f"g{i % 4}"], [f"n{i}"] if i % 2 else [], 1000 + i) for i in range(8)]
    edges = [{"source": f"v{a}", "target": f"v{b}", "requirement_ids": {f"n{b}"}} for a in range(8) for b in range(a + 1, 8) if (a + b) % 3]
    hashes = set()
    for _ in range(10):
        r.shuffle(c)
        r.shuffle(edges)
        hashes.add(compose.beam_search(compose.Planner(), list(c), list(edges), {"g0", "g1", "g2"}, set())[0]["hash"])
    assert len(hashes) == 1


def test_schedule_groups():
    assert compose.schedule_groups(["a", "b", "c", "d"], {"c": ["a"]}, {("a", "b")}) == [["a", "d"], ["b", "c"]]


def test_conflicts(spark):
    rows = [(1, "a", ["r"], ["w"], [], [], False), (1, "b", ["w"], [], [], [], False), (1, "c", ["r"], [], [], ["m"], False), (1, "d", [], [], [], ["m"], False), (1, "e", [], [], ["r"], [], False), (2, "s", [], [], [], [], True), (2, "t", [], [], [], [], False)]
    df = spark.createDataFrame(rows, "plan_id int, version_id string, reads array<string>, writes array<string>, exclusive array<string>, mutexes array<string>, serial boolean")
    assert {(r.left, r.right) for r in compose.conflicts(df).collect()} == {("a", "b"), ("c", "d"), ("a", "e"), ("c", "e"), ("s", "t")}


# --- tables and channels -----------------------------------------------------------------------------------------


def test_queue_settles_only_for_the_owner(spark):
    q = spark.createDataFrame([(1, "leased", 0, "me", 1, 1), (2, "leased", 0, "me", 1, 5), (3, "leased", 0, "other", 1, 1), (4, "leased", 0, "me", 2, 1), (5, "leased", 0, "me", 1, 2)], "job_id int, state string, available_at long, owner string, generation int, attempts int")
    results = spark.createDataFrame([(1, "me", 1, True), (2, "me", 1, False), (3, "me", 1, True), (4, "me", 1, True), (5, "me", 1, False)], "job_id int, owner string, generation int, ok boolean")
    got = {r.job_id: (r.state, r.available_at) for r in tables.settle(q, results, F.lit(100).cast("long"), 5, 60).collect()}
    assert got == {1: ("completed", 0), 2: ("dead_letter", 116), 3: ("leased", 0), 4: ("leased", 0), 5: ("pending", 102)}


def test_idempotency_and_digests(spark):
    rows = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "l", "b")], "n int, key string, hash string")
    assert [r.status for r in tables.idempotent(rows, ["key"], "hash", ["n"]).orderBy("n").collect()] == ["accepted", "duplicate", "conflict", "accepted"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, digest string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, digest string")
    assert {(r.id, r.reason) for r in tables.digest_difference(a, b).collect()} == {(1, "missing"), (2, "changed"), (3, "unexpected")}
    assert tables.digest_difference(a, a).isEmpty()


def test_similarity_of_the_best_is_that_of_all_pairs(spark):
    from tracewright.functions import scalars as S

    r = random.Random(3)
    text = lambda n: " ".join(f"w{min(int(r.expovariate(0.05)), 90)}" for _ in range(n))
    docs, queries = [(i, text(r.choice([3, 8, 20, 60, 300]))) for i in range(150)] + [(200, ""), (201, None)], [(i, text(r.randint(2, 40))) for i in range(12)] + [(50, ""), (51, "nowhere")]
    d, q = spark.createDataFrame(docs, "version_id int, task string"), spark.createDataFrame(queries, "query_id int, task string")
    want = []
    for i, a in queries:
        a, found = set(a.split()), []
        for v, b in docs:
            b = set((b or "").split())
            if a & b:
                found.append((-(len(a & b) * 1000000 // len(a | b)), v))
        want += [(i, v, -x, n + 1) for n, (x, v) in enumerate(sorted(found)[:5])]
    got = [(x.query_id, x.version_id, x.score, x.rank) for x in channels.lexical(d, q, 5).collect()]
    assert sorted(got) == sorted(want)
    assert channels.set_similarity(d, q, S.words, "task", "task").where("score > 0").count() >= len(want)


def test_percentiles_against_sorted_values(spark):
    r = random.Random(4)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), (None, 500), ("c", 301)) for v in [r.choice([0.5, 1.25, -3.0, r.uniform(-9, 9)]) for _ in range(n)]]
    got = {x.k: (x.p0, x.p50, x.p95, x.p100) for x in tables.percentile_at_floor(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for k in {k for k, _ in rows}:
        v = sorted(x for y, x in rows if y == k)
        assert got[k] == tuple(v[int((len(v) - 1) * p)] for p in (0.0, 0.5, 0.95, 1.0))


def test_null_text_is_embedded_as_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    from tracewright.operators import records

    cache = spark.createDataFrame([], "input_hash string, vector array<double>")
    assert {x.id for x in records.embed_missing(df, cache, records.hashed_embedding(4)).collect()} == {1, 2}
