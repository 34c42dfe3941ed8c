import hashlib
import json

import pytest

from tracewright.operators import records
from tracewright.operators.evidence import CLASSES
from tracewright.plans import ingest, learning
from tracewright.sources.tables import Catalog

REQUEST = "tenant_id string, idempotency_key string, trace_key string, task string, consent string, harness string, environment string"
EVENT = "tenant_id string, trace_key string, position int, tool_name string, succeeded boolean, value string, tool_version string, state string, exit_code int, accesses array<struct<resource:string,schema:string,reads:boolean,writes:boolean>>"
CONTRACT = "tenant_id string, contract_id string, name string, version string, minimum string, maximum string, side_effect string, risk string, effects array<string>, predicates array<string>, methods array<string>"
R, W, RW = (True, False), (False, True), (True, True)


def event(tool, *accesses, ok=True, version="1", state="done", value="v"):
    return (tool, ok, value, version, state, 0 if ok else 1, [(r[0], r[2] if len(r) > 2 else "s1", *r[1]) for r in accesses])


#: trace -> its events; goals proven by `check` (predicate tested) or by the verifier `ci`.
TRACES = {
    "good": [event("fetch", ("in", R), ("a", W)), event("look", ("b", R)), event("fetch", ("x", R), ok=False, state="failed"), event("build", ("a", R), ("out", W)), event("check", ("out", R))],
    "again": [event("fetch", ("in", R), ("a", W), ), event("look", ("b", R), value="other"), event("fetch", ("x", R), ok=False, state="failed"), event("build", ("a", R), ("out", W)), event("check", ("out", R))],
    "alone": [event("fetch", ("in", R))],
    "unverified": [event("check", ("in", R), value="u")],
    "opaque": [event("check", ("in", R)), event("other", ("in", R))],
    "version": [event("check", ("in", R), version="9")],
    "uncovered": [event("fetch", ("in", R), ("a", W), value="z")],
    "prerequisite": [event("fetch", ("a", W), ok=False, state="failed"), event("check", ("a", R))],
    "silent": [event("fetch", ("a", R), ok=False, state=None), event("check", ("a", R))],
    "clash": [event("fetch", ("a", R, "s1")), event("check", ("a", R, "s2"))],
    "ambiguous": [event("fetch", ("a", W)), event("build", ("a", W)), event("check", ("in", R))],
    "verifier": [event("build", ("in", R), ("out", W)), event("watch", ("out", R))],
    "fold": [event("fetch", ("in", R), ("a", W)), event("look", ("b", R)), event("check", ("a", R))],
    "more": [event("fetch", ("in", R), ("a", W)), event("build", ("b", W)), event("check", ("a", R))],
}
WANT = {
    "good": ("published", None), "again": ("published", None), "alone": ("waiting", "awaiting_outcome"), "unverified": ("abstained", "outcome_not_verified"), "opaque": ("abstained", "opaque_tool"),
    "version": ("abstained", "opaque_tool"), "uncovered": ("abstained", "uncovered_goal"), "prerequisite": ("abstained", "failed_prerequisite"), "silent": ("rejected", "failed_step_without_result"),
    "clash": ("rejected", "conflicting_resource"), "ambiguous": ("rejected", "ambiguous_provision"), "verifier": ("published", None), "fold": ("folded", "folded_into_recalled_procedure"), "more": ("published", None),
}


@pytest.fixture(scope="module")
def contracts(spark):
    one = lambda name, effect, *rest: ("t", f"c_{name}", name, "1", "1", "2", effect, "medium" if effect == "write" else "low", *rest)
    rows = [one("fetch", "none", [], [], []), one("look", "read", [], [], []), one("build", "write", ["built"], [], []), one("check", "none", [], ["tested"], []), one("watch", "read", [], [], ["ci"])]
    return spark.createDataFrame([*rows, ("u", "c_other", "other", "1", "1", "2", "none", "low", [], [], [])], CONTRACT)


@pytest.fixture
def filled(spark, tmp_path):
    """A catalog with all traces, and an outcome for each but `alone`; answers name -> (trace_id, outcome_id)."""
    c = Catalog(spark, str(tmp_path / "tables"))
    requests = spark.createDataFrame([("t", k, k, "do it" if k != "more" else " ", ingest.CONSENT, "h", "env") for k in TRACES], REQUEST)
    events = spark.createDataFrame([("t", k, i, *e) for k, rows in TRACES.items() for i, e in enumerate(rows)], EVENT)
    got = {r.idempotency_key: r.trace_id for r in ingest.ingest(c, str(tmp_path / "archive"), requests, events).where("status = 'accepted'").collect()}
    assert set(got) == set(TRACES)
    outcomes = spark.createDataFrame([("t", k, f"o_{k}", got[k], {"fold": "i1", "more": "i2"}.get(k), None) for k in TRACES if k != "alone"], "tenant_id string, idempotency_key string, outcome_id string, trace_id string, injection_id string, supersedes_id string")
    told = {"unverified": ("tested", "failed", None), "verifier": ("watched", "satisfied", "ci")}
    facts = [(f"o_{k}", p, CLASSES[0], v, 1000, by) for k in TRACES if k != "alone" for p, v, by in [told.get(k, ("tested", "satisfied", None))]]
    facts = spark.createDataFrame(facts, "outcome_id string, predicate string, class string, verdict string, observed_at long, verifier string")
    selections = spark.createDataFrame([("i1", "v1", 900, 2000, True), ("i2", "v1", 900, 2000, True)], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    status = {r.status for r in ingest.commit_outcomes(c, outcomes, facts, selections, 1000).collect()}
    assert status == {"accepted"}
    return c, {k: (got[k], f"o_{k}" if k != "alone" else None) for k in TRACES}


def test_from_stored_traces_to_procedures(spark, filled, contracts, monkeypatch):
    c, ids = filled
    recalled = spark.createDataFrame([("t", "i1", "v1", ["c_fetch", "c_check"]), ("t", "i2", "v1", ["c_fetch", "c_check"])], "tenant_id string, injection_id string, version_id string, planned array<string>")
    jobs = learning.pending(c)
    of_outcomes = jobs.where("outcome_id IS NOT NULL OR trace_id = '%s'" % ids["alone"][0])
    assert jobs.count() == 2 * len(TRACES) - 1
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            learning.run(c, of_outcomes, contracts, 2000, recalled=recalled)
    assert c.heads(*learning.TABLES) == dict.fromkeys(learning.TABLES, -1)
    names = {v: k for k, v in ids.items()}
    got = {names[r.trace_id, r.outcome_id]: r for r in learning.run(c, of_outcomes, contracts, 2000, recalled=recalled).collect()}
    assert {k: (r.disposition, r.code) for k, r in got.items()} == WANT
    assert got["good"].version_id == got["again"].version_id and got["fold"].version_id == "v1" and got["more"].version_id not in (None, got["good"].version_id)
    assert {k for k, r in got.items() if r.version_id} == {"good", "again", "verifier", "fold", "more"}

    read = lambda t: learning.stored(c, t).collect()
    good = got["good"].version_id
    assert len(read("procedures")) == 3 and len(read("procedure_documents")) == 3
    steps = sorted((r.ordinal, r.tool_name, r.uncertain_necessity, r.side_effect) for r in read("procedure_steps") if r.version_id == good)
    assert steps == [(0, "fetch", False, "none"), (1, "look", True, "read"), (2, "build", False, "write"), (3, "check", False, "none")]
    assert sorted((r.src, r.dst, r.resource) for r in read("procedure_edges") if r.version_id == good) == [(0, 2, "a"), (2, 3, "out")]
    assert sorted((r.kind, r.resource, r.schema) for r in read("procedure_interfaces") if r.version_id == good) == [("requirement", "b", "s1"), ("requirement", "in", "s1")]
    assert len([r for r in read("negative_paths") if r.version_id == good]) == 1
    doc = next(r for r in read("procedure_documents") if r.version_id == good)
    assert (doc.task, doc.contracts, doc.effects, doc.resources, doc.verification_strength, doc.lifecycle) == ("do it", ["c_fetch", "c_look", "c_build", "c_check"], ["built", "side_effect:read"], ["a", "b", "in", "out"], 5, "candidate")
    assert next(r for r in read("procedure_documents") if r.version_id == got["more"].version_id).task == "tools fetch then build then check goals tested"
    manifests = read("synthesis_manifests")
    assert {(r.outcome_id, r.status) for r in manifests} == {(f"o_{k}", "synthesized" if d == "published" else "abstained") for k, (d, _) in WANT.items() if d in ("published", "abstained")}

    stages = learning.stored(c, "stage_artifacts")
    assert records.broken_chains(stages).isEmpty()
    last = {}
    for r in stages.collect():
        last.setdefault(r.workflow_id, []).append((records.STAGES.index(r.stage), r.code))
    ends = {k: max(last[r.workflow_id]) for k, r in got.items()}
    assert ends == {k: ({"awaiting_outcome": 1, "ambiguous_provision": 3, "failed_step_without_result": 2, "conflicting_resource": 2}.get(code, 4), code) for k, (_, code) in WANT.items()}

    sizes = {t: len(read(t)) for t in learning.TABLES}
    again = {names[r.trace_id, r.outcome_id]: r for r in learning.run(c, of_outcomes, contracts, 3000, recalled=recalled).collect()}
    assert {k: r.disposition for k, r in again.items()} == {k: "duplicate" if d in ("published", "abstained") else d for k, (d, _) in WANT.items()}
    assert {k: r.version_id for k, r in again.items()} == {k: r.version_id for k, r in got.items()} and {t: len(read(t)) for t in learning.TABLES} == sizes
    left = {(r.trace_id, r.outcome_id) for r in learning.pending(c).collect()}
    assert left == {(t, None) for k, (t, _) in ids.items() if k != "alone"}
    assert learning.tampered(c).isEmpty()
    c.append("procedure_steps", learning.stored(c, "procedure_steps").where(f"version_id = '{good}' AND ordinal = 3").withColumn("ordinal", learning.F.lit(9).cast("long")))
    assert {(r.version_id, r.reason) for r in learning.tampered(c).collect()} == {(good, "step_hash_mismatch"), (good, "ordinals_not_gapless")}


def test_calls_meet_contracts_once_and_a_trace_has_two_outcomes(spark, filled, contracts, monkeypatch):
    c, ids = filled
    seen = {}
    resolve = learning.causal.resolve_contracts

    def resolved(calls, known):
        seen["calls"] = calls.count()
        return resolve(calls, known)

    monkeypatch.setattr(learning.causal, "resolve_contracts", resolved)
    monkeypatch.setattr(learning, "MOST_KINDS", 0, raising=False)  # more kinds than go to the tasks: joined
    more = spark.createDataFrame([("t", "second", "o_second", ids["good"][0], None, None)], "tenant_id string, idempotency_key string, outcome_id string, trace_id string, injection_id string, supersedes_id string")
    facts = spark.createDataFrame([("o_second", "tested", CLASSES[0], "satisfied", 1000)], "outcome_id string, predicate string, class string, verdict string, observed_at long")
    none = spark.createDataFrame([], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    ingest.commit_outcomes(c, more, facts, none, 1000)
    got = {r.outcome_id: r for r in learning.run(c, learning.pending(c).where("outcome_id IS NOT NULL"), contracts, 2000).collect()}
    want = {f"o_{k}": WANT[k] for k in TRACES if k not in ("alone", "fold")} | {"o_fold": ("published", None), "o_second": ("published", None)}
    assert {k: (r.disposition, r.code) for k, r in got.items()} == want
    assert got["o_second"].version_id == got["o_good"].version_id  # one trace, two outcomes
    assert len(learning.stored(c, "procedure_steps").where(f"version_id = '{got['o_good'].version_id}'").collect()) == 4
    assert seen["calls"] == len({(tool, version) for rows in TRACES.values() for tool, _, _, version, *_ in rows})


def test_jobs_that_do_not_fit_and_ids_from_contents(spark, filled, contracts):
    c, ids = filled
    held = {r.outcome_id: r.content_hash for r in ingest.stored(c, "outcomes").collect()}
    trace, outcome = ids["good"]
    jobs = [("t", "tr_x", None, "h"), ("t", trace, "o_x", "h"), ("t", ids["more"][0], outcome, held[outcome]), ("t", trace, outcome, "h"), ("t", trace, None, "h"), ("u", trace, outcome, held[outcome])]
    jobs = spark.createDataFrame(jobs, "tenant_id string, trace_id string, outcome_id string, content_hash string")
    codes = sorted((r.tenant_id, r.code) for r in learning.run(c, jobs, contracts, 2000).collect())
    assert codes == sorted([("t", "trace_not_found"), ("t", "outcome_not_found"), ("t", "trace_mismatch"), ("t", "content_mismatch"), ("t", "content_mismatch"), ("u", "trace_not_found")])
    c.append("evidence", spark.createDataFrame([("t", outcome, "tested", CLASSES[0], "failed", None, 1001)], ingest.OUTCOME_TABLES["evidence"]))
    forged = spark.createDataFrame([("t", trace, outcome, held[outcome])], jobs.schema)
    assert [(r.disposition, r.code) for r in learning.run(c, forged, contracts, 2000).collect()] == [("rejected", "evidence_mismatch")]
    assert learning.stored(c, "procedures").isEmpty()
    # the ids of one version, made again in Python
    jobs = learning.pending(c).where(f"outcome_id = '{ids['again'][1]}'")
    [got] = learning.run(c, jobs, contracts, 2000, policy="p1").collect()
    [row] = learning.stored(c, "procedures").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    one = lambda prefix, **fields: prefix + sha(json.dumps(dict(sorted(fields.items())), separators=(",", ":")))
    intent = one("", task="do it", harness="h", harness_version="")
    effect = sha('[{"contract_id":"c_build","resources":["out"]}]')
    family = one("proc_", tenant_id="t", intent_hash=intent, effect_signature_hash=effect)
    interface = sha('[{"kind":"requirement","resource":"b","schema":"s1"},{"kind":"requirement","resource":"in","schema":"s1"}]')
    assert (row.family_id, row.environment_hash, row.interface_hash, row.goals) == (family, sha("env"), interface, ["tested"])
    assert got.version_id == row.version_id == one("pv_", tenant_id="t", procedure_id=family, graph_hash=row.graph_hash, policy_version="p1", interface_hash=interface)
    other = learning.run(c, jobs, contracts, 2000, policy="p2").collect()
    assert other[0].disposition == "published" and other[0].version_id != got.version_id
