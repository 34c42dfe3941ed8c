import pytest

from tracewright.operators.evidence import CLASSES
from tracewright.plans import ingest
from tracewright.sources.tables import Catalog

TOP = CLASSES[0]
OUTCOME = "tenant_id string, idempotency_key string, outcome_id string, trace_id string, injection_id string, supersedes_id string"
FACT = "outcome_id string, predicate string, class string, verdict string, observed_at long"


def outcomes(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], OUTCOME)


def facts(spark, *rows):
    return spark.createDataFrame([(o, p, k, v, 1000) for o, p, k, v in rows], FACT)


@pytest.fixture
def selections(spark):
    return spark.createDataFrame([("i1", "v1", 900, 2000, True), ("i2", "v2", 900, 2000, True)], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")


def status(df):
    return {r.idempotency_key: (r.status, r.state, r.credit_class) for r in df.collect()}


def sizes(c):
    return {t: c.read(t).count() for t in ingest.OUTCOME_TABLES}


def test_one_commit_repeats_and_crashes(spark, tmp_path, selections, monkeypatch):
    c = Catalog(spark, str(tmp_path))
    o = outcomes(spark, ("k1", "o1", "tr", "i1", None), ("k2", "o2", "tr", "i2", None), ("k3", "o3", "tr", None, None), ("k4", "o4", "tr", "none", None))
    f = facts(spark, ("o1", "p", TOP, "satisfied"), ("o2", "p", TOP, "failed"), ("o3", "p", TOP, "satisfied"), ("o3", "p", TOP, "failed"))
    with monkeypatch.context() as m:
        m.setattr(Catalog, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.commit_outcomes(c, o, f, selections, 1000)
    assert sum(sizes(c).values()) == 0
    want = {"k1": ("accepted", "verified_success", "causal_success"), "k2": ("accepted", "verified_failure", "causal_failure"), "k3": ("accepted", "inconclusive", None), "k4": ("selection_not_found", None, None)}
    assert status(ingest.commit_outcomes(c, o, f, selections, 1000)) == want
    held = {"outcome_receipts": 3, "outcomes": 3, "evidence": 4, "conflict_audits": 1, "credits": 2, "credit_releases": 0, "unsafe": 1, "outcome_jobs": 3}
    assert sizes(c) == held
    again = {k: ("duplicate" if v[0] == "accepted" else v[0], *v[1:]) for k, v in want.items()}
    assert status(ingest.commit_outcomes(c, o, f, selections, 2000)) == again and sizes(c) == held
    other = facts(spark, ("o1", "p", TOP, "failed"), ("o9", "p", TOP, "failed"))
    o = outcomes(spark, ("k1", "o1", "tr", "i1", None), ("k9", "o9", "tr", "i1", None), ("k5", "o1", "tr", "i1", None))
    assert {k: v[0] for k, v in status(ingest.commit_outcomes(c, o, other, selections, 2000)).items()} == {"k1": "conflict", "k9": "credit_claimed", "k5": "conflict"}
    assert sizes(c) == held
    new_key = ingest.commit_outcomes(c, outcomes(spark, ("k6", "o1", "tr", "i1", None)), f, selections, 2000)
    assert status(new_key) == {"k6": ("reused", "verified_success", "causal_success")} and sizes(c) == held | {"outcome_receipts": 4}


def test_a_correction_takes_the_credit_over(spark, tmp_path, selections):
    c = Catalog(spark, str(tmp_path))
    traces = spark.createDataFrame([("t", "tr"), ("t", "tr2")], "tenant_id string, trace_id string")
    run = lambda f, *o: {k: v[0] for k, v in status(ingest.commit_outcomes(c, outcomes(spark, *o), f, selections, 1000, traces)).items()}
    good, bad = facts(spark, ("o1", "p", TOP, "satisfied")), facts(spark, ("o2", "p", TOP, "failed"))
    assert run(good, ("k0", "o0", "gone", None, None), ("k1", "o1", "tr", "i1", None)) == {"k0": "trace_not_found", "k1": "accepted"}
    assert run(bad, ("k2", "o2", "tr2", "i1", "o1"), ("k3", "o3", "tr", None, "none")) == {"k2": "supersession_invalid", "k3": "supersession_invalid"}
    assert run(bad, ("k2", "o2", "tr", "i1", "o1")) == {"k2": "accepted"}
    assert [(r.outcome_id, r.credit_class) for r in ingest.current_credits(c).collect()] == [("o2", "causal_failure")]
    assert c.read("unsafe").count() == 1
    assert run(good, ("k4", "o4", "tr", "i1", "o1")) == {"k4": "credit_claimed"}  # corrects what no longer holds the credit


def test_two_writers_at_once(spark, tmp_path, selections, monkeypatch):
    """The second of two commits that read the same heads fails, and its repeat finds the credit claimed."""
    a, b = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    f = facts(spark, ("o1", "p", TOP, "satisfied"), ("o2", "p", TOP, "satisfied"))
    one, two = (outcomes(spark, (f"k{n}", f"o{n}", "tr", "i1", None)) for n in (1, 2))
    commit = Catalog.commit

    def meanwhile(self, *args):
        if self is a:
            assert status(ingest.commit_outcomes(b, two, f, selections, 1000))["k2"][0] == "accepted"
        return commit(self, *args)

    monkeypatch.setattr(Catalog, "commit", meanwhile)
    with pytest.raises(RuntimeError):
        ingest.commit_outcomes(a, one, f, selections, 1000)
    monkeypatch.setattr(Catalog, "commit", commit)
    assert status(ingest.commit_outcomes(a, one, f, selections, 1000))["k1"][0] == "credit_claimed"
    assert a.read("credits").count() == 1


def test_the_last_goal_fact_wins(spark):
    rows = [("o1", "p", TOP, "failed", 1), ("o1", "p", TOP, "satisfied", 2), ("o2", "p", TOP, "satisfied", 1), ("o2", "p", CLASSES[1], "failed", 1), ("o3", "p", TOP, "satisfied", 3), ("o3", "q", TOP, "failed", 1), ("o4", "p", CLASSES[3], "satisfied", 1)]
    got = {r.outcome_id: (r.goals_satisfied, r.goals_failed) for r in ingest.goal_evidence(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {"o1": (True, False), "o2": (True, False), "o3": (False, True)}


def credited(spark, c, versions, n, start=0, verdict="satisfied"):
    ids = [(f"{v}-{i}", v) for v in versions for i in range(start, start + n)]
    chosen = spark.createDataFrame([(f"i{i}", v, 900, 2000, True) for i, v in ids], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    told = spark.createDataFrame([(f"o{i}", f"i{i}", "p", TOP, verdict, 1000) for i, _ in ids], "outcome_id string, injection_id string, predicate string, class string, verdict string, observed_at long")
    ingest.record_outcomes(c, told, chosen, 1000)


def decided(df):
    return {r.version_id: (r.prior_state, r.next_state) for r in df.collect()}


def test_one_champion_a_family(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    families = spark.createDataFrame([("a", "f"), ("b", "f"), ("x", "g")], "version_id string, family_id string")
    credited(spark, c, ["a", "b", "x"], 12)
    assert set(decided(ingest.promote(c, 1000, families=families)).values()) == {("candidate", "trial")}
    assert decided(ingest.promote(c, 9000, families=families)) == {"a": ("trial", "active"), "x": ("trial", "active")}
    assert ingest.promote(c, 9100, families=families).collect() == []  # counts unchanged, b waits
    credited(spark, c, ["b"], 5, start=12)
    rows = ingest.promote(c, 9200, families=families).collect()  # b has the better bound now, but a holds the place
    assert [(r.version_id, r.next_state, r.reasons) for r in rows] == [("b", "trial", ["champion_conflict"])]
    credited(spark, c, ["a"], 1, start=50, verdict="failed")  # an unsafe outcome: the champion goes, and b may rise
    assert decided(ingest.promote(c, 9300, families=families)) == {"a": ("active", "quarantined"), "b": ("trial", "active")}


def test_of_two_promoters_one_fails(spark, tmp_path, monkeypatch):
    a, b = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    credited(spark, a, ["v"], 12)
    commit = Catalog.commit

    def meanwhile(self, *args):
        if self is a:
            assert decided(ingest.promote(b, 1000)) == {"v": ("candidate", "trial")}
        return commit(self, *args)

    monkeypatch.setattr(Catalog, "commit", meanwhile)
    with pytest.raises(RuntimeError):
        ingest.promote(a, 1000)
    monkeypatch.setattr(Catalog, "commit", commit)
    assert ingest.promote(a, 1000).collect() == [] and a.read("decisions").count() == 1
