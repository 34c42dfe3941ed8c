"""Evidence algebra, credit, lifecycle: from facts about outcomes to what a version may be used for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S

#: Evidence classes, strongest first.
CLASSES = ("independent_verifier", "goal_predicate", "harness_assertion", "tool_postcondition", "exit_status_or_self_report")


def class_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, c in enumerate(CLASSES):
        out = F.when(name == c, i + 1).otherwise(out)
    return out


def without_superseded(facts: DataFrame, superseded: DataFrame) -> DataFrame:
    return facts.join(superseded.select("evidence_id"), "evidence_id", "left_anti")


def by_predicate(facts: DataFrame, conflict_ceiling: int = 3) -> DataFrame:
    """outcome_id, predicate, satisfied, failed (strongest ranks), conflict. facts(outcome_id, predicate, class, verdict)."""
    rank = class_rank(F.col("class"))
    strongest = lambda v: F.min(F.when(F.col("verdict") == v, rank))
    grouped = facts.groupBy("outcome_id", "predicate").agg(strongest("satisfied").alias("satisfied"), strongest("failed").alias("failed"))
    conflict = F.coalesce((F.col("satisfied") == F.col("failed")) & (F.col("satisfied") <= conflict_ceiling), F.lit(False))
    return grouped.withColumn("conflict", conflict)


def outcome_state(predicates: DataFrame, required: DataFrame | None = None, success_ceiling: int = 2, failure_ceiling: int = 2) -> DataFrame:
    """outcome_id, state, promotion_eligible, conflicts. Without `required`(outcome_id, predicate) the predicates of the
    evidence itself are required."""
    sat, bad = F.col("satisfied"), F.col("failed")
    p = predicates
    if required is not None:
        p = required.withColumn("wanted", F.lit(True)).join(predicates, ["outcome_id", "predicate"], "full")
    else:
        p = p.withColumn("wanted", F.lit(True))
    wanted = F.coalesce(F.col("wanted"), F.lit(False))
    verified = F.coalesce((bad.isNull() | (bad > sat)) & (sat <= success_ceiling), F.lit(False))
    failed = bad.isNotNull() & (sat.isNull() | (bad < sat)) & (bad <= failure_ceiling)
    one = p.groupBy("outcome_id").agg(
        F.bool_or(F.coalesce("conflict", F.lit(False))).alias("any_conflict"),
        F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"),
        F.bool_or(F.when(wanted, failed)).alias("any_failed"),
        F.bool_and(F.when(wanted, verified)).alias("all_verified"),
        F.bool_or(sat.isNotNull()).alias("any_satisfied"),
    )
    state = (
        F.when(F.col("any_conflict"), "inconclusive").when(F.coalesce("any_failed", F.lit(False)), "verified_failure")
        .when(F.coalesce("all_verified", F.lit(False)), "verified_success").when(F.col("any_satisfied"), "provisional_success").otherwise("inconclusive")
    )
    return one.select("outcome_id", state.alias("state"), (state == "verified_success").alias("promotion_eligible"), "conflicts")


# --- credit ------------------------------------------------------------------------------------------------------


def temporal(facts: DataFrame, selections: DataFrame, now: Column, skew_seconds: int = 300) -> DataFrame:
    """injection_id, temporal: every fact lies between the selection's start less the skew and now plus it, and before
    the selection ends. facts(injection_id, observed_at); selections(injection_id, created_at, expires_at); seconds."""
    inside = (F.col("observed_at") >= F.col("created_at") - skew_seconds) & (F.col("observed_at") <= now + skew_seconds) & (F.col("observed_at") < F.col("expires_at"))
    return selections.join(facts, "injection_id", "left").groupBy("injection_id").agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias("temporal"))


def credit(rows: DataFrame) -> DataFrame:
    """rows(state, temporal, complete, goals_satisfied, goals_failed) plus credit_class and reasons (sorted)."""
    state, proof = F.col("state"), F.col("temporal") & F.col("complete")
    kind = (
        F.when(state == "verified_success", F.when(proof & F.col("goals_satisfied"), "causal_success").otherwise("associated_success"))
        .when(state == "provisional_success", "associated_success")
        .when(state == "verified_failure", F.when(proof & F.col("goals_failed"), "causal_failure").otherwise("associated_failure"))
        .otherwise("unattributable")
    )
    reasons = F.array(
        F.when(state == "provisional_success", F.lit("provisional_evidence")),
        F.when(~state.isin("verified_success", "provisional_success", "verified_failure"), F.lit("inconclusive_outcome")),
        F.when(~F.col("temporal"), F.lit("outside_attribution_window")),
        F.when(~F.col("complete"), F.lit("partial_plan")),
        F.when(((state == "verified_success") & ~F.col("goals_satisfied")) | ((state == "verified_failure") & ~F.col("goals_failed")), F.lit("goal_evidence_missing")),
    )
    return rows.withColumn("credit_class", kind).withColumn("reasons", F.array_sort(F.array_compact(reasons)))


def current_credit(credits: DataFrame) -> DataFrame:
    """Credits of outcomes that no later outcome supersedes: one per injection. credits(injection_id, outcome_id,
    supersedes_id, ...)."""
    gone = credits.select(F.col("supersedes_id").alias("outcome_id")).where("outcome_id IS NOT NULL").distinct()
    return credits.join(gone, "outcome_id", "left_anti")


# --- lifecycle ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lifecycle:
    """Promotion thresholds; bounds in ppm, times in seconds."""

    z_squared_ppm: int = 3_841_600
    trial_samples: int = 3
    trial_bound: int = 400_000
    trial_unsafe: int = 0
    active_samples: int = 10
    active_bound: int = 600_000
    active_unsafe: int = 0
    quarantine_unsafe: int = 1
    freshness: int = 90 * 86400
    minimum_trial: int = 3600


def transition(rows: DataFrame, policy: Lifecycle = Lifecycle()) -> DataFrame:
    """rows(prior_state, successes, failures, unsafe, latest_causal_at, trial_started_at, cutoff_at) plus samples,
    wilson_ppm, next_state and reasons in the order in which the tests are made. Terminal states stay; quarantine comes
    before all else; then active, candidate and trial have tests of their own."""
    c, p = F.col, policy
    rows = rows.withColumn("samples", c("successes") + c("failures")).withColumn("wilson_ppm", S.wilson_ppm(c("successes"), c("successes") + c("failures"), p.z_squared_ppm))
    fresh = F.coalesce(c("latest_causal_at") >= c("cutoff_at") - p.freshness, F.lit(False))
    when = lambda test, reason: F.when(test, F.lit(reason))
    pick = lambda *r: F.array_compact(F.array(*r))
    few = lambda n: when(c("samples") < n, "insufficient_causal_samples")
    low = lambda b: when(c("wilson_ppm") < b, "wilson_lower_bound_below_threshold")
    unsafe = lambda n: when(c("unsafe") > n, "unsafe_outcome_ceiling_exceeded")
    failing = pick(when(~fresh, "causal_evidence_stale"), few(p.active_samples), low(p.active_bound), unsafe(p.active_unsafe))
    entering = pick(few(p.trial_samples), low(p.trial_bound), unsafe(p.trial_unsafe))
    short = F.coalesce(c("trial_started_at") > c("cutoff_at") - p.minimum_trial, F.lit(True))
    rising = pick(few(p.active_samples), low(p.active_bound), when(short, "minimum_trial_duration_incomplete"))
    one = lambda *r: F.array(*map(F.lit, r))
    result = lambda state, reasons: F.struct(F.lit(state).alias("state") if isinstance(state, str) else state.alias("state"), reasons.alias("reasons"))
    prior = c("prior_state")
    outcome = (
        F.when(prior.isin("retired", "quarantined"), result(prior, one("terminal_state_unchanged")))
        .when(c("unsafe") >= p.quarantine_unsafe, result("quarantined", one("immediate_quarantine_triggered")))
        .when((prior == "active") & (F.size(failing) > 0), result("retired", F.concat(one("active_version_rolled_back"), failing)))
        .when(prior == "active", result("active", one("state_maintained")))
        .when(~fresh, result(prior, one("causal_evidence_stale")))
        .when((prior == "candidate") & (F.size(entering) > 0), result("candidate", entering))
        .when(prior == "candidate", result("trial", one("candidate_promoted_to_trial")))
        .when(c("unsafe") > p.active_unsafe, result("candidate", one("unsafe_outcome_ceiling_exceeded")))
        .when((c("samples") >= p.trial_samples) & (c("wilson_ppm") < p.trial_bound), result("candidate", one("trial_version_demoted", "wilson_lower_bound_below_threshold")))
        .when(F.size(rising) > 0, result("trial", rising))
        .otherwise(result("active", one("trial_promoted_to_active")))
    )
    return rows.withColumn("__r", outcome).withColumn("next_state", F.col("__r.state")).withColumn("reasons", F.col("__r.reasons")).drop("__r")


def causal_counts(credits: DataFrame, cutoff: Column) -> DataFrame:
    """version_id, successes, failures, latest_causal_at up to the cutoff."""
    causal = credits.where(F.col("created_at") <= cutoff)
    return causal.groupBy("version_id").agg(
        F.count_if(F.col("credit_class") == "causal_success").alias("successes"),
        F.count_if(F.col("credit_class") == "causal_failure").alias("failures"),
        F.max(F.when(F.col("credit_class").isin("causal_success", "causal_failure"), F.col("created_at"))).alias("latest_causal_at"),
    )


def champions(heads: DataFrame) -> DataFrame:
    """The one active version of each family that leads: highest bound, then most samples, then id."""
    order = Window.partitionBy("family_id").orderBy(F.desc("wilson_ppm"), F.desc("samples"), "version_id")
    return heads.where("state = 'active'").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


# --- experiments -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Experiment:
    tenant_id: str
    procedure_id: str
    epoch: int
    champion: str
    challengers: tuple[str, ...]
    exposure_ppm: int
    window_seconds: int = 86400
    ttl_seconds: int = 3600
    high_risk_opt_in: bool = False
    maximum_concurrent: int = 1
    tenant_limit: int = 1_000_000
    global_limit: int = 1_000_000
    tenant_unsafe: int = 0
    global_unsafe: int = 0


def assign(requests: DataFrame, e: Experiment) -> DataFrame:
    """requests(key, risk, concurrent, tenant_exposure, global_exposure, tenant_unsafe, global_unsafe, assigned_at) plus
    digest, bucket, challenger, version_id, reasons, window_start, expires_at."""
    c = F.col
    body = F.concat(
        F.lit(f'{{"experiment_epoch":{e.epoch},"procedure_id":"{e.procedure_id}","query_bucket_hash":"'), c("key"), F.lit(f'","tenant_id":"{e.tenant_id}"}}')
    )
    rows = requests.withColumn("digest", F.sha2(body, 256)).withColumn("bucket", S.hash_bucket(c("digest")))
    blocks = {
        "champion_bucket": c("bucket") >= e.exposure_ppm,
        "critical_risk_champion_only": c("risk") == "critical",
        "high_risk_opt_in_required": (c("risk") == "high") & F.lit(not e.high_risk_opt_in),
        "concurrent_trial_cap_reached": c("concurrent") > e.maximum_concurrent,
        "tenant_exposure_cap_reached": c("tenant_exposure") >= e.tenant_limit,
        "global_exposure_cap_reached": c("global_exposure") >= e.global_limit,
        "tenant_unsafe_ceiling_exceeded": c("tenant_unsafe") > e.tenant_unsafe,
        "global_unsafe_ceiling_exceeded": c("global_unsafe") > e.global_unsafe,
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in blocks.items()])))
    pick = F.element_at(F.array(*map(F.lit, e.challengers)), (S.hash_bucket(c("digest"), len(e.challengers), 8) + 1).cast("int"))
    rows = rows.withColumn("reasons", reasons).withColumn("challenger", F.size("reasons") == 0)
    rows = rows.withColumn("version_id", F.when(c("challenger"), pick).otherwise(e.champion))
    rows = rows.withColumn("reasons", F.when(c("challenger"), F.array(F.lit("challenger_bucket"))).otherwise(c("reasons")))
    start = S.window_start(c("assigned_at"), e.window_seconds)
    ends = F.least(c("assigned_at") + e.ttl_seconds, start + e.window_seconds)
    return rows.withColumn("window_start", start).withColumn("expires_at", ends)


def reserve(assignments: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Plus granted: within (tenant_id, window_start), exposures in order as long as fewer than `limit` came before."""
    w = Window.partitionBy("tenant_id", "window_start").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("wants").cast("long")).over(w), F.lit(0))
    return assignments.withColumn("granted", F.col("wants") & (before < limit))


def exposure(assignments: DataFrame) -> DataFrame:
    """Counters per tenant and window, and over all tenants, in one pass: tenant_id is null in the rows over all."""
    return assignments.groupingSets([["tenant_id", "window_start"], ["window_start"]], "tenant_id", "window_start").agg(
        F.grouping("tenant_id").cast("long").alias("is_global"), F.count("*").alias("exposures"), F.count_if("unsafe").alias("unsafe")
    )
