"""The learning path: traces in, outcomes evaluated, credit attributed, versions promoted; batches of requests throughout.

Every function takes and gives DataFrames and writes through a Catalog, whose epochs make a batch visible as a whole or
not at all. Writing the archive comes before the commit, so a crash between the two converges when it is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import canonical
from tracewright.functions import scalars as S
from tracewright.operators import causal, evidence, records, tables
from tracewright.sources.tables import Catalog, archive_put, checkpoint

#: Limits of one request, in bytes and events.
VALUE_BYTES, TASK_BYTES, MOST_EVENTS = 64 << 10, 256 << 10, 5000
CONSENT = "learn_and_recall"
#: What requests and events may tell besides, read by `plans.learning`.
REQUEST_FACTS, EVENT_FACTS = ("harness", "harness_version", "environment"), ("tool_version", "state", "exit_code", "accesses")


def sanitize(events: DataFrame) -> DataFrame:
    """events(tenant_id, trace_key, position, tool_name, value, ...) with the value redacted, plus redactions (count)."""
    clean, counts = S.redact(F.col("value"))
    total = sum(counts.values(), F.lit(0))
    return events.withColumn("redactions", total).withColumn("value", clean)


def ingest(catalog: Catalog, archive: str, requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests(tenant_id, idempotency_key, trace_key, task, consent) and their events(tenant_id, trace_key, position,
    tool_name, succeeded, value) -> tenant_id, idempotency_key, trace_id, status: accepted, duplicate, conflict or
    rejected:<rules>. Requests may name harness, harness_version and environment, events the columns of EVENT_FACTS: what
    is named is part of the trace's identity. Accepted traces are archived; traces, events, receipts and jobs are one
    commit, which fails if another writer has added receipts since these were read."""
    c = F.col
    sizes = events.groupBy("tenant_id", "trace_key").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.count_distinct("position").alias("kinds"), F.max(F.octet_length("value")).alias("widest"))
    r = requests.join(sizes, ["tenant_id", "trace_key"], "left").withColumn("row_id", F.concat_ws("\0", "tenant_id", "idempotency_key", "trace_key"))
    erased = catalog.fences().select(c("tenant_id").alias("__tenant")).distinct()
    r = r.join(erased, c("tenant_id") == c("__tenant"), "left")
    rules = {
        "tenant_erased": c("__tenant").isNull(), "consent": c("consent") == CONSENT, "task_size": F.octet_length("task") <= TASK_BYTES, "events": c("n").between(1, MOST_EVENTS), "positions": (c("last") + 1 == c("n")) & (c("kinds") == c("n")),
        "value_size": c("widest") <= VALUE_BYTES, "identity_free_of_secrets": ~S.holds_credentials(c("trace_key")),
    }
    broken = records.violations(r, "row_id", rules).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    steps = F.array_sort(F.collect_list(F.struct("position", "succeeded", "tool_name", "value", *[n for n in EVENT_FACTS if n in events.columns])))
    bodies = sanitize(events).groupBy("tenant_id", "trace_key").agg(F.to_json(steps).alias("steps"))
    task, _ = S.redact(S.token(c("task")))
    named = [n for n in REQUEST_FACTS if n in requests.columns]
    full = r.join(bodies, ["tenant_id", "trace_key"], "left").join(broken, "row_id", "left").withColumn("task", task)
    full = full.withColumn("body", canonical.struct_json(events=c("steps"), task=c("task"), tenant_id=c("tenant_id"), **{n: c(n) for n in named}))
    full = full.withColumn("content_hash", F.sha2("body", 256)).withColumn("trace_id", F.concat(F.lit("tr_"), "content_hash"))
    seen = catalog.head("receipts")
    known = catalog.read("receipts", as_of=seen)
    if known.columns == ["epoch"]:
        known = known.sparkSession.createDataFrame([], "tenant_id string, idempotency_key string, content_hash string")
    known = known.select("tenant_id", "idempotency_key", F.col("content_hash").alias("__old"))
    judged = full.where("rules IS NULL").join(known, ["tenant_id", "idempotency_key"], "left")
    new = tables.idempotent(judged.where("__old IS NULL"), ["tenant_id", "idempotency_key"], "content_hash", ["trace_key"])
    old = judged.where("__old IS NOT NULL").withColumn("status", F.when(c("__old") == c("content_hash"), "duplicate").otherwise("conflict"))
    rejected = full.where("rules IS NOT NULL").withColumn("status", F.concat(F.lit("rejected:"), "rules"))
    columns = ["tenant_id", "idempotency_key", "trace_key", "trace_id", "task", *named, "content_hash", "body", "status"]
    out = checkpoint(new.select(*columns).unionByName(old.select(*columns)).unionByName(rejected.select(*columns)))
    accepted = out.where("status = 'accepted'")
    if not accepted.isEmpty():
        archive_put(accepted.select("tenant_id", F.lit("v1").alias("schema_version"), "content_hash", "body"), archive).count()
        fresh = accepted.select("tenant_id", "trace_key", "trace_id")
        written = accepted.select("tenant_id", "idempotency_key", "trace_id", "content_hash")
        jobs = accepted.select("tenant_id", F.concat(F.lit("job_"), "trace_id").alias("job_id"), F.lit("synthesize").alias("kind"), "trace_id")
        traces = accepted.select("tenant_id", "trace_id", "task", *named, "content_hash").distinct()
        catalog.commit({"traces": traces, "events": sanitize(events).join(fresh, ["tenant_id", "trace_key"]).drop("redactions"), "receipts": written, "outbox": jobs}, {"receipts": seen})
    return out.select("tenant_id", "idempotency_key", "trace_id", "status")


#: Tables of one outcome commit, with what a reader finds where nothing was written yet.
OUTCOME_TABLES = {
    "outcome_receipts": "tenant_id STRING, idempotency_key STRING, outcome_id STRING, content_hash STRING",
    "outcomes": "tenant_id STRING, outcome_id STRING, trace_id STRING, injection_id STRING, supersedes_id STRING, content_hash STRING, state STRING, promotion_eligible BOOLEAN, created_at BIGINT",
    "evidence": "tenant_id STRING, outcome_id STRING, predicate STRING, class STRING, verdict STRING, verifier STRING, observed_at BIGINT",
    "conflict_audits": "tenant_id STRING, outcome_id STRING, predicate STRING, created_at BIGINT",
    "credits": "tenant_id STRING, outcome_id STRING, injection_id STRING, version_id STRING, state STRING, credit_class STRING, reasons ARRAY<STRING>, created_at BIGINT",
    "credit_releases": "tenant_id STRING, outcome_id STRING, released_by STRING",
    "unsafe": "tenant_id STRING, version_id STRING, outcome_id STRING",
    "outcome_jobs": "tenant_id STRING, job_id STRING, kind STRING, outcome_id STRING",
}


def stored(catalog: Catalog, table: str, as_of: int | None = None) -> DataFrame:
    return catalog.read(table, as_of, T.StructType.fromDDL(OUTCOME_TABLES[table]))


def current_credits(catalog: Catalog) -> DataFrame:
    """Credits that no correction has released."""
    gone = stored(catalog, "credit_releases").select("tenant_id", "outcome_id")
    return stored(catalog, "credits").join(gone, ["tenant_id", "outcome_id"], "left_anti")


def commit_outcomes(catalog: Catalog, outcomes: DataFrame, facts: DataFrame, selections: DataFrame, now: int, traces: DataFrame | None = None) -> DataFrame:
    """outcomes(tenant_id, idempotency_key, outcome_id, trace_id, injection_id, supersedes_id), facts(outcome_id, predicate,
    class, verdict, observed_at, and the verifier if it is known) and selections(injection_id, version_id, created_at, expires_at, complete) -> tenant_id,
    idempotency_key, outcome_id, status, state, credit_class, reasons.

    status: accepted; duplicate (the key again, same content); conflict (the key with other content, or the outcome with
    other content); reused (a new key for a stored outcome: a receipt and no more); trace_not_found (not among
    traces(tenant_id, trace_id), if given); supersession_invalid (what it corrects is not stored, or of another trace);
    selection_not_found; credit_claimed (another outcome holds the injection's credit, and this does not correct it).

    Receipts, outcomes, evidence, conflict audits, credits, releases of corrected credits, unsafe counts and jobs are one
    commit, which fails if another writer has added outcomes since these were read: a crash or a repeat changes nothing.
    Of the outcomes of one call for one injection the first by id can take its credit."""
    c, key, who = F.col, ["tenant_id", "idempotency_key"], ["tenant_id", "outcome_id"]
    heads = catalog.heads(*OUTCOME_TABLES)
    read = lambda t: stored(catalog, t, heads[t])
    told = F.array_sort(F.collect_list(F.struct("predicate", "class", "verdict", "observed_at", *[n for n in ("verifier",) if n in facts.columns])))
    body = facts.groupBy("outcome_id").agg(told.alias("told"))
    facts = facts if "verifier" in facts.columns else facts.withColumn("verifier", F.lit(None).cast("string"))
    o = outcomes.select(*key, "outcome_id", "trace_id", "injection_id", "supersedes_id").join(body, "outcome_id", "left")
    o = o.withColumn("content_hash", F.sha2(F.to_json(F.struct("tenant_id", "outcome_id", "trace_id", "injection_id", "supersedes_id", "told")), 256)).drop("told")

    before = read("outcomes").select(*who, c("trace_id").alias("__trace"), c("content_hash").alias("__stored"))
    claims = read("credits").join(read("credit_releases").select(*who), who, "left_anti").select("tenant_id", "injection_id", c("outcome_id").alias("__claimed"))
    first = before.select("tenant_id", c("outcome_id").alias("supersedes_id"), c("__trace").alias("__corrected"))
    known = selections.select("injection_id", F.lit(True).alias("__known"))
    r = o.join(read("outcome_receipts").select(*key, c("content_hash").alias("__receipt")), key, "left")
    r = r.join(before.drop("__trace"), who, "left").join(first, ["tenant_id", "supersedes_id"], "left").join(claims, ["tenant_id", "injection_id"], "left").join(known, "injection_id", "left")
    held = traces.select("tenant_id", "trace_id", F.lit(True).alias("__held")).distinct() if traces is not None else None
    r = r.join(held, ["tenant_id", "trace_id"], "left") if held is not None else r.withColumn("__held", F.lit(True))
    turn = F.row_number().over(Window.partitionBy("tenant_id", "idempotency_key").orderBy("outcome_id"))
    same = F.row_number().over(Window.partitionBy("tenant_id", "outcome_id").orderBy("idempotency_key"))
    r = r.withColumn("__turn", turn).withColumn("__same", same)
    claimed = c("__claimed").isNotNull() & (c("__claimed") != c("outcome_id")) & ~c("__claimed").eqNullSafe(c("supersedes_id"))
    status = (
        F.when(c("__receipt") == c("content_hash"), "duplicate").when(c("__receipt").isNotNull() | (c("__turn") > 1), "conflict")
        .when(c("__held").isNull(), "trace_not_found")
        .when(c("supersedes_id").isNotNull() & ~c("__corrected").eqNullSafe(c("trace_id")), "supersession_invalid")
        .when(c("__stored") == c("content_hash"), "reused").when(c("__stored").isNotNull(), "conflict").when(c("__same") > 1, "conflict")
        .when(c("injection_id").isNotNull() & c("__known").isNull(), "selection_not_found").when(claimed, "credit_claimed").otherwise("accepted")
    )
    r = r.withColumn("status", status)
    place = F.row_number().over(Window.partitionBy("tenant_id", "injection_id").orderBy(c("status") != "accepted", "outcome_id"))
    late = (c("status") == "accepted") & c("injection_id").isNotNull() & (place > 1)
    r = checkpoint(r.withColumn("status", F.when(late, "credit_claimed").otherwise(c("status"))).select(*key, "outcome_id", "trace_id", "injection_id", "supersedes_id", "content_hash", "status", "__claimed"))

    fresh = r.where("status = 'accepted'")
    mine = facts.join(fresh.select("tenant_id", "outcome_id", "injection_id"), "outcome_id")
    predicates = evidence.by_predicate(mine)
    state = fresh.select(*who).join(evidence.outcome_state(predicates), "outcome_id", "left")
    state = state.select(*who, F.coalesce("state", F.lit("inconclusive")).alias("state"), F.coalesce("promotion_eligible", F.lit(False)).alias("promotion_eligible"))
    attributed = fresh.where("injection_id IS NOT NULL").join(state, who).join(goal_evidence(mine), "outcome_id", "left")
    when = evidence.temporal(mine.where("injection_id IS NOT NULL").select("injection_id", "observed_at"), selections, F.lit(now))
    rows = attributed.join(selections.select("injection_id", "version_id", "complete"), "injection_id").join(when, "injection_id")
    no = F.lit(False)
    credited = evidence.credit(rows.withColumns({"goals_satisfied": F.coalesce("goals_satisfied", no), "goals_failed": F.coalesce("goals_failed", no)}))
    at = F.lit(now).cast("long").alias("created_at")
    credits = checkpoint(credited.select(*who, "injection_id", "version_id", "state", "credit_class", "reasons", at))
    new = r.where("status IN ('accepted', 'reused')")
    if not new.isEmpty():
        job = F.concat(F.lit("job_"), F.sha2(F.concat_ws("\0", "tenant_id", "trace_id", "outcome_id"), 256))
        catalog.commit({
            "outcome_receipts": new.select(*key, "outcome_id", "content_hash"),
            "outcomes": fresh.join(state, who).select(*who, "trace_id", "injection_id", "supersedes_id", "content_hash", "state", "promotion_eligible", at),
            "evidence": mine.select(*who, "predicate", "class", "verdict", "verifier", c("observed_at").cast("long").alias("observed_at")),
            "conflict_audits": predicates.where("conflict").join(fresh.select(*who), "outcome_id").select(*who, "predicate", at),
            "credits": credits,
            "credit_releases": fresh.where("__claimed IS NOT NULL").select("tenant_id", c("__claimed").alias("outcome_id"), c("outcome_id").alias("released_by")),
            "unsafe": credits.where("credit_class = 'causal_failure'").select("tenant_id", "version_id", "outcome_id"),
            "outcome_jobs": fresh.select("tenant_id", job.alias("job_id"), F.lit("evaluate").alias("kind"), "outcome_id"),
        }, heads)
    out = r.select(*key, "outcome_id", "status")
    # a repeat is answered with what was stored then
    was = stored(catalog, "credits").select(*who, "credit_class", "reasons")
    return checkpoint(out.join(stored(catalog, "outcomes").select(*who, "state"), who, "left").join(was, who, "left").select(*key, "outcome_id", "status", "state", "credit_class", "reasons"))


def goal_evidence(facts: DataFrame) -> DataFrame:
    """outcome_id, goals_satisfied, goals_failed: by the last fact of each goal predicate from a class that proves; of two at
    one time the stronger, then the failure counts."""
    proof = facts.where(evidence.class_rank(F.col("class")) <= 2)
    order = F.struct("observed_at", -evidence.class_rank(F.col("class")), F.col("verdict") == "failed")
    last = proof.groupBy("outcome_id", "predicate").agg(F.max_by("verdict", order).alias("verdict"))
    return last.groupBy("outcome_id").agg(F.bool_and(F.col("verdict") == "satisfied").alias("goals_satisfied"), F.bool_or(F.col("verdict") == "failed").alias("goals_failed"))


def record_outcomes(catalog: Catalog, facts: DataFrame, selections: DataFrame, now: int) -> DataFrame:
    """Facts that name their injection, outside any tenant: each outcome is its own key, so a repeat changes nothing."""
    none = F.lit(None).cast("string")
    outcomes = facts.groupBy("outcome_id").agg(F.first("injection_id").alias("injection_id"))
    outcomes = outcomes.select(F.lit("").alias("tenant_id"), F.col("outcome_id").alias("idempotency_key"), "outcome_id", none.alias("trace_id"), "injection_id", none.alias("supersedes_id"))
    return commit_outcomes(catalog, outcomes, facts.drop("injection_id"), selections, now).select("outcome_id", "status", "state", "credit_class", "reasons")


def learn(events: DataFrame, tenant_id: str = "acme", policy: str = "default") -> DataFrame:
    """events(trace_id, position, resource, reads, writes, succeeded, goal) -> trace_id, steps, family and version ids of
    the procedure a verified trace proves: what its goals need, and what succeeded besides."""
    edges = checkpoint(causal.flow_edges(events))
    roots = events.where("goal AND succeeded").select("trace_id", "position")
    nodes = events.select("trace_id", "position", "succeeded", F.lit(False).alias("irrelevant"), (~F.col("succeeded")).alias("failed_branch"))
    steps = causal.slice_steps(nodes, causal.ancestors(edges, roots)).join(events.select("trace_id", "position", "resource"), ["trace_id", "position"])
    p = steps.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "resource"))), lambda x: x["resource"]).alias("steps"))
    p = p.withColumns({"tenant_id": F.lit(tenant_id), "intent": F.element_at("steps", -1), "effect": F.array_join("steps", ">"), "policy": F.lit(policy)})
    return records.procedure_ids(p).select("trace_id", "steps", "family_id", "version_id")


DECISIONS = "version_id STRING, family_id STRING, prior_state STRING, next_state STRING, reasons ARRAY<STRING>, wilson_ppm BIGINT, successes BIGINT, failures BIGINT, unsafe BIGINT, decided_at BIGINT"


def promote(catalog: Catalog, now: int, policy: evidence.Lifecycle = evidence.Lifecycle(), unsafe: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """One lifecycle evaluation of every version with credits. A version whose state stays is decided upon only if its
    counts have changed since its last decision; terminal versions are left alone.

    families(version_id, family_id): a family has one champion, its active version that leads by bound, samples and id.
    A version that rises to active while another leads, or is overtaken at once, waits in trial (champion_conflict). The
    stored unsafe outcomes quarantine; unsafe(version_id, unsafe) adds to them. Decisions are published only if no other
    was since the heads were read: of two promoters at once one fails, and reads the other's champion when it repeats."""
    c = F.col
    seen = catalog.heads("decisions", *OUTCOME_TABLES)
    counts = evidence.causal_counts(current_credits(catalog), F.lit(now))
    heads = catalog.read("decisions", seen["decisions"], T.StructType.fromDDL(DECISIONS))
    heads = heads.groupBy("version_id").agg(F.max_by(F.struct("next_state", "decided_at", "successes", "failures", "unsafe", "wilson_ppm"), "epoch").alias("h"), F.max(F.when(c("prior_state") != c("next_state"), c("decided_at"))).alias("changed_at"))
    heads = heads.select("version_id", "changed_at", "h.next_state", "h.decided_at", c("h.successes").alias("was_successes"), c("h.failures").alias("was_failures"), c("h.unsafe").alias("was_unsafe"))
    harm = stored(catalog, "unsafe", seen["unsafe"]).groupBy("version_id").agg(F.count("*").alias("unsafe"))
    if unsafe is not None:
        harm = harm.unionByName(unsafe.select("version_id", c("unsafe").cast("long").alias("unsafe")))
    harm = harm.groupBy("version_id").agg(F.sum("unsafe").alias("unsafe"))
    rows = counts.join(heads, "version_id", "full").join(harm, "version_id", "left").withColumns({
        "successes": F.coalesce("successes", F.lit(0)), "failures": F.coalesce("failures", F.lit(0)), "unsafe": F.coalesce("unsafe", F.lit(0)), "prior_state": F.coalesce("next_state", F.lit("candidate")),
        "trial_started_at": F.when(c("next_state") == "trial", c("changed_at")), "cutoff_at": F.lit(now).cast("long"),
    })
    live = rows.where(~c("prior_state").isin("retired", "quarantined")).drop("next_state")
    family = families.select("version_id", "family_id") if families is not None else live.select("version_id", c("version_id").alias("family_id"))
    decided = evidence.transition(live).join(family, "version_id", "left").withColumn("family_id", F.coalesce("family_id", "version_id"))
    # incumbents come first: who holds the place keeps it as long as it stays active
    lead = F.row_number().over(Window.partitionBy("family_id").orderBy(c("next_state") != "active", c("prior_state") != "active", F.desc("wilson_ppm"), F.desc("samples"), "version_id"))
    waits = (c("next_state") == "active") & (c("prior_state") != "active") & (lead > 1)
    decided = decided.withColumn("__waits", waits).withColumn("next_state", F.when(c("__waits"), c("prior_state")).otherwise(c("next_state"))).withColumn("reasons", F.when(c("__waits"), F.array(F.lit("champion_conflict"))).otherwise(c("reasons")))
    changed = ~(c("successes").eqNullSafe(c("was_successes")) & c("failures").eqNullSafe(c("was_failures")) & c("unsafe").eqNullSafe(c("was_unsafe")))
    kept = decided.where((c("next_state") != c("prior_state")) | (c("decided_at").isNotNull() & changed))
    kept = kept.select("version_id", "family_id", "prior_state", "next_state", "reasons", c("wilson_ppm").cast("long").alias("wilson_ppm"), c("successes").cast("long").alias("successes"), c("failures").cast("long").alias("failures"), c("unsafe").cast("long").alias("unsafe"), F.lit(now).cast("long").alias("decided_at"))
    kept = checkpoint(kept)
    if not kept.isEmpty():
        catalog.commit({"decisions": kept}, seen)
    return kept
