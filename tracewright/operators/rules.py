"""What a record must fulfil before it is stored or used, as rule columns for `records.violations`, and the hashes, counts
and ids that such records carry. A rule that meets null is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.functions import scalars as S

#: Lifecycle states and the shapes of stored names.
STATES = ("candidate", "trial", "active", "retired", "quarantined")
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}$"
SHA256 = r"^[0-9a-f]{64}$"
MOST_GOALS, MOST_RESOURCES, MOST_REASONS = 1_024, 16_384, 32
MOST_RETENTION = 30 * 86_400


def strict(values: Column, prefix: str = "", empty: bool = True) -> Column:
    """Sorted, without repeats, every one with the prefix."""
    ok = S.is_normalized_set(values) & F.forall(values, lambda v: v.startswith(prefix))
    return ok if empty else ok & (F.size(values) > 0)


def sealed(prefix: str, content: Column) -> Column:
    """The columns id and content_hash are what the content gives."""
    return (F.col("content_hash") == F.sha2(content, 256)) & (F.col("id") == F.concat(F.lit(prefix), "content_hash"))


# --- lifecycle ---------------------------------------------------------------------------------------------------


def decision_content() -> Column:
    c = F.col
    return F.to_json(F.struct("cutoff_at", "evaluated_at", "next_state", "policy_id", "prior_state", "reasons", "version_id", c("wilson_ppm").cast("long").alias("wilson_ppm")))


def decision_rules() -> dict[str, Column]:
    """Of decisions(id, content_hash, version_id, policy_id, prior_state, next_state, reasons, wilson_ppm, cutoff_at,
    evaluated_at): what was decided, on what evidence, and that nothing was changed since."""
    c = F.col
    return {
        "names": c("version_id").rlike(TOKEN) & c("policy_id").rlike(TOKEN), "states": c("prior_state").isin(*STATES) & c("next_state").isin(*STATES),
        "confidence": c("wilson_ppm").between(0, S.PPM), "cutoff_before_evaluation": c("cutoff_at") <= c("evaluated_at"),
        "reasons": strict(c("reasons"), empty=False) & (F.size("reasons") <= MOST_REASONS) & F.forall("reasons", lambda r: r.rlike(TOKEN)), "hash": sealed("lcd_", decision_content()),
    }


def evidence_rules() -> dict[str, Column]:
    """Of evidence(latest_causal_at, trial_started_at, cutoff_at, triggers): none of it after the cutoff; times may be null."""
    c = F.col
    early = lambda at: F.when(at.isNull(), F.lit(True)).otherwise(at <= c("cutoff_at"))
    return {"causal_before_cutoff": early(c("latest_causal_at")), "trial_before_cutoff": early(c("trial_started_at")), "triggers": strict(c("triggers"))}


def effective_unsafe(documents: DataFrame, recorded: DataFrame) -> DataFrame:
    """version_id, unsafe: the larger of what a version's documents say and of the unsafe outcomes recorded since.
    documents(version_id, unsafe), recorded(version_id), one row per unsafe outcome of a version."""
    said = documents.groupBy("version_id").agg(F.max("unsafe").cast("long").alias("__said"))
    seen = recorded.groupBy("version_id").agg(F.count("*").alias("__seen"))
    return said.join(seen, "version_id", "left").select("version_id", F.greatest(F.coalesce("__said", F.lit(0)), F.coalesce("__seen", F.lit(0))).cast("long").alias("unsafe"))


def supporting_outcomes(support: DataFrame) -> DataFrame:
    """version_id, supporting (distinct outcomes), mentions. support(version_id, outcome_id)."""
    return support.groupBy("version_id").agg(F.count_distinct("outcome_id").alias("supporting"), F.count("*").alias("mentions"))


# --- planning ----------------------------------------------------------------------------------------------------

RESOURCES = ("reads", "writes", "exclusive", "mutexes")


def planning_facts(versions: DataFrame) -> DataFrame:
    """versions(version_id, interface_hash, lifecycle, policy_id, goals, reads, writes, exclusive, mutexes,
    evidence_strength, tool_cost) plus facts_hash: over the facts a plan may use, lists trimmed and in order. Null where
    the facts are out of bounds: too many, a resource that is none, no cost, a repeated goal."""
    c = F.col
    goals = F.array_sort(F.transform("goals", lambda g: S.token(g)))
    lists = {name: S.normalized_set(c(name)) for name in RESOURCES}
    entries = sum((F.size(name) for name in RESOURCES), F.lit(0))
    fits = (F.size("goals") <= MOST_GOALS) & (entries <= MOST_RESOURCES) & (F.size(F.array_distinct(goals)) == F.size(goals)) & ~F.array_contains(goals, "")
    for name in RESOURCES[:3]:
        fits = fits & strict(lists[name], "res_")
    fits = fits & S.token(c("version_id")).rlike(TOKEN) & c("interface_hash").rlike(SHA256) & c("lifecycle").isin(*STATES) & S.token(c("policy_id")).rlike(TOKEN) & (c("evidence_strength") >= 0) & (c("tool_cost") > 0)
    fields = dict(lists, version_id=S.token(c("version_id")), interface_hash=c("interface_hash"), lifecycle=c("lifecycle"), policy_id=S.token(c("policy_id")), goals=goals, evidence_strength=c("evidence_strength").cast("long"), tool_cost=c("tool_cost").cast("long"))
    return versions.withColumn("facts_hash", F.when(fits, canonical.struct_hash("", **fields)))


def candidate_set_hash(candidates: DataFrame, keys: list[str], order: str, member: Column) -> DataFrame:
    """keys, set_hash: over the members of a planner's candidate set in order, whatever order they came in."""
    rows = candidates.select(*keys, F.struct(F.col(order).alias("at"), member.alias("member")).alias("__m")).distinct()
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("__m")), lambda m: m["member"]), ";"), 256).alias("set_hash"))


def edge_rules() -> dict[str, Column]:
    """Of edges(tenant_id, epoch_no, graph_tenant_id, graph_epoch_no, src, dst, provisions, requirements): an edge belongs to
    its graph, leads elsewhere, and names what it offers and what that satisfies without wildcards."""
    c = F.col
    plain = lambda v: F.forall(v, lambda x: ~x.contains("*"))
    return {
        "tenant": c("tenant_id") == c("graph_tenant_id"), "epoch": c("epoch_no") == c("graph_epoch_no"), "ends": (c("src") != "") & (c("dst") != "") & (c("src") != c("dst")),
        "provisions": strict(c("provisions"), "prov_", empty=False) & plain(c("provisions")), "requirements": strict(c("requirements"), "req_", empty=False) & plain(c("requirements")),
    }


def selection_rules() -> dict[str, Column]:
    """Of selections(plan_id, plan_hash, complete, novelty, bridges, gaps, steps, schedule struct(plan_id, plan_hash, steps)
    or null, experiment_id, assignment_id): a complete plan has its own schedule over all its steps, and is bridged where
    it has bridges; a partial one has gaps, no schedule, and says so."""
    c, s = F.col, F.col("schedule")
    return {
        "novelty": F.when(c("complete"), (c("novelty") != "partial") & ((c("bridges") > 0) == (c("novelty") == "bridged"))).otherwise(c("novelty") == "partial"),
        "schedule": F.when(c("complete"), s.isNotNull()).otherwise(s.isNull()),
        "schedule_of_plan": F.when(s.isNull(), F.lit(True)).otherwise((s["plan_id"] == c("plan_id")) & (s["plan_hash"] == c("plan_hash")) & (F.array_sort(s["steps"]) == F.array_sort("steps"))),
        "gaps": c("complete") | (c("gaps") > 0), "experiment": c("experiment_id").isNull() == c("assignment_id").isNull(),
    }


# --- synthesis ---------------------------------------------------------------------------------------------------


def required_effects(nodes: DataFrame) -> DataFrame:
    """nodes(.., succeeded, side_effect): the succeeded ones that changed something outside."""
    return nodes.where(F.col("succeeded") & F.col("side_effect").isin("write", "external", "irreversible"))


def failed_branches(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """nodes(trace_id, position, succeeded, opaque, contract, inputs, resources), results(trace_id, position, state,
    exit_code) -> trace_id, position, predicate, tool_hash, resource_hash, unresolved: one row per failed step whose contract
    is known, named by how it failed. A failed step without a result is unresolved."""
    c = F.col
    failed = nodes.where("NOT succeeded AND NOT opaque").join(results.select("trace_id", "position", "state", "exit_code"), ["trace_id", "position"], "left")
    failure = canonical.struct_hash("", state=c("state"), exit_code=c("exit_code"))
    return failed.select(
        "trace_id", "position", F.when(c("state").isNotNull(), F.concat_ws(":", F.lit("tool_failure"), "contract", failure)).alias("predicate"),
        canonical.struct_hash("", contract_version_id=c("contract"), inputs=c("inputs")).alias("tool_hash"), F.sha2(F.to_json(F.array_sort("resources")), 256).alias("resource_hash"), c("state").isNull().alias("unresolved"),
    )


def goals(facts: DataFrame, weakest: int = 2) -> DataFrame:
    """outcome_id, goals: the predicates satisfied by evidence of rank `weakest` or better, each once, in order.
    facts(outcome_id, predicate, verdict, class_rank)."""
    good = facts.where((F.col("verdict") == "satisfied") & (F.col("class_rank") <= weakest))
    return good.groupBy("outcome_id").agg(F.array_sort(F.collect_set("predicate")).alias("goals"))


def negative_path_records(paths: DataFrame) -> DataFrame:
    """paths(version_id, path_id) plus record_id: one record per version that avoids the path, stored once."""
    return paths.select("version_id", "path_id").distinct().withColumn("record_id", canonical.struct_hash("negpv_", procedure_version_id=F.col("version_id"), path_id=F.col("path_id")))


def checkpoints(completed: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """scope, generation, latest: every completed batch makes one more generation. completed(scope, batch);
    earlier(scope, generation): generations counted before."""
    out = completed.groupBy("scope").agg(F.count_distinct("batch").alias("generation"), F.max("batch").alias("latest"))
    if earlier is None:
        return out
    known = earlier.groupBy("scope").agg(F.max("generation").alias("__before"))
    return out.join(known, "scope", "left").select("scope", (F.col("generation") + F.coalesce("__before", F.lit(0))).alias("generation"), "latest")


def retained(rows: DataFrame, completed: str, seconds: int) -> DataFrame:
    """rows plus expires_at. More than thirty days is refused."""
    if not 0 < seconds <= MOST_RETENTION:
        raise ValueError("retention must be positive and at most thirty days")
    return rows.withColumn("expires_at", F.col(completed) + seconds)
