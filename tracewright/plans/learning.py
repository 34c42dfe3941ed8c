"""From stored traces and outcomes to procedures, for a batch of jobs at a time: load, evaluate, build, synthesize, publish.

Each stage is joins and aggregates over all workflows of the batch. A workflow is one outcome of one trace; what it came
to (a published procedure, an abstention with its reason, a fold into a recalled procedure, a rejected job) is stored with
the hashes of its stages, all in one commit. Ids come from contents, so the same jobs again publish nothing new.

Lists are gathered per trace only, whose events ingestion bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import canonical
from tracewright.functions import scalars as S
from tracewright.operators import causal, evidence, records, rules
from tracewright.plans import ingest
from tracewright.sources.tables import Catalog, checkpoint

STRINGS = "ARRAY<STRING>"
SOURCES = {
    "traces": "tenant_id STRING, trace_id STRING, task STRING, harness STRING, harness_version STRING, environment STRING, content_hash STRING",
    "events": "tenant_id STRING, trace_id STRING, position INT, tool_name STRING, tool_version STRING, succeeded BOOLEAN, value STRING, state STRING, exit_code INT, accesses ARRAY<STRUCT<resource: STRING, schema: STRING, reads: BOOLEAN, writes: BOOLEAN>>",
}
TABLES = {
    "procedures": "tenant_id STRING, version_id STRING, family_id STRING, graph_hash STRING, environment_hash STRING, interface_hash STRING, policy STRING, goals ARRAY<STRING>, content_hash STRING, created_at BIGINT",
    "procedure_steps": "tenant_id STRING, version_id STRING, ordinal BIGINT, step_id STRING, tool_name STRING, tool_version STRING, contract_id STRING, uncertain_necessity BOOLEAN, side_effect STRING, risk STRING",
    "procedure_edges": "tenant_id STRING, version_id STRING, edge_id STRING, src BIGINT, dst BIGINT, resource STRING",
    "procedure_interfaces": "tenant_id STRING, version_id STRING, kind STRING, resource STRING, schema STRING",
    "procedure_documents": f"tenant_id STRING, version_id STRING, family_id STRING, task STRING, intent_hash STRING, contracts {STRINGS}, resources {STRINGS}, effects {STRINGS}, risk INT, harness STRING, verification_strength BIGINT, lifecycle STRING, validated_at BIGINT, content_hash STRING",
    "negative_paths": "tenant_id STRING, version_id STRING, path_id STRING, record_id STRING",
    "synthesis_manifests": "tenant_id STRING, manifest_id STRING, workflow_id STRING, outcome_id STRING, trace_id STRING, version_id STRING, status STRING, code STRING, archive_hash STRING, synthesis_hash STRING, created_at BIGINT",
    "stage_artifacts": "tenant_id STRING, workflow_id STRING, stage STRING, input_hash STRING, output_hash STRING, code STRING",
}


def columns(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames()


def stored(catalog: Catalog, table: str, as_of: int | None = None) -> DataFrame:
    """A table of this path; what an older writer did not say is null."""
    schema = T.StructType.fromDDL((SOURCES | TABLES)[table])
    rows = catalog.read(table, as_of, schema)
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


# --- load, evaluate ----------------------------------------------------------------------------------------------


def workflow_id() -> Column:
    blank = F.coalesce("outcome_id", F.lit(""))
    return canonical.struct_hash("wf_", tenant_id=F.col("tenant_id"), trace_id=F.col("trace_id"), outcome_id=blank, content_hash=F.col("content_hash"))


def pending(catalog: Catalog) -> DataFrame:
    """The stored jobs that no workflow has taken up: of traces (no outcome yet) and of outcomes."""
    outcomes = ingest.stored(catalog, "outcomes").select("tenant_id", "outcome_id", "trace_id", "content_hash")
    of_outcomes = ingest.stored(catalog, "outcome_jobs").select("tenant_id", "outcome_id").join(outcomes, ["tenant_id", "outcome_id"])
    of_traces = stored(catalog, "traces").select("tenant_id", "trace_id", F.lit(None).cast("string").alias("outcome_id"), "content_hash")
    jobs = of_traces.unionByName(of_outcomes).distinct().withColumn("workflow_id", workflow_id())
    return jobs.join(stored(catalog, "stage_artifacts").select("workflow_id").distinct(), "workflow_id", "left_anti").drop("workflow_id")


def load(jobs: DataFrame, traces: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs(tenant_id, trace_id, outcome_id, content_hash) with their trace and outcome, and failure: trace_not_found,
    outcome_not_found, trace_mismatch (the outcome is of another trace), content_mismatch (the job was made for other
    content), awaiting_outcome (a job of a trace alone). One row per distinct job."""
    c = F.col
    held = traces.groupBy("tenant_id", "trace_id").agg(F.max(F.struct(c("content_hash").alias("archive_hash"), "task", "harness", "harness_version", "environment")).alias("t"))
    o = outcomes.select("tenant_id", "outcome_id", c("trace_id").alias("__trace"), c("content_hash").alias("__hash"), "injection_id", c("state").alias("stored_state"), c("promotion_eligible").alias("stored_eligible"))
    rows = jobs.select("tenant_id", "trace_id", "outcome_id", "content_hash").distinct().withColumn("workflow_id", workflow_id())
    rows = rows.join(held.select("tenant_id", "trace_id", "t.*"), ["tenant_id", "trace_id"], "left").join(o, ["tenant_id", "outcome_id"], "left")
    alone = c("outcome_id").isNull()
    failure = (
        F.when(c("archive_hash").isNull(), "trace_not_found").when(~alone & c("__hash").isNull(), "outcome_not_found")
        .when(~alone & ~c("__trace").eqNullSafe(c("trace_id")), "trace_mismatch")
        .when(~c("content_hash").eqNullSafe(F.when(alone, c("archive_hash")).otherwise(c("__hash"))), "content_mismatch").when(alone, "awaiting_outcome")
    )
    return rows.withColumn("failure", failure).drop("__trace", "__hash")


def evaluate(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """sources plus state, evaluation_hash and strength (of verification) from the stored evidence itself; an outcome whose
    stored state is not what its evidence gives fails with evidence_mismatch."""
    both = ["tenant_id", "outcome_id"]
    f = facts.withColumn("outcome_id", F.struct(*both))
    told = evidence.outcome_state(evidence.by_predicate(f)).join(records.verification_strength(f), "outcome_id")
    told = told.select("outcome_id.*", "state", F.col("promotion_eligible").alias("eligible"), "strength")
    out = sources.join(told, both, "left").withColumns({"state": F.coalesce("state", F.lit("inconclusive")), "eligible": F.coalesce("eligible", F.lit(False)), "strength": F.coalesce("strength", F.lit(0))})
    same = (F.col("state") == F.col("stored_state")) & (F.col("eligible") == F.col("stored_eligible"))
    out = out.withColumn("failure", F.coalesce("failure", F.when(~F.coalesce(same, F.lit(False)), "evidence_mismatch")))
    return out.withColumn("evaluation_hash", canonical.struct_hash("", outcome_id=F.col("outcome_id"), state=F.col("state"), eligible=F.col("eligible"), strength=F.col("strength").cast("long")))


# --- build -------------------------------------------------------------------------------------------------------


#: Kinds of calls go to the tasks of the events up to these bounds; more are joined.
MOST_KINDS, MOST_KIND_BYTES = 4_096, 16 << 20


@dataclass(frozen=True)
class Graphs:
    """Causal graphs, keyed by trace_id, here the number of a workflow: nodes, edges and one row of facts a workflow. kinds:
    what is known of each different call (its tool, version and contract), which nodes name by number."""

    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame
    kinds: DataFrame

    def told(self, nodes: DataFrame) -> DataFrame:
        """nodes(.., kind) with their tool, version and contract."""
        return nodes.join(self.kinds, "kind").drop("kind")


def kinds_of(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """tenant, kind, tool_name, tool_version, contract_id, opaque, side_effect, risk, effects, predicates, methods: each
    different call of a tenant meets the contracts once, however many events make it."""
    c, none = F.col, F.array().cast("array<string>")
    name = lambda n: F.concat_ws("\0", "tenant_id", n)
    calls = events.select("tenant_id", "tool_name", "tool_version").distinct()
    calls = calls.select(F.struct("tenant_id", "tool_name", "tool_version").alias("call_id"), name("tool_name").alias("name"), c("tool_version").alias("version"))
    found = causal.resolve_contracts(calls, contracts.withColumn("name", name("name"))).select("call_id.*", "contract_id", "opaque")
    told = contracts.select("tenant_id", "contract_id", "side_effect", "risk", "effects", "predicates", "methods")
    kinds = found.join(told, ["tenant_id", "contract_id"], "left").withColumns({k: F.coalesce(k, none) for k in ("effects", "predicates", "methods")})
    kinds = checkpoint(kinds.withColumnRenamed("tenant_id", "tenant").withColumn("kind", F.monotonically_increasing_id()))
    n, size = kinds.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(kinds) if n <= MOST_KINDS and (size or 0) <= MOST_KIND_BYTES else kinds


def build(events: DataFrame, workflows: DataFrame, contracts: DataFrame) -> Graphs:
    """events(tenant_id, trace_id, position, ...) of the workflows(tenant_id, trace_id, number) meet their tenant's
    contracts(tenant_id, contract_id, name, version, minimum, maximum, side_effect, risk, effects, predicates, methods). A
    trace with several outcomes comes once for each. facts: graph_hash, opaque (a call without a contract), failure:
    failed_step_without_result, conflicting_resource (one resource described in two ways)."""
    c, kinds = F.col, kinds_of(events, contracts)
    e = events.where("position IS NOT NULL").withColumn("accesses", F.coalesce("accesses", F.array()))
    known = kinds.select("tenant", "kind", "opaque", c("tool_name").alias("__name"), c("tool_version").alias("__version"))
    e = e.join(known, (c("tenant_id") == c("tenant")) & c("tool_name").eqNullSafe(c("__name")) & c("tool_version").eqNullSafe(c("__version")))
    e = e.join(workflows.select("tenant_id", "trace_id", "number"), ["tenant_id", "trace_id"])
    nodes = checkpoint(e.select(c("number").alias("trace_id"), "position", "kind", "opaque", "succeeded", "value", "state", "exit_code", "accesses"))
    kinds = kinds.drop("tenant", "opaque")
    accesses = nodes.select("trace_id", "position", F.inline("accesses"))
    edges = checkpoint(causal.flow_edges(accesses))
    one = F.struct("position", "tool_name", "tool_version", "contract_id", "succeeded", "accesses")
    links = edges.groupBy("trace_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("src", "dst", "resource")))).alias("links"))
    named = nodes.select("trace_id", "position", "kind", "opaque", "succeeded", "state", "accesses").join(kinds.select("kind", "tool_name", "tool_version", "contract_id"), "kind")
    facts = named.groupBy("trace_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("told"), F.bool_or("opaque").alias("opaque"), F.bool_or(~c("succeeded") & ~c("opaque") & c("state").isNull()).alias("silent"))
    schema = F.coalesce("schema", F.lit(""))
    two_ways = accesses.groupBy("trace_id", "resource").agg(F.min(schema).alias("least"), F.max(schema).alias("most")).where("least <> most")
    facts = facts.join(links, "trace_id", "left").join(two_ways.select("trace_id", F.lit(True).alias("clash")).distinct(), "trace_id", "left")
    failure = F.when(c("silent"), "failed_step_without_result").when(c("clash"), "conflicting_resource")
    graph_hash = F.sha2(F.concat_ws("\0", "told", F.coalesce("links", F.lit("[]"))), 256)
    return Graphs(nodes, edges, checkpoint(facts.select("trace_id", graph_hash.alias("graph_hash"), "opaque", failure.alias("graph_failure"))), kinds)


# --- synthesize --------------------------------------------------------------------------------------------------


def synthesize(sources: DataFrame, graphs: Graphs, facts: DataFrame, policy: str) -> dict[str, DataFrame]:
    """Procedures of the workflows among sources (evaluated, graph joined) that have no failure.

    results: workflow_id, number, abstention (outcome_not_verified, opaque_tool, uncovered_goal, failed_prerequisite),
    failure (ambiguous_provision), family_id, version_id, synthesis_hash and what the ids are made of; steps, edges,
    interface and negative: the workflow's number and their rows. The goals are the predicates of the outcome's evidence;
    each must be proven by a step that succeeded, itself or by the verifier. What the goals and the lasting effects need
    is kept, and what succeeded besides is kept as of uncertain necessity."""
    c, nodes = F.col, graphs.nodes
    live = checkpoint(sources.where("failure IS NULL"))
    proofs = facts.join(live.select("tenant_id", "outcome_id", "number"), ["tenant_id", "outcome_id"]).select(c("number").alias("trace_id"), "predicate", "verifier")
    wanted = checkpoint(proofs.select("trace_id", "predicate").distinct())
    good = graphs.told(nodes.where("succeeded").select("trace_id", "position", "succeeded", "kind"))
    proven = checkpoint(causal.goal_verifiers(proofs, good))
    bare = wanted.join(proven.select("trace_id", "predicate"), ["trace_id", "predicate"], "left_anti").select(c("trace_id").alias("number"), F.lit(True).alias("bare")).distinct()
    goals = wanted.groupBy(c("trace_id").alias("number")).agg(F.array_sort(F.collect_set("predicate")).alias("goals"))
    r = live.join(goals, "number", "left").join(bare, "number", "left")
    first = F.when(c("state") != "verified_success", "outcome_not_verified").when(c("opaque"), "opaque_tool").when(c("bare") | c("goals").isNull(), "uncovered_goal")
    r = checkpoint(r.withColumn("abstention", first).drop("bare"))

    covered = r.where("abstention IS NULL").select(c("number").alias("trace_id"))
    edges = checkpoint(graphs.edges.join(covered, "trace_id", "left_semi"))
    roots = proven.select("trace_id", F.explode("verifiers").alias("position")).unionByName(rules.required_effects(good).select("trace_id", "position"))
    retained = causal.ancestors(edges, roots.join(covered, "trace_id", "left_semi"))
    unmet = checkpoint(retained.join(nodes.where("NOT succeeded").select("trace_id", "position"), ["trace_id", "position"], "left_semi").select("trace_id").distinct())
    r = r.join(unmet.select(c("trace_id").alias("number"), F.lit("failed_prerequisite").alias("__unmet")), "number", "left").withColumn("abstention", F.coalesce("abstention", "__unmet")).drop("__unmet")
    branch = nodes.select("trace_id", "position", "succeeded", F.lit(False).alias("irrelevant"), (~c("succeeded") & ~c("opaque")).alias("failed_branch"), "kind", "accesses")
    branch = branch.join(covered.join(unmet, "trace_id", "left_anti"), "trace_id", "left_semi")
    steps = checkpoint(causal.slice_steps(branch, retained).select("trace_id", "position", "ordinal", "uncertain_necessity", "kind", "accesses"))
    at = lambda end: steps.select("trace_id", c("position").alias(end), c("ordinal").alias(f"__{end}"))
    inner = checkpoint(edges.join(at("src"), ["trace_id", "src"]).join(at("dst"), ["trace_id", "dst"]))
    links = inner.select("trace_id", c("__src").alias("src"), c("__dst").alias("dst"), "resource")
    used = steps.select("trace_id", "position", F.inline("accesses"))
    schema = used.groupBy("trace_id", "resource").agg(F.max(F.coalesce("schema", F.lit(""))).alias("schema"))
    asked, given = causal.requirements(used, inner), causal.provisions(used, inner)
    interface = asked.withColumn("kind", F.lit("requirement")).unionByName(given.withColumn("kind", F.lit("provision"))).join(schema, ["trace_id", "resource"])
    interface = checkpoint(interface)

    resources = F.transform("accesses", lambda a: a["resource"])
    mode = lambda kind: F.array_sort(F.transform(F.filter("accesses", lambda a: a[kind]), lambda a: a["resource"]))
    steps = graphs.told(steps).withColumns({"resources": F.array_sort(resources), "reads": mode("reads"), "writes": mode("writes")}).drop("accesses")
    logical = ["ordinal", "tool_name", "tool_version", "contract_id", "uncertain_necessity", "side_effect", "risk", "effects", "predicates", "methods", "reads", "writes"]
    gathered = lambda *names: F.sort_array(F.collect_list(F.struct(*names)))
    s = steps.groupBy(c("trace_id").alias("number")).agg(gathered(*logical).alias("steps"), F.count_if("uncertain_necessity").alias("n_uncertain"))
    lasting = rules.required_effects(steps.select("trace_id", "ordinal", "contract_id", "writes", "side_effect", F.lit(True).alias("succeeded")))
    lasting = lasting.groupBy(c("trace_id").alias("number")).agg(gathered("ordinal", "contract_id", "writes").alias("__lasting"))
    l = links.groupBy(c("trace_id").alias("number")).agg(gathered("src", "dst", "resource").alias("links"))
    i = interface.groupBy(c("trace_id").alias("number")).agg(gathered("kind", "resource", "schema").alias("interface"), F.bool_or((c("kind") == "provision") & (c("steps") > 1)).alias("ambiguous"))
    r = r.join(s, "number", "left").join(l, "number", "left").join(i, "number", "left").join(lasting, "number", "left")
    r = r.withColumn("failure", F.when(c("ambiguous"), "ambiguous_provision"))
    blank = F.lit("")
    json = lambda rows: F.coalesce(F.to_json(rows), F.lit("[]"))
    intent = canonical.struct_hash("", task=F.coalesce("task", blank), harness=F.coalesce("harness", blank), harness_version=F.coalesce("harness_version", blank))
    effect = F.sha2(json(F.transform("__lasting", lambda x: F.struct(x["contract_id"].alias("contract_id"), x["writes"].alias("resources")))), 256)
    r = r.withColumns({"intent_hash": intent, "effect_hash": effect, "environment_hash": F.sha2(F.coalesce("environment", blank), 256), "interface_hash": F.sha2(json(c("interface")), 256)})
    r = r.withColumn("family_id", canonical.struct_hash("proc_", tenant_id=c("tenant_id"), intent_hash=c("intent_hash"), effect_signature_hash=c("effect_hash")))
    r = r.withColumn("logical_hash", canonical.struct_hash("", steps=json(c("steps")), edges=json(c("links")), goals=json(c("goals")), environment_hash=c("environment_hash")))
    version = canonical.struct_hash("pv_", tenant_id=c("tenant_id"), procedure_id=c("family_id"), graph_hash=c("logical_hash"), policy_version=F.lit(policy), interface_hash=c("interface_hash"))
    sound = c("abstention").isNull() & c("failure").isNull()
    r = r.withColumn("version_id", F.when(sound, version)).withColumn("family_id", F.when(sound, c("family_id")))
    synthesis = canonical.struct_hash("", graph_hash=c("graph_hash"), version_id=F.coalesce("version_id", blank), code=F.coalesce("abstention", blank), policy=F.lit(policy))
    # the hashes hold the rest; later stages read these of a step
    brief = F.transform("steps", lambda x: F.struct(*[x[k].alias(k) for k in ("tool_name", "contract_id", "side_effect")]))
    r = checkpoint(r.withColumn("synthesis_hash", F.when(c("failure").isNull(), synthesis)).withColumn("steps", brief).drop("links", "interface", "__lasting"))
    failed = nodes.where("NOT succeeded").join(r.where("version_id IS NOT NULL").select(c("number").alias("trace_id")), "trace_id", "left_semi")
    tried = graphs.told(failed.where("NOT opaque")).select("trace_id", "position", "succeeded", F.lit(False).alias("opaque"), c("contract_id").alias("contract"), c("value").alias("inputs"), F.array_sort(resources).alias("resources"))
    failed = rules.failed_branches(tried, failed.where("state IS NOT NULL"))
    keyed = lambda rows: rows.withColumnRenamed("trace_id", "number")
    return {"results": r, "steps": keyed(steps), "edges": keyed(links), "interface": keyed(interface), "negative": keyed(failed.where("NOT unresolved"))}


# --- publish -----------------------------------------------------------------------------------------------------


def folded(results: DataFrame, recalled: DataFrame) -> DataFrame:
    """workflow_id, folded_into: workflows that did no more than the one procedure they had been given: its contracts in
    order, and between them steps that only read. recalled(tenant_id, injection_id, version_id, planned): plans of one
    procedure and its steps' contracts."""
    plans = recalled.where(F.size("planned") > 0).select("tenant_id", "injection_id", F.col("version_id").alias("folded_into"), "planned")
    ran = F.transform("steps", lambda s: F.struct(s["contract_id"].alias("contract"), s["side_effect"].isin("none", "read").alias("read_only")))
    rows = results.where("version_id IS NOT NULL").select("tenant_id", "injection_id", "workflow_id", ran.alias("executed")).join(plans, ["tenant_id", "injection_id"])
    return causal.contained_in_order(rows).where("folds").groupBy("workflow_id").agg(F.min("folded_into").alias("folded_into"))


def stage_rows(told: DataFrame) -> DataFrame:
    """The chain of each workflow: a stage takes what the one before gave; the one that gives nothing ends it and says why."""
    c, alive, before, out = F.col, F.lit(True), F.col("content_hash"), []
    late = c("failure").isin("evidence_mismatch", "awaiting_outcome")
    gives = (F.when(c("failure").isNull() | late, c("archive_hash")), F.when(c("failure").isNull(), c("evaluation_hash")), F.when(c("graph_failure").isNull(), c("graph_hash")), c("synthesis_hash"), c("published"))
    for name, given in zip(records.STAGES, gives):
        code = F.when(given.isNull(), F.coalesce("failure", "graph_failure", "late_failure")).when(F.lit(name == "publish"), c("code"))
        out.append(F.when(alive, F.struct(F.lit(name).alias("stage"), before.alias("input_hash"), given.alias("output_hash"), code.alias("code"))))
        alive, before = alive & given.isNotNull(), given
    return told.select("tenant_id", "workflow_id", F.inline(F.array_compact(F.array(*out))))


def run(catalog: Catalog, jobs: DataFrame, contracts: DataFrame, now: int, policy: str = "default", recalled: DataFrame | None = None) -> DataFrame:
    """A batch of jobs through all stages -> tenant_id, trace_id, outcome_id, workflow_id, disposition, code, version_id.

    disposition: published, duplicate (its manifest is stored), abstained, folded, waiting (no outcome yet) or rejected.
    Versions, their steps, edges, interfaces, documents and negative paths, the manifests and the stages are one commit,
    which fails if another writer has published since the heads were read. A version that is stored, or that several
    workflows of the batch prove, is written once; each has its manifest."""
    c = F.col
    heads = catalog.heads(*TABLES)
    facts = ingest.stored(catalog, "evidence")
    sources = load(jobs, stored(catalog, "traces"), ingest.stored(catalog, "outcomes"))
    sources = checkpoint(evaluate(sources, facts).withColumn("number", F.monotonically_increasing_id()))
    graphs = build(stored(catalog, "events"), sources.where("failure IS NULL"), contracts)
    sources = checkpoint(sources.join(graphs.facts.withColumnRenamed("trace_id", "number"), "number", "left").withColumn("graph_failure", F.when(c("failure").isNull() & c("graph_hash").isNull(), "no_events").otherwise(c("graph_failure"))))
    parts = synthesize(sources.withColumn("failure", F.coalesce("failure", "graph_failure")), graphs, facts, policy)
    r = parts["results"]
    folds = folded(r, recalled) if recalled is not None else r.select("workflow_id", F.lit(None).cast("string").alias("folded_into")).limit(0)
    r = r.join(folds, "workflow_id", "left")
    manifest = canonical.struct_hash(
        "syn_", tenant_id=c("tenant_id"), outcome_id=c("outcome_id"), trace_id=c("trace_id"), version_id=F.coalesce("version_id", F.lit("")), archive_hash=c("archive_hash"),
        code=F.coalesce("abstention", F.lit("")), synthesis_hash=c("synthesis_hash"), policy=F.lit(policy),
    )
    r = r.withColumn("manifest_id", F.when(c("failure").isNull() & c("folded_into").isNull(), manifest))
    before = stored(catalog, "synthesis_manifests", heads["synthesis_manifests"]).select("manifest_id", F.lit(True).alias("__stored"))
    r = checkpoint(r.join(before, "manifest_id", "left"))

    ended = r.select("workflow_id", c("failure").alias("late_failure"), "abstention", "synthesis_hash", c("manifest_id"), c("folded_into"), "version_id", "__stored")
    told = sources.join(ended, "workflow_id", "left").withColumns({"published": F.coalesce("manifest_id", "folded_into"), "code": F.when(c("folded_into").isNotNull(), "folded_into_recalled_procedure").otherwise(c("abstention"))})
    bad = F.coalesce("failure", "graph_failure", "late_failure")
    disposition = (
        F.when(bad == "awaiting_outcome", "waiting").when(bad.isNotNull(), "rejected").when(c("folded_into").isNotNull(), "folded").when(c("__stored"), "duplicate")
        .when(c("abstention").isNotNull(), "abstained").otherwise("published")
    )
    told = checkpoint(told.withColumn("disposition", disposition).withColumn("bad", bad))

    seen = stored(catalog, "stage_artifacts", heads["stage_artifacts"]).select("workflow_id").distinct()
    stages = checkpoint(stage_rows(told).join(seen, "workflow_id", "left_anti"))
    fresh = r.where("manifest_id IS NOT NULL AND __stored IS NULL")
    if not stages.isEmpty() or not fresh.isEmpty():
        catalog.commit(rows_of(catalog, fresh, parts, stages, heads, now, policy), heads)
    out = told.withColumn("version_id", F.coalesce("folded_into", "version_id"))
    return out.select("tenant_id", "trace_id", "outcome_id", "workflow_id", "disposition", F.coalesce("bad", "code").alias("code"), "version_id")


def rows_of(catalog: Catalog, fresh: DataFrame, parts: dict[str, DataFrame], stages: DataFrame, heads: dict[str, int], now: int, policy: str) -> dict[str, DataFrame]:
    """What is written: manifests of all fresh workflows, and the versions that are not stored yet, each as its first
    workflow by id has it."""
    c, at = F.col, F.lit(now).cast("long")
    old = stored(catalog, "procedures", heads["procedures"]).select("version_id")
    first = fresh.where("version_id IS NOT NULL").groupBy("version_id").agg(F.min("workflow_id").alias("workflow_id")).join(old, "version_id", "left_anti")
    new = checkpoint(fresh.drop("version_id").join(first, "workflow_id"))
    ids = new.select("number", "tenant_id", "version_id", "environment_hash")
    of = lambda name: parts[name].join(ids, "number")
    nodes = of("steps").select(c("number").alias("plan_id"), "resources", "effects", "side_effect", S.risk_ordinal(c("risk")).alias("risk"))
    serving = records.serving_metadata(nodes).withColumnRenamed("plan_id", "number")
    tools = F.concat(F.lit("tools "), F.array_join(F.transform("steps", lambda s: s["tool_name"]), " then "), F.lit(" goals "), F.array_join("goals", " "))
    docs = new.join(serving, "number").withColumns({
        "task": F.when(F.trim(F.coalesce("task", F.lit(""))) != "", c("task")).otherwise(tools), "contracts": F.transform("steps", lambda s: s["contract_id"]), "risk": c("risk").cast("int"),
        "verification_strength": c("strength").cast("long"), "lifecycle": F.lit("candidate"), "validated_at": at,
    })
    docs = docs.withColumn("content_hash", canonical.struct_hash("", version_id=c("version_id"), task=c("task"), contracts=F.to_json("contracts"), resources=F.to_json("resources"), effects=F.to_json("effects"), risk=c("risk")))
    path = canonical.struct_hash("neg_", failure_predicate_id=c("predicate"), environment_hash=c("environment_hash"), tool_hash=c("tool_hash"), resource_hash=c("resource_hash"))
    avoided = rules.negative_path_records(of("negative").select("tenant_id", "version_id", path.alias("path_id")))
    avoided = avoided.join(new.select("tenant_id", "version_id"), "version_id")
    step = canonical.struct_hash("step_", version_id=c("version_id"), ordinal=c("ordinal"), tool_name=c("tool_name"), contract_id=c("contract_id"), uncertain_necessity=c("uncertain_necessity"))
    edge = canonical.struct_hash("edge_", version_id=c("version_id"), src=c("src"), dst=c("dst"), resource=c("resource"))
    status = F.when(c("abstention").isNull(), "synthesized").otherwise("abstained")
    out = {
        "procedures": new.withColumns({"graph_hash": c("logical_hash"), "policy": F.lit(policy), "content_hash": F.substring_index("version_id", "_", -1), "created_at": at}),
        "procedure_steps": of("steps").withColumn("step_id", step), "procedure_edges": of("edges").withColumn("edge_id", edge), "procedure_interfaces": of("interface"),
        "procedure_documents": docs, "negative_paths": avoided, "synthesis_manifests": fresh.withColumns({"status": status, "code": c("abstention"), "created_at": at}), "stage_artifacts": stages,
    }
    return {t: rows.select(*columns(TABLES[t])) for t, rows in out.items()}


def tampered(catalog: Catalog) -> DataFrame:
    """tenant_id, version_id, reason: stored procedures that no longer hold: an edge to a step that is not there or that runs
    backwards, ordinals that are not 0 .. n - 1, a document without its procedure, a step whose id its content does not give."""
    c, both = F.col, ["tenant_id", "version_id"]
    steps, edges = stored(catalog, "procedure_steps"), stored(catalog, "procedure_edges")
    step = canonical.struct_hash("step_", version_id=c("version_id"), ordinal=c("ordinal"), tool_name=c("tool_name"), contract_id=c("contract_id"), uncertain_necessity=c("uncertain_necessity"))
    forged = steps.where(step != c("step_id")).select(*both, F.lit("step_hash_mismatch").alias("reason"))
    count = steps.groupBy(*both).agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("kinds"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most"))
    loose = count.where("least <> 0 OR most <> n - 1 OR kinds <> n").select(*both, F.lit("ordinals_not_gapless").alias("reason"))
    ends = steps.select(*both, "ordinal")
    sound = edges.where("src < dst").join(ends.withColumnRenamed("ordinal", "src"), [*both, "src"], "left_semi").join(ends.withColumnRenamed("ordinal", "dst"), [*both, "dst"], "left_semi")
    broken = edges.join(sound.select("edge_id"), "edge_id", "left_anti").select(*both, F.lit("broken_edge").alias("reason"))
    bare = stored(catalog, "procedure_documents").join(stored(catalog, "procedures"), both, "left_anti").select(*both, F.lit("document_without_procedure").alias("reason"))
    return forged.unionByName(loose).unionByName(broken).unionByName(bare).distinct()
