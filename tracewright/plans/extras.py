"""Queries over manifests, judge answers, snapshots and stored graphs. Registered in the catalogue's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import causal, channels, evidence, manifests, rules, tables
from tracewright.operators import records as records_
from tracewright.plans import adapters as A
from tracewright.plans import catalog, composition, ingest, learning, records
from tracewright.plans.catalog import QUERIES, SQL, query, text
from tracewright.sources.tables import Catalog, checkpoint, read, shared_dir

__all__ = ["QUERIES", "SQL", "records"]


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(round(value / 100 * 1000000) AS BIGINT) END AS score_micros, event_id % 7 <> 0 AND value / 100 <= 4 AND event_id % 5 <> 0 AS valid FROM events")
def judge_response_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with values as scores; every fifth has probabilities that do not sum to 1, every seventh is no JSON."""
    c = F.col
    p = F.when(c("event_id") % 5 == 0, "[0.5, 0.4]").otherwise("[0.5, 0.25, 0.25]")
    body = F.concat(F.lit('{"score": '), (c("value") / 100).cast("string"), F.lit(', "confidence": 0.5, "probabilities": '), p, F.lit("}"))
    rows = read(spark, sf, "events").select("event_id", F.when(c("event_id") % 7 == 0, "sorry").otherwise(body).alias("payload"))
    return manifests.decode_answers(rows).select("event_id", "score_micros", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("SELECT r_name AS channel, CASE WHEN r_regionkey = 4 THEN 'not_in_snapshot' WHEN r_regionkey % 2 = 1 THEN 'index_mismatch' ELSE 'bound' END AS binding FROM region")
def channel_binding(spark: SparkSession, sf: str) -> DataFrame:
    r, c = read(spark, sf, "region"), F.col
    snapshot = r.where("r_regionkey <> 4").select(c("r_name").alias("channel"), F.when(c("r_regionkey") % 2 == 1, 99).otherwise(c("r_regionkey")).alias("index_id"))
    return manifests.bound_channels(r.select(c("r_name").alias("channel"), c("r_regionkey").alias("index_id")), snapshot)


@query("SELECT c_custkey AS query_id, 'required_channel_unavailable:' || CASE WHEN c_custkey % 6 = 0 THEN 'exact' ELSE 'lexical' END AS failure FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def required_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose lexical channel (even or third ids) or exact channel (sixth) did not answer; a missing vector
    channel is no failure."""
    c = F.col
    q = read(spark, sf, "customer").select(c("c_custkey").alias("query_id"))
    one = lambda name, bad: q.select("query_id", F.lit(name).alias("channel"), F.when(bad, "deadline_exceeded").alias("code"))
    runs = one("lexical", (c("query_id") % 2 == 0) | (c("query_id") % 3 == 0)).unionByName(one("exact", c("query_id") % 6 == 0)).unionByName(one("vector", F.lit(True)))
    return channels.degraded(runs, ["exact", "lexical", "facet", "graph"])


@query("SELECT l_returnflag AS query_id, count(*) AS rows, count(DISTINCT l_suppkey) AS versions FROM lineitem GROUP BY 1 HAVING count(*) > 128 * 64 AND count(DISTINCT l_suppkey) < 128")
def revision_scan_bound(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.window_exhausted(read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("query_id"), F.col("l_suppkey").alias("version_id")), 128)


@query(f"WITH {catalog.STEPS} SELECT DISTINCT e.trace_id AS version_id, b.ordinal AS dependent, a.ordinal AS prerequisite FROM edges e JOIN steps a ON a.trace_id = e.trace_id AND a.position = src JOIN steps b ON b.trace_id = e.trace_id AND b.position = dst")
def procedure_graph_rows(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.depends_on(catalog.causal_edges(spark, sf), catalog.sliced(spark, sf))


@query("SELECT l_orderkey AS trace_id, l_partkey % 5 AS resource_id, count(DISTINCT l_returnflag || '|' || l_linestatus || '|' || (l_suppkey % 2)) AS descriptions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag || '|' || l_linestatus || '|' || (l_suppkey % 2)) > 1")
def step_metadata_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    r = read(spark, sf, "lineitem").select(c("l_orderkey").alias("trace_id"), (c("l_partkey") % 5).alias("resource_id"), c("l_returnflag").alias("name"), c("l_linestatus").alias("kind"), (c("l_suppkey") % 2).alias("schema"))
    return manifests.conflicting_metadata(r)


@query(f"WITH {A.FACTS}, s AS (SELECT observed_at // 21600 * 21600 AS since, value, verdict FROM facts) SELECT since, count(*) AS n, round(count(*) FILTER (WHERE verdict = 'failed') / count(*), 9) AS bad_ratio, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.95) > 470 OR count(*) FILTER (WHERE verdict = 'failed') / count(*) > 0.25 AS firing FROM s GROUP BY since")
def alert_ratios(spark: SparkSession, sf: str) -> DataFrame:
    f = A.facts(spark, sf).select(F.col("observed_at").alias("at"), "value", (F.col("verdict") == "failed").alias("bad"))
    return manifests.alert_windows(f, 21600, "value", "bad", 470, 0.25)


@query(f"WITH {A.FACTS}, g AS (SELECT DISTINCT outcome_id, predicate FROM facts WHERE verdict = 'satisfied' AND class_rank <= 2) SELECT outcome_id, string_agg(predicate, ',' ORDER BY predicate) AS goals FROM g GROUP BY 1")
def goal_canonicalization(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.goals(A.facts(spark, sf).withColumn("class_rank", evidence.class_rank(F.col("class"))))
    return found.select("outcome_id", text("goals").alias("goals"))


@query(f"WITH {A.QUEUE} SELECT tenant_id, count(*) AS generation, max(job_id) AS latest FROM queue WHERE state = 'completed' GROUP BY tenant_id")
def checkpoint_generations(spark: SparkSession, sf: str) -> DataFrame:
    done = A.queue(spark, sf).where("state = 'completed'").select(F.col("tenant_id").alias("scope"), F.col("job_id").alias("batch"))
    return rules.checkpoints(done).withColumnRenamed("scope", "tenant_id")


@query(f"WITH {A.QUEUE} SELECT count(*) AS expired, count(*) FILTER (WHERE state = 'leased') AS leases FROM queue WHERE lease_expires_at <= {A.NOW}")
def lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return A.queue(spark, sf).where(F.col("lease_expires_at") <= A.NOW).agg(F.count("*").alias("expired"), F.count_if(F.col("state") == "leased").alias("leases"))


@query(f"WITH {A.EDGES} SELECT trace_id, position, resource, value FROM accesses WHERE NOT succeeded AND EXISTS (SELECT 1 FROM edges e WHERE e.trace_id = accesses.trace_id AND e.dst = accesses.position)")
def failed_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Failed steps that read what an earlier step wrote."""
    a = A.accesses(spark, sf)
    fed = causal.flow_edges(a).select("trace_id", F.col("dst").alias("position"))
    return a.where("NOT succeeded").join(fed, ["trace_id", "position"], "left_semi").select("trace_id", "position", "resource", "value")


@query("SELECT p_partkey, list_sort(['b' || (p_size % 3), 'a' || (p_size % 2)]) = ['b' || (p_size % 3), 'a' || (p_size % 2)] AS canonical FROM part")
def sorted_set_check(spark: SparkSession, sf: str) -> DataFrame:
    from tracewright.functions import scalars as S

    c = F.col
    values = F.array(F.concat(F.lit("b"), c("p_size") % 3), F.concat(F.lit("a"), c("p_size") % 2))
    return read(spark, sf, "part").select("p_partkey", S.is_normalized_set(values).alias("canonical"))


@query(f"WITH {A.QUEUE}, r AS (SELECT kind, tenant_id, count(*) AS n, max(available_at) AS latest FROM queue GROUP BY 1, 2) SELECT kind, tenant_id, n, latest FROM r WHERE n > 5")
def multi_table_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and their batches, committed to a catalog as one and read back at the heads of the commit."""
    store = Catalog(spark, f"{shared_dir(spark)}/multi-table-commit-{uuid.uuid4().hex}")
    queue = A.queue(spark, sf).select("job_id", "kind", "tenant_id", "available_at")
    heads = store.commit({"jobs": queue, "batches": queue.groupBy("kind", "tenant_id").agg(F.count("*").alias("n")).where("n > 5")})
    batches = store.read("batches", as_of=heads["batches"]).select("kind", "tenant_id")
    return store.read("jobs", as_of=heads["jobs"]).join(batches, ["kind", "tenant_id"]).groupBy("kind", "tenant_id").agg(F.count("*").alias("n"), F.max("available_at").alias("latest"))


@query("SELECT r_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY r_name")
def foreign_key_existence(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order, by region: semi and anti joins along the keys."""
    c = tables.orphans(read(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", read(spark, sf, "orders").where("o_orderstatus = 'P'"), "o_custkey")
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"))


@query(
    """WITH k AS (SELECT p_brand AS tool_id, p_size AS version, max(md5(p_name)) AS h FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2),
b AS (SELECT p_brand AS tool_id, p_size AS version, min(md5(p_name)) AS content_hash FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT CASE WHEN tool_id IN ('Brand#1', 'Brand#2') THEN 'alias_conflict' WHEN h IS NULL THEN 'new' WHEN h = content_hash THEN 'known' ELSE 'version_conflict' END AS status, count(*) AS n FROM b LEFT JOIN k USING (tool_id, version) GROUP BY 1"""
)
def contract_registration(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as tools, sizes as versions; two brands claim one alias."""
    c, p = F.col, read(spark, sf, "part")
    aliases = F.when(c("tool_id").isin("Brand#1", "Brand#2"), F.array(F.lit("shared"))).otherwise(F.array().cast("array<string>"))
    one = lambda rows, pick: rows.groupBy(c("p_brand").alias("tool_id"), c("p_size").alias("version")).agg(pick(F.md5(c("p_name").cast("binary"))).alias("content_hash")).withColumn("aliases", aliases)
    out = manifests.register_contracts(one(p.where("p_partkey % 2 = 0"), F.max), one(p.where("p_partkey % 3 = 0"), F.min))
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {catalog.LIFE} SELECT '{{"next_state":"' || r[1] || '","prior_state":"' || prior || '","version_id":' || version_id || '}}' AS line FROM t WHERE r[1] <> prior AND version_id % 3 = 1""")
def lifecycle_batch_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON line per decision of one organization's scopes."""
    from tracewright.functions import canonical

    c = F.col
    scope = F.concat(F.when(c("version_id") % 3 == 1, "acme").otherwise("other"), F.lit("__u"), c("version_id"))
    rows = catalog.decisions(spark, sf).where("next_state <> prior_state").where(records_.organization(scope) == "acme")
    return rows.select(canonical.struct_json(version_id=c("version_id"), prior_state=c("prior_state"), next_state=c("next_state")).alias("line"))


# --- the learning path -------------------------------------------------------------------------------------------

LEARNED = f"""WITH RECURSIVE {A.FACTS}, calls AS (
  SELECT user_id, evidence_id AS position, k, 'r' || (k % 12) AS resource, event_type AS tool, evidence_id % 331 = 0 AS opaque, event_type <> 'error' AS succeeded, event_type <> 'signup' AS reads,
    event_type IN ('purchase', 'click') OR event_type = 'error' AND value > 480 AS writes, event_type IN ('purchase', 'signup') AS lasting
  FROM facts
), linked AS (
  SELECT *, last_value(CASE WHEN writes THEN position END IGNORE NULLS) OVER (PARTITION BY user_id, resource ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM calls
), edges AS (SELECT user_id, writer AS src, position AS dst, resource FROM linked WHERE reads AND writer IS NOT NULL
), reach AS (
  SELECT user_id, position FROM calls WHERE succeeded AND (lasting OR tool = 'view' AND user_id % 3 = 0) UNION SELECT e.user_id, e.src FROM reach r JOIN edges e ON e.user_id = r.user_id AND e.dst = r.position
), unmet AS (SELECT DISTINCT user_id FROM reach JOIN calls USING (user_id, position) WHERE NOT succeeded
), steps AS (SELECT c.*, r.position IS NULL AS uncertain FROM calls c LEFT JOIN reach r USING (user_id, position) WHERE succeeded
), inner_edges AS (SELECT e.* FROM edges e JOIN steps a ON a.user_id = e.user_id AND a.position = src JOIN steps b ON b.user_id = e.user_id AND b.position = dst
), asked AS (SELECT DISTINCT user_id, resource FROM steps s WHERE reads AND NOT EXISTS (FROM inner_edges e WHERE e.user_id = s.user_id AND e.dst = s.position)
), given AS (SELECT user_id, resource, count(*) AS n FROM steps s WHERE writes AND NOT EXISTS (FROM inner_edges e WHERE e.user_id = s.user_id AND e.src = s.position) GROUP BY 1, 2
), users AS (
  SELECT user_id, bool_or(opaque) AS opaque, bool_or(NOT succeeded AND NOT opaque) AND user_id % 29 = 0 AS silent, count(DISTINCT CASE WHEN NOT succeeded THEN k END) AS failed, bool_or(succeeded AND tool = 'purchase') AS tested, bool_or(succeeded AND tool = 'view') AS watched FROM calls GROUP BY user_id
), told AS (
  SELECT user_id, failed, CASE WHEN silent THEN 'failed_step_without_result' WHEN user_id % 5 = 0 THEN 'outcome_not_verified' WHEN opaque THEN 'opaque_tool'
    WHEN user_id % 7 = 0 OR NOT tested OR user_id % 3 = 0 AND NOT watched THEN 'uncovered_goal' WHEN user_id IN (FROM unmet) THEN 'failed_prerequisite' WHEN user_id IN (SELECT user_id FROM given WHERE n > 1) THEN 'ambiguous_provision' END AS code
  FROM users
)
SELECT user_id, CASE WHEN code IS NULL THEN 'published' WHEN code IN ('failed_step_without_result', 'ambiguous_provision') THEN 'rejected' ELSE 'abstained' END AS disposition, code,
  CASE WHEN code IS NULL THEN (SELECT count(*) FROM steps s WHERE s.user_id = t.user_id) END AS steps, CASE WHEN code IS NULL THEN (SELECT count(*) FROM steps s WHERE s.user_id = t.user_id AND uncertain) END AS uncertain,
  CASE WHEN code IS NULL THEN (SELECT count(*) FROM inner_edges e WHERE e.user_id = t.user_id) END AS edges,
  CASE WHEN code IS NULL THEN coalesce((SELECT string_agg(resource, ',' ORDER BY resource) FROM asked a WHERE a.user_id = t.user_id), '') END AS requirements,
  CASE WHEN code IS NULL THEN coalesce((SELECT string_agg(resource, ',' ORDER BY resource) FROM given g WHERE g.user_id = t.user_id), '') END AS provisions,
  CASE WHEN code IS NULL THEN failed END AS avoided
FROM told t"""


@query(LEARNED)
def learned_procedures(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a trace with one outcome: stored, learned from, and read back from the procedures' tables."""
    c, f = F.col, A.facts(spark, sf)
    user = lambda prefix: F.concat(F.lit(prefix), c("user_id"))
    tenant, failed = F.lit("acme").alias("tenant_id"), c("event_type") == "error"
    use = F.struct(F.concat(F.lit("r"), c("k") % 12).alias("resource"), F.lit("s").alias("schema"), (c("event_type") != "signup").alias("reads"), (c("event_type").isin("purchase", "click") | (failed & (c("value") > 480))).alias("writes"))
    events = f.select(
        tenant, user("tr").alias("trace_id"), c("evidence_id").cast("int").alias("position"), c("event_type").alias("tool_name"), F.when(c("evidence_id") % 331 == 0, "9").otherwise("1").alias("tool_version"), (~failed).alias("succeeded"),
        c("k").cast("string").alias("value"), F.when(~failed, "done").when(c("user_id") % 29 != 0, "failed").alias("state"), failed.cast("int").alias("exit_code"), F.array(use).alias("accesses"),
    )
    users = checkpoint(f.select("user_id").distinct())
    traces = users.select(tenant, user("tr").alias("trace_id"), user("user ").alias("task"), F.lit("h").alias("harness"), F.lit("1").alias("harness_version"), F.lit("env").alias("environment"), F.sha2(user("tr"), 256).alias("content_hash"))
    none = F.lit(None).cast("string")
    outcomes = users.select(tenant, user("k").alias("idempotency_key"), user("o").alias("outcome_id"), user("tr").alias("trace_id"), none.alias("injection_id"), none.alias("supersedes_id"))
    goal = lambda name, verifier=none, verdict=F.lit("satisfied"): users.select("user_id", user("o").alias("outcome_id"), F.lit(name).alias("predicate"), F.lit(evidence.CLASSES[0]).alias("class"), verdict.alias("verdict"), F.lit(1000).cast("long").alias("observed_at"), verifier.alias("verifier"))
    goals = goal("tested", verdict=F.when(c("user_id") % 5 == 0, "failed").otherwise("satisfied")).unionByName(goal("watched", F.lit("ci")).where("user_id % 3 = 0")).unionByName(goal("proven by nothing").where("user_id % 7 = 0"))
    kinds = [("click", "none", [], []), ("error", "none", [], []), ("purchase", "write", ["tested"], []), ("signup", "external", [], []), ("view", "read", [], ["ci"])]
    contracts = spark.createDataFrame([("acme", f"c_{n}", n, "1", "1", "2", effect, "low", [], p, m) for n, effect, p, m in kinds], "tenant_id string, contract_id string, name string, version string, minimum string, maximum string, side_effect string, risk string, effects array<string>, predicates array<string>, methods array<string>")
    store = Catalog(spark, f"{shared_dir(spark)}/learned-{uuid.uuid4().hex}")
    store.commit({"traces": traces, "events": events})
    selections = spark.createDataFrame([], "injection_id string, version_id string, created_at long, expires_at long, complete boolean")
    ingest.commit_outcomes(store, outcomes, goals.drop("user_id"), selections, 1000, traces)
    got = learning.run(store, learning.pending(store).where("outcome_id IS NOT NULL"), contracts, 1000)
    of = lambda t: learning.stored(store, t)
    steps = of("procedure_steps").groupBy("version_id").agg(F.count("*").alias("steps"), F.count_if("uncertain_necessity").alias("uncertain"))
    edges = of("procedure_edges").groupBy("version_id").agg(F.count("*").alias("edges"))
    named = lambda kind: text(F.array_sort(F.collect_list(F.when(c("kind") == kind, c("resource")))))
    ends = of("procedure_interfaces").groupBy("version_id").agg(named("requirement").alias("requirements"), named("provision").alias("provisions"))
    avoided = of("negative_paths").groupBy("version_id").agg(F.count("*").alias("avoided"))
    for part in (steps, edges, ends, avoided):
        got = got.join(part, "version_id", "left")
    known = lambda name, value: F.when(c("version_id").isNotNull(), F.coalesce(name, F.lit(value))).alias(name)
    return got.select(F.substring("trace_id", 3, 20).cast("long").alias("user_id"), "disposition", "code", "steps", "uncertain", known("edges", 0), known("requirements", ""), known("provisions", ""), known("avoided", 0))


@query("""WITH c AS (SELECT c_custkey, s_suppkey, s_suppkey % 5 = c_custkey % 5 AS covered, s_suppkey % 4 = 0 AS asks FROM customer JOIN supplier ON s_nationkey = c_nationkey),
b AS (SELECT *, covered AND NOT asks AS complete, row_number() OVER (PARTITION BY c_custkey ORDER BY NOT covered OR asks, covered DESC, s_suppkey DESC) AS n FROM c)
SELECT c_custkey AS query_id, 's' || s_suppkey AS version_id, CASE WHEN NOT complete THEN 'partial' WHEN c_custkey % 2 = 0 THEN 'exact' ELSE 'known_shape' END AS novelty, CAST(NOT covered AS BIGINT) + CAST(asks AS BIGINT) AS gaps,
  CASE WHEN complete THEN 0 END AS level, CASE WHEN c_custkey % 10 = 0 THEN 'content_hash_mismatch' ELSE 'held' END AS reason FROM b WHERE n = 1""")
def selection_store(spark: SparkSession, sf: str) -> DataFrame:
    """Customers ask their nation's suppliers for a goal; the plans are stored, every tenth is forged, and all are read
    back. Nothing is offered to those that ask for a resource, so each plan is the best procedure by itself."""
    c = F.col
    name = F.concat(F.lit("s"), "s_suppkey").alias("version_id")
    s, q = read(spark, sf, "supplier"), read(spark, sf, "customer")
    goal = lambda key: F.array(F.concat(F.lit("g"), c(key) % 5))
    versions = s.select(name, goal("s_suppkey").alias("goals"), (c("s_suppkey") * 1000 + 100_000).cast("long").alias("evidence_strength"), F.lit(True).alias("observed"), F.lit(1).cast("long").alias("risk_cost"), F.lit(2).cast("long").alias("tool_cost"), F.lit(False).alias("serial"))
    interfaces = s.where("s_suppkey % 4 = 0").select(name, F.lit("requirement").alias("kind"), F.lit("x").alias("resource"), F.lit("s").alias("schema"))
    ranked = s.select(c("s_nationkey").alias("pool_id"), name)
    wanted = q.select(c("c_custkey").cast("long").alias("query_id"), c("c_nationkey").alias("pool_id"), goal("c_custkey").alias("goals"), F.array().cast("array<string>").alias("satisfied"), (c("c_custkey") % 2 == 0).alias("exact"))
    parts = composition.composed(ranked, wanted, versions, interfaces, composition.graph(interfaces))
    store = Catalog(spark, f"{shared_dir(spark)}/selections-{uuid.uuid4().hex}")
    ids = composition.record(store, "acme", parts, 1000)
    forged = ids.where("query_id % 10 = 0").select(F.lit("acme").alias("tenant_id"), "injection_id", F.lit("a").alias("source"), F.lit("b").alias("target"), F.array(F.lit("req_x")).alias("requirement_ids"))
    store.append("selection_edges", forged)
    told = composition.hydrate(store, "acme", ids, 2000)
    return told.select("query_id", F.inline("steps"), "novelty", F.size("gaps").cast("long").alias("gaps"), "reason").select("query_id", "version_id", "novelty", "gaps", "level", F.coalesce("reason", F.lit("held")).alias("reason"))
