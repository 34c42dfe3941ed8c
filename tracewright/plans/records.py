"""Queries over records: requests, runs, procedures, workflow, judgments. Registered in the catalogue's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.functions import scalars as S
from tracewright.operators import causal, records, rules
from tracewright.plans import adapters as A
from tracewright.plans.catalog import QUERIES, SQL, query, text
from tracewright.sources.tables import Catalog, read, shared_dir

#: The table of secrets as a condition of DuckDB's SQL.
HOLDS = "(" + " OR ".join("regexp_matches(text, '" + pattern.replace("'", "''") + "')" for _, pattern, _ in S.SECRETS) + ")"

# --- requests ----------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT 'alias' || r_regionkey AS alias, r_name AS name FROM region) SELECT n_nationkey AS id, coalesce(a.name, 'alias' || (n_nationkey % 9)) AS name FROM nation LEFT JOIN a ON a.alias = 'alias' || (n_nationkey % 9)")
def alias_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("alias"), F.col("n_nationkey") % 9).alias("name"))
    aliases = read(spark, sf, "region").select(F.concat(F.lit("alias"), "r_regionkey").alias("alias"), F.col("r_name").alias("name"))
    return records.rewrite_aliases(names, aliases)


@query(
    f"""WITH {A.REQUESTS} SELECT query_id, sha256('{{"task":' || to_json(trim(task)) || '}}') AS intent_hash, sha256('{{"environment":"' || environment || '"}}') AS environment_hash,
  sha256('{{"environment":"' || environment || '","harness":"' || harness || '","max_candidates":20,"task":' || to_json(trim(task)) || '}}') AS query_hash FROM requests"""
)
def query_build(spark: SparkSession, sf: str) -> DataFrame:
    return records.build_queries(A.requests(spark, sf).withColumn("max_candidates", F.lit(20))).select("query_id", "intent_hash", "environment_hash", "query_hash")


@query(f"""WITH {A.REQUESTS} SELECT query_id, sha256('{{"query_hash":"' || sha256(task) || '","recall":' || (query_id % 2 = 0) || ',"regions":["eu","' || harness || '"],"tenant_id":"acme"}}') AS context_hash FROM requests WHERE harness > 'eu' UNION ALL SELECT query_id, sha256('{{"query_hash":"' || sha256(task) || '","recall":' || (query_id % 2 = 0) || ',"regions":["' || harness || '","eu"],"tenant_id":"acme"}}') FROM requests WHERE harness < 'eu'""")
def request_context_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    h = records.context_hash(F.lit("acme"), F.sha2("task", 256), c("query_id") % 2 == 0, F.array(F.lit("eu"), c("harness"), F.lit(" eu ")))
    return A.requests(spark, sf).select("query_id", h.alias("context_hash"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'acme' WHEN c_custkey % 5 = 1 THEN 'acme__h_' || substr(sha256('subject' || chr(0) || c_name), 1, 40) ELSE 'acme__c-' || c_custkey END AS scope FROM customer")
def subject_scope(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    subject = F.when(c("c_custkey") % 5 == 0, "").when(c("c_custkey") % 5 == 1, c("c_name")).otherwise(F.concat(F.lit("c-"), "c_custkey"))
    return read(spark, sf, "customer").select("c_custkey", records.scoped_tenant(F.lit("acme"), subject, "__", "subject").alias("scope"))


@query(
    """WITH v AS (SELECT doc_id, unnest(list_filter([CASE WHEN strlen(text) > 8192 THEN 'value_too_large' END, CASE WHEN text = '' THEN 'task_required' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language_allowed' END,
  CASE WHEN n_chars <> length(text) THEN 'size_matches' END], lambda x: x IS NOT NULL)) AS rule FROM documents) SELECT rule, count(*) AS n FROM v GROUP BY rule"""
)
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rules = {"value_too_large": F.octet_length("text") <= 8192, "task_required": c("text") != "", "language_allowed": c("lang").isin("en", "fr"), "size_matches": c("n_chars") == F.length("text")}
    return records.violations(read(spark, sf, "documents"), "doc_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS rejected FROM documents WHERE {HOLDS}")
def credential_detector(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(S.holds_credentials(F.col("text"))).agg(F.count("*").alias("rejected"))


@query(f"WITH {A.QUEUE} SELECT CASE WHEN job_id % 3 = 0 THEN 'new' WHEN job_id % 7 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome, count(*) AS n FROM queue GROUP BY 1")
def replay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    q = A.queue(spark, sf).select(c("job_id").alias("run_id"), F.sha2("kind", 256).alias("query_hash"), F.sha2("state", 256).alias("context_hash"))
    runs = q.where("run_id % 3 <> 0").withColumn("query_hash", F.when(c("run_id") % 7 == 0, "other").otherwise(c("query_hash")))
    return records.replay(q, runs).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name AS opened, true AS sealed, true AS bound FROM customer")
def envelope_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed under one tenant, opened again; the envelope differs from the text, and by tenant."""
    key, nonce = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2)), F.unhex(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 24))
    rows = read(spark, sf, "customer").withColumn("e", records.seal(F.col("c_name"), key, nonce, F.lit("acme"))).withColumn("o", records.seal(F.col("c_name"), key, nonce, F.lit("other")))
    return rows.select("c_custkey", records.unseal(F.col("e"), key, F.lit("acme")).alias("opened"), (F.col("e").startswith("enc.v1.") & ~F.col("e").contains("Customer")).alias("sealed"), (F.col("e") != F.col("o")).alias("bound"))


# --- documents and runs ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS run_id, l_returnflag AS channel, l_partkey AS version_id, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS rank FROM lineitem")
def run_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A stored run's nested hits as rows, ranked within their channel in stored order."""
    c = F.col
    one = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    runs = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("run_id")).agg(F.transform(one, lambda x: F.struct(x["l_returnflag"].alias("channel"), x["l_partkey"].alias("version_id"))).alias("hits"))
    return records.explode_run(runs)


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def run_validation(spark: SparkSession, sf: str) -> DataFrame:
    return records.invalid_ranks(read(spark, sf, "lineitem").withColumn("rank", F.col("l_linenumber")), ["l_orderkey", "l_returnflag"])


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k, CASE WHEN event_id % 3 = 1 THEN event_type END AS kind FROM events")
def legacy_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Version 1 has no kind, version 2 has; of unknown versions nothing is read."""
    c = F.col
    v2 = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": "'), "event_type", F.lit('"}'))
    rows = read(spark, sf, "events").select("event_id", F.concat(F.lit("v"), c("event_id") % 3 + 1).alias("schema_version"), F.when(c("event_id") % 3 == 1, v2).otherwise(c("props")).alias("payload"))
    out = records.decode_versions(rows, {"v1": "k bigint", "v2": "k bigint, kind string"})
    return out.select("event_id", "body.k", "body.kind")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 50 = 7")
def anti_tamper(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth stored hash is spoiled; recomputing finds exactly those."""
    h = canonical.struct_hash(name=F.col("c_name"), segment=F.col("c_mktsegment"))
    rows = read(spark, sf, "customer").withColumn("stored", F.when(F.col("c_custkey") % 50 == 7, "spoiled").otherwise(h))
    return records.tampered(rows, "c_custkey", "stored", h)


@query("""SELECT p_partkey AS version_id, 2 AS epoch, CASE WHEN p_size > 25 THEN 'active' ELSE 'trial' END AS lifecycle, sha256('{"epoch":2,"lifecycle":"' || CASE WHEN p_size > 25 THEN 'active' ELSE 'trial' END || '","version_id":' || p_partkey || '}') AS content_hash FROM part WHERE p_retailprice > 950""")
def document_revision(spark: SparkSession, sf: str) -> DataFrame:
    p, c = read(spark, sf, "part"), F.col
    docs = p.select(c("p_partkey").alias("version_id"), F.lit(1).cast("long").alias("epoch"), F.lit("candidate").alias("lifecycle"))
    changes = p.where("p_retailprice > 950").select(c("p_partkey").alias("version_id"), F.when(c("p_size") > 25, "active").otherwise("trial").alias("lifecycle"))
    return records.revise(docs, changes, ["lifecycle"]).select("version_id", "epoch", "lifecycle", "content_hash")


@query("""WITH k AS (SELECT 'acme' AS tenant, r_regionkey AS contract, 'org:' || r_name AS effect FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 'acme__u1', r_regionkey, 'own:' || r_name FROM region WHERE r_regionkey < 2)
SELECT n_nationkey, coalesce(o.effect, g.effect, '') AS side_effect FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'acme__u1' ELSE 'acme__u2' END AS t FROM nation) LEFT JOIN k o ON o.tenant = t AND o.contract = n_regionkey LEFT JOIN k g ON g.tenant = 'acme' AND g.contract = n_regionkey""")
def tenant_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    r, c = read(spark, sf, "region"), F.col
    one = lambda rows, tenant, mark: rows.select(F.lit(tenant).alias("tenant_id"), c("r_regionkey").alias("contract"), F.concat(F.lit(mark), "r_name").alias("side_effect"), F.lit("low").alias("risk"))
    contracts = one(r.where("r_regionkey <> 4"), "acme", "org:").unionByName(one(r.where("r_regionkey < 2"), "acme__u1", "own:"))
    steps = read(spark, sf, "nation").select("n_nationkey", c("n_regionkey").alias("contract"), F.when(c("n_nationkey") % 2 == 0, "acme__u1").otherwise("acme__u2").alias("tenant_id"))
    return records.enrich_steps(steps, contracts).select("n_nationkey", "side_effect")


@query("SELECT DISTINCT l_suppkey % 7 AS tenant_id, l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7")
def endpoint_enforcement(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-part edges of a supplier's tenant: both ends must be of that tenant."""
    c = F.col
    li = read(spark, sf, "lineitem")
    edges = li.select((c("l_suppkey") % 7).alias("tenant_id"), c("l_suppkey").alias("src"), c("l_partkey").alias("dst")).distinct()
    ends = li.select(c("l_suppkey").alias("id")).unionByName(read(spark, sf, "part").select(c("p_partkey").alias("id"))).distinct()
    return records.foreign_edges(edges, ends.select((c("id") % 7).alias("tenant_id"), "id"))


# --- procedures --------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT conv_id, string_agg('"' || role || '"', ',' ORDER BY turn, role, text) AS steps FROM conversations GROUP BY conv_id),
f AS (SELECT *, 'proc_' || sha256('{"effect_signature_hash":"e' || (conv_id % 3) || '","intent_hash":"i' || (conv_id % 5) || '","tenant_id":"acme"}') AS family_id FROM s)
SELECT conv_id, family_id, 'pv_' || sha256('{"family_id":"' || family_id || '","policy":"default","steps":[' || steps || ']}') AS version_id FROM f"""
)
def procedure_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["role"])
    p = read(spark, sf, "conversations").groupBy("conv_id").agg(roles.alias("steps"))
    p = p.select("conv_id", "steps", F.lit("acme").alias("tenant_id"), F.concat(F.lit("i"), c("conv_id") % 5).alias("intent"), F.concat(F.lit("e"), c("conv_id") % 3).alias("effect"), F.lit("default").alias("policy"))
    return records.procedure_ids(p).select("conv_id", "family_id", "version_id")


@query(f"""WITH {A.ACCESSES}, p AS (SELECT trace_id, position, 'tool_failure:' || resource || ':' || sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS predicate FROM accesses WHERE NOT succeeded)
SELECT trace_id, position, predicate, 'neg_' || sha256('{{"environment_hash":"' || sha256('prod') || '","failure_predicate_id":"' || predicate || '","position":' || position || '}}') AS path_id FROM p""")
def negative_path_ids(spark: SparkSession, sf: str) -> DataFrame:
    failed = A.accesses(spark, sf).where("NOT succeeded").select("trace_id", "position", F.col("resource").alias("contract"), F.round(F.col("value") * 100).cast("long").cast("string").alias("failure"), F.lit("prod").alias("environment"))
    return records.negative_paths(failed)


@query(f"WITH {A.FACTS} SELECT outcome_id, CAST(coalesce(max(6 - class_rank) FILTER (WHERE verdict = 'satisfied'), 0) AS BIGINT) AS strength FROM facts GROUP BY outcome_id")
def verification_strength(spark: SparkSession, sf: str) -> DataFrame:
    return records.verification_strength(A.facts(spark, sf))


@query("SELECT l_orderkey AS plan_id, string_agg(DISTINCT 'p' || (l_partkey % 9), ',' ORDER BY 'p' || (l_partkey % 9)) AS resources, string_agg(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 'side_effect:write' ELSE 'e' || (l_suppkey % 3) END, ',' ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN 'side_effect:write' ELSE 'e' || (l_suppkey % 3) END) AS effects, max(l_linenumber % 4) + 1 AS risk FROM lineitem GROUP BY 1")
def plan_serving_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    effects = F.when(c("l_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), c("l_suppkey") % 3)))
    n = read(spark, sf, "lineitem").select(c("l_orderkey").alias("plan_id"), F.array(F.concat(F.lit("p"), c("l_partkey") % 9)).alias("resources"), effects.alias("effects"), F.lit("write").alias("side_effect"), (c("l_linenumber") % 4 + 1).alias("risk"))
    return records.serving_metadata(n).select("plan_id", text("resources").alias("resources"), text("effects").alias("effects"), "risk")


@query("SELECT l_orderkey AS plan_id, CAST(sum(l_linenumber) AS BIGINT) AS risk_cost, CAST(sum(l_suppkey % 5) AS BIGINT) AS tool_cost, min(l_partkey) AS evidence, bool_and(l_returnflag <> 'R') AS observed FROM lineitem GROUP BY 1")
def plan_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    n = read(spark, sf, "lineitem").select(c("l_orderkey").alias("plan_id"), c("l_linenumber").alias("risk_cost"), (c("l_suppkey") % 5).alias("tool_cost"), c("l_partkey").alias("evidence"), (c("l_returnflag") != "R").alias("observed"))
    return records.plan_totals(n)


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_custkey % 3 > 0 THEN 'bridged' WHEN o_custkey % 4 = 1 AND o_orderkey % 2 = 0 THEN 'exact' ELSE 'known_shape' END AS novelty, count(*) AS n FROM orders GROUP BY 1")
def plan_novelty(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    p = read(spark, sf, "orders").select((c("o_orderstatus") != "P").alias("complete"), (c("o_custkey") % 3).alias("bridges"), (c("o_custkey") % 4).alias("nodes"), (c("o_orderkey") % 2 == 0).alias("exact_hit"))
    return records.novelty(p).groupBy("novelty").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS version_id, greatest(max(l_linenumber % 3), count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax > 0.07)) AS unsafe FROM lineitem GROUP BY 1")
def unsafe_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What a document says and what was recorded since: the larger counts."""
    li, c = read(spark, sf, "lineitem"), F.col
    said = li.select(c("l_suppkey").alias("version_id"), (c("l_linenumber") % 3).alias("unsafe"))
    return rules.effective_unsafe(said, li.where("l_returnflag = 'R' AND l_tax > 0.07").select(c("l_suppkey").alias("version_id")))


@query(f"WITH {A.EDGES} SELECT src, count(DISTINCT trace_id) AS supporting FROM edges GROUP BY src HAVING count(*) > 1")
def version_evidence_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = causal.flow_edges(A.accesses(spark, sf))
    return rules.supporting_outcomes(e.select(F.col("src").alias("version_id"), F.col("trace_id").alias("outcome_id"))).where("mentions > 1").select(F.col("version_id").alias("src"), "supporting")


# --- workflow, judgments, embeddings -----------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT doc_id, text AS c0, upper(lang) || ':' || text AS c1, CASE WHEN n_chars >= 300 THEN md5(upper(lang) || ':' || text) END AS c2, CASE WHEN n_chars >= 300 THEN reverse(md5(upper(lang) || ':' || text)) END AS c3 FROM documents),
s AS (SELECT doc_id, 'load' AS stage, c0 AS i, c1 AS o FROM b UNION ALL SELECT doc_id, 'evaluate', c1, c2 FROM b UNION ALL SELECT doc_id, 'build_graph', c2, c3 FROM b WHERE c2 IS NOT NULL UNION ALL SELECT doc_id, 'synthesize', c3, c3 || '!' FROM b WHERE c2 IS NOT NULL UNION ALL SELECT doc_id, 'publish', c3 || '!', c3 || '!!' FROM b WHERE c2 IS NOT NULL)
SELECT stage, count(*) AS n, count(o) AS finished, min(sha256(i)) AS first_input, max(sha256(o)) AS last_output FROM s GROUP BY stage"""
)
def workflow_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Five stages over documents; short ones end at the second."""
    c = F.col
    d = read(spark, sf, "documents").select(c("doc_id").alias("workflow_id"), c("text").alias("content"), "lang", "n_chars")
    steps = {
        "load": lambda x: F.concat(F.upper("lang"), F.lit(":"), x), "evaluate": lambda x: F.when(c("n_chars") >= 300, F.md5(x.cast("binary"))), "build_graph": lambda x: F.reverse(x),
        "synthesize": lambda x: F.concat(x, F.lit("!")), "publish": lambda x: F.concat(x, F.lit("!")),
    }
    out = records.stage_chain(d, steps)
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.count("output_hash").alias("finished"), F.min("input_hash").alias("first_input"), F.max("output_hash").alias("last_output"))


@query("""WITH v AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 50 THEN 'too_short' END, CASE WHEN lang = 'es' THEN 'language' END], lambda x: x IS NOT NULL)) AS rule FROM documents) SELECT doc_id, rule, 'audit_' || sha256('{"key":"' || doc_id || '","rule":"' || rule || '"}') AS audit_id FROM v""")
def quarantine_audit(spark: SparkSession, sf: str) -> DataFrame:
    return records.quarantine(read(spark, sf, "documents"), {"too_short": F.col("n_chars") >= 50, "language": F.col("lang") != "es"}, "doc_id")[1]


@query("SELECT event_id, CAST(floor(value * 8000) AS BIGINT) // 4 AS intent_fit, CAST(floor(value * 7000) AS BIGINT) // 4 AS task_coverage, 1000000 - CAST(floor(value * 2000) AS BIGINT) AS non_contradiction FROM events")
def judgment_features(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda k: F.floor(F.col("value") * k).cast("long")
    j = read(spark, sf, "events").select("event_id", v(8000).alias("intent_score"), v(7000).alias("coverage_score"), v(2000).alias("contradicts"), v(1000).alias("preconditions"), v(500).alias("partial_plan"))
    return records.judgment_features(j).select("event_id", "intent_fit", "task_coverage", "non_contradiction")


@query(f"SELECT doc_id AS key, (strlen(text) + 3) // 4 + 600 AS tokens FROM documents WHERE NOT coalesce({HOLDS}, false)")
def judge_state(spark: SparkSession, sf: str) -> DataFrame:
    return records.judge_requests(read(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("state"))).select("key", "tokens")


@query(
    f"""WITH {A.QUEUE}, r AS (SELECT tenant_id AS query_id, job_id AS version_id, available_at AS final FROM queue), j AS (SELECT *, bool_and(version_id % 6 <> 5) OVER (PARTITION BY query_id) AS ok FROM r WHERE version_id % 2 = 1)
SELECT r.query_id, r.version_id, r.final + CASE WHEN j.ok THEN 1000 ELSE 0 END AS final FROM r LEFT JOIN j USING (query_id, version_id)"""
)
def semantic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    r = A.queue(spark, sf).select(c("tenant_id").alias("query_id"), c("job_id").alias("version_id"), c("available_at").alias("final"))
    judged = r.where("version_id % 2 = 1").select("query_id", "version_id", (c("version_id") % 6 != 5).alias("committed"), F.lit(1000).alias("bonus"))
    return records.rerank(r, judged)


@query()
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Documents embedded by the local embedder; texts of one language are in the cache already (as zero vectors)."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    cache = d.where("lang = 'fr'").select(F.sha2("text", 256).alias("input_hash"), F.array_repeat(F.lit(0.0), 16).alias("vector")).dropDuplicates(["input_hash"])
    out = records.embed_missing(d.select("id", "text"), cache, records.hashed_embedding(16))
    return out.select("id", text(F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("vector"))


@query(f"WITH {A.QUEUE} SELECT tenant_id, count(*) AS rows, sha256(tenant_id || ':' || count(*)) AS receipt FROM queue WHERE tenant_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY tenant_id")
def erasure_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The tenants of a segment erased from a catalog's table of jobs, with a hashed receipt each."""
    store = Catalog(spark, f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}")
    store.append("jobs", A.queue(spark, sf).select("tenant_id", "job_id"))
    return store.erase_all("jobs", "tenant_id", read(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("tenant_id")))


@query("SELECT n_regionkey, sha256(string_agg(n_nationkey || '=' || n_name, ';' ORDER BY n_nationkey)) AS set_hash FROM nation GROUP BY n_regionkey")
def candidate_set_hash(spark: SparkSession, sf: str) -> DataFrame:
    return rules.candidate_set_hash(read(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", F.concat_ws("=", "n_nationkey", "n_name"))


@query(f"WITH {A.QUEUE} SELECT job_id, available_at + 2592000 AS expires_at, available_at + 2592000 <= {A.NOW} AS expired FROM queue")
def retention_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return rules.retained(A.queue(spark, sf), "available_at", rules.MOST_RETENTION).select("job_id", "expires_at", (F.col("expires_at") <= A.NOW).alias("expired"))


@query(f"WITH {A.ACCESSES} SELECT trace_id, position FROM accesses WHERE succeeded AND writes")
def required_effects(spark: SparkSession, sf: str) -> DataFrame:
    effect = F.when(F.col("writes"), "write").otherwise("none")
    return rules.required_effects(A.accesses(spark, sf).withColumn("side_effect", effect)).select("trace_id", "position")


@query(f"WITH {A.QUEUE} SELECT tenant_id, job_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY available_at DESC, job_id) AS rank FROM queue) WHERE rank <= 3")
def latest_reads(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("tenant_id").orderBy(F.desc("available_at"), "job_id")
    return A.queue(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("tenant_id", "job_id", "rank")


# --- rules of stored records -------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT p_partkey, p_size, p_partkey % 5 AS cutoff, p_size % 7 AS evaluated, CASE WHEN p_size % 4 = 0 THEN 'gone' WHEN p_size > 25 THEN 'active' ELSE 'trial' END AS next,
  CASE WHEN p_partkey % 3 = 0 THEN ['r' || (p_size % 3), 'a' || (p_size % 2)] ELSE ['a' || (p_size % 2), 'r' || (p_size % 3)] END AS reasons FROM part),
v AS (SELECT unnest(list_filter([CASE WHEN next = 'gone' THEN 'states' END, CASE WHEN cutoff > evaluated THEN 'cutoff_before_evaluation' END, CASE WHEN p_partkey % 3 = 0 THEN 'reasons' END,
  CASE WHEN p_partkey % 50 = 7 THEN 'hash' END], lambda x: x IS NOT NULL)) AS rule FROM d) SELECT rule, count(*) AS n FROM v GROUP BY rule"""
)
def lifecycle_decision_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions over parts: some name no state, some rest on later evidence, some have unsorted reasons, some were changed."""
    c = F.col
    next_state = F.when(c("p_size") % 4 == 0, "gone").when(c("p_size") > 25, "active").otherwise("trial")
    a, r = F.concat(F.lit("a"), c("p_size") % 2), F.concat(F.lit("r"), c("p_size") % 3)
    d = read(spark, sf, "part").select(
        c("p_partkey").alias("key"), F.concat(F.lit("pv_"), "p_partkey").alias("version_id"), F.lit("policy-1").alias("policy_id"), F.lit("trial").alias("prior_state"), next_state.alias("next_state"),
        F.when(c("p_partkey") % 3 == 0, F.array(r, a)).otherwise(F.array(a, r)).alias("reasons"), (c("p_size") * 1000).alias("wilson_ppm"), (c("p_partkey") % 5).alias("cutoff_at"), (c("p_size") % 7).alias("evaluated_at"),
    )
    d = d.withColumn("content_hash", F.sha2(rules.decision_content(), 256)).withColumn("id", F.concat(F.lit("lcd_"), "content_hash"))
    d = d.withColumn("wilson_ppm", F.when(c("key") % 50 == 7, c("wilson_ppm") + 1).otherwise(c("wilson_ppm")))
    return records.violations(d, "key", rules.decision_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderstatus <> 'P' AS complete, CASE WHEN o_orderkey % 11 = 0 THEN 'partial' WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_custkey % 3 > 0 THEN 'bridged' ELSE 'known_shape' END AS novelty FROM orders),
v AS (SELECT k, unnest(list_filter([CASE WHEN complete AND novelty = 'partial' THEN 'novelty' END, CASE WHEN complete AND k % 13 = 0 THEN 'schedule' END, CASE WHEN complete AND k % 13 = 1 THEN 'schedule_of_plan' END,
  CASE WHEN NOT complete AND u % 2 = 0 THEN 'gaps' END, CASE WHEN k % 17 = 0 THEN 'experiment' END], lambda x: x IS NOT NULL)) AS rule FROM s) SELECT rule, count(*) AS n FROM v GROUP BY rule"""
)
def selection_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Selections over orders: plans of three steps; some lack their schedule, some have another plan's."""
    c = F.col
    o = read(spark, sf, "orders").select(c("o_orderkey").alias("plan_id"), (c("o_orderstatus") != "P").alias("complete"), (c("o_custkey") % 3).alias("bridges"), (c("o_custkey") % 2).alias("gaps"), F.lit(2).alias("nodes"), F.lit(False).alias("exact_hit"))
    o = records.novelty(o).withColumn("novelty", F.when(c("plan_id") % 11 == 0, "partial").otherwise(c("novelty")))
    o = o.withColumn("plan_hash", F.sha2(c("plan_id").cast("string"), 256)).withColumn("steps", F.array(*[F.lit(x) for x in ("s1", "s2", "s3")]))
    schedule = F.struct("plan_id", F.when(c("plan_id") % 13 == 1, "other").otherwise(c("plan_hash")).alias("plan_hash"), F.reverse("steps").alias("steps"))
    o = o.withColumn("schedule", F.when(c("complete") & (c("plan_id") % 13 != 0), schedule)).withColumn("experiment_id", F.lit("e")).withColumn("assignment_id", F.when(c("plan_id") % 17 != 0, "x"))
    return records.violations(o, "plan_id", rules.selection_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 > 0 AND p_partkey % 7 > 0 THEN sha256('{"evidence_strength":' || (p_size % 6) || ',"exclusive":[],"goals":["g0","g' || (1 + p_size % 3) || '"],"interface_hash":"' || sha256(p_name) || '","lifecycle":"trial","mutexes":["m"],"policy_id":"policy-1","reads":["res_' || p_brand || '"],"tool_cost":' || (p_size % 5) || ',"version_id":"pv_' || p_partkey || '","writes":[]}') END AS facts_hash FROM part"""
)
def planning_facts_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Of parts: lists come unsorted and untrimmed; no cost, and every seventh part's foreign resource, leave no hash."""
    c, none = F.col, F.array().cast("array<string>")
    v = read(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" pv_"), "p_partkey").alias("version_id"), F.sha2("p_name", 256).alias("interface_hash"), F.lit("trial").alias("lifecycle"), F.lit("policy-1 ").alias("policy_id"),
        F.array(F.concat(F.lit("g"), 1 + c("p_size") % 3), F.lit(" g0")).alias("goals"), F.array(F.concat(F.when(c("p_partkey") % 7 == 0, "file_").otherwise("res_"), "p_brand")).alias("reads"),
        none.alias("writes"), none.alias("exclusive"), F.array(F.lit("m"), F.lit("m ")).alias("mutexes"), (c("p_size") % 6).alias("evidence_strength"), (c("p_size") % 5).alias("tool_cost"),
    )
    return rules.planning_facts(v).select("p_partkey", "facts_hash")
