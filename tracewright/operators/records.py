"""Building, checking and replaying the engine's records: requests, documents, runs, judgments, procedures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.functions import scalars as S

# --- requests ----------------------------------------------------------------------------------------------------


def rewrite_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(id, name) with canonical names where aliases(alias, name) has one. An alias of two names is an error."""
    a = aliases.groupBy("alias").agg(F.min("name").alias("__a"), F.max("name").alias("__b"))
    checked = F.when(F.col("__a") == F.col("__b"), F.col("__a")).when(F.col("__a").isNotNull(), F.raise_error(F.lit("conflicting alias")).cast("string"))
    return names.join(a, F.col("name") == F.col("alias"), "left").withColumn("name", F.coalesce(checked, F.col("name"))).drop("alias", "__a", "__b")


def build_queries(requests: DataFrame) -> DataFrame:
    """requests(task, harness, environment, max_candidates) plus intent_hash, environment_hash, query_hash; candidates
    are bounded by 1 and 100."""
    bounded = F.when(F.col("max_candidates").between(1, 100), F.col("max_candidates")).otherwise(F.raise_error(F.lit("max_candidates")).cast("int"))
    r = requests.withColumn("max_candidates", bounded).withColumn("intent_hash", canonical.struct_hash(task=S.token(F.col("task"))))
    r = r.withColumn("environment_hash", canonical.struct_hash(environment=F.col("environment")))
    return r.withColumn("query_hash", canonical.struct_hash(task=S.token(F.col("task")), harness=F.col("harness"), environment=F.col("environment"), max_candidates=F.col("max_candidates")))


def context_hash(tenant: Column, query_hash: Column, recall: Column, regions: Column) -> Column:
    return canonical.struct_hash(tenant_id=tenant, query_hash=query_hash, recall=recall, regions=S.normalized_set(regions))


def scoped_tenant(tenant: Column, subject: Column, separator: str, domain: str) -> Column:
    """Storage scope of a person: plain ids as they are, any other as `h_` and 40 digits of a hash under `domain`."""
    hashed = F.concat(F.lit("h_"), F.substring(S.nul_hash(F.lit(domain), subject), 1, 40))
    plain = subject.rlike("^[A-Za-z0-9][A-Za-z0-9-]{0,62}$")
    return F.when(F.coalesce(subject, F.lit("")) == "", tenant).otherwise(F.concat(tenant, F.lit(separator), F.when(plain, subject).otherwise(hashed)))


def organization(scope: Column, separator: str = "__") -> Column:
    return F.substring_index(scope, separator, 1)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: every rule a row breaks (a rule that cannot be answered is broken), in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def seal(plain: Column, key: Column, nonce: Column, tenant: Column) -> Column:
    """AES-256-GCM with the tenant as authenticated data, URL-safe base64 of nonce and text."""
    sealed = F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, tenant.cast("binary"))
    return F.concat(F.lit("enc.v1."), F.translate(F.base64(sealed), "+/=", "-_"))


def unseal(sealed: Column, key: Column, tenant: Column) -> Column:
    body = F.translate(F.substring_index(sealed, ".", -1), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.aes_decrypt(F.unbase64(padded), key, F.lit("GCM"), F.lit("DEFAULT"), tenant.cast("binary")).cast("string")


def replay(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests(run_id, query_hash, context_hash) plus outcome: new, replayed (stored run, same hashes) or conflict."""
    stored = runs.select("run_id", F.col("query_hash").alias("__q"), F.col("context_hash").alias("__c"), F.lit(True).alias("__found"))
    same = (F.col("query_hash") == F.col("__q")) & (F.col("context_hash") == F.col("__c"))
    return requests.join(stored, "run_id", "left").withColumn("outcome", F.when(F.col("__found").isNull(), "new").when(same, "replayed").otherwise("conflict")).drop("__q", "__c", "__found")


# --- documents and runs ------------------------------------------------------------------------------------------


def explode_run(runs: DataFrame) -> DataFrame:
    """runs(run_id, hits: array of struct(channel, version_id)) -> run_id, channel, version_id, rank within channel."""
    flat = runs.select("run_id", F.posexplode("hits").alias("__i", "hit")).select("run_id", "__i", "hit.*")
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "channel").orderBy("__i"))).drop("__i")


def invalid_ranks(hits: DataFrame, key: list[str]) -> DataFrame:
    """Groups whose ranks are not 1 .. n."""
    found = hits.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("rank").alias("kinds"), F.min("rank").alias("least"), F.max("rank").alias("most"))
    return found.where("least <> 1 OR most <> n OR kinds <> n").select(*key, "n")


def decode_versions(rows: DataFrame, schemas: dict[str, str], payload: str = "payload", version: str = "schema_version") -> DataFrame:
    """Plus body: each row's JSON read by its own version's schema into the newest one; null for unknown versions."""
    newest = list(schemas)[-1]
    names = [f.split()[0] for f in schemas[newest].split(", ")]

    def read(v: str) -> Column:
        own = F.from_json(payload, schemas[v], {"mode": "FAILFAST"})
        has = {f.split()[0] for f in schemas[v].split(", ")}
        kinds = dict(f.split(" ", 1) for f in schemas[newest].split(", "))
        return F.struct(*[(own[n] if n in has else F.lit(None)).cast(kinds[n]).alias(n) for n in names])

    return rows.withColumn("body", reduce(lambda out, v: F.when(F.col(version) == v, read(v)).otherwise(out), schemas, F.lit(None)))


def tampered(rows: DataFrame, key: str, stored: str, recomputed: Column) -> DataFrame:
    """Rows whose stored hash is not what their content gives."""
    return rows.where(~F.col(stored).eqNullSafe(recomputed)).select(key)


def revise(documents: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The next revision of each changed document: new values, new hash, epoch one up. changes(version_id, ...)."""
    renamed = changes.select("version_id", *[F.col(c).alias(f"__{c}") for c in columns])
    out = documents.join(renamed, "version_id")
    out = out.withColumns({c: F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns]).withColumn("epoch", F.col("epoch") + 1)
    return out.withColumn("content_hash", canonical.struct_hash(**{c: F.col(c) for c in ("version_id", "epoch", *columns)}))


def enrich_steps(steps: DataFrame, contracts: DataFrame) -> DataFrame:
    """steps(tenant_id, contract) plus side_effect and risk of the tenant's own contract, else its organization's, else
    blank. contracts(tenant_id, contract, side_effect, risk)."""
    own = contracts.select(F.col("tenant_id").alias("__t"), F.col("contract").alias("__c"), F.col("side_effect").alias("e1"), F.col("risk").alias("r1"))
    org = contracts.select(F.col("tenant_id").alias("__ot"), F.col("contract").alias("__oc"), F.col("side_effect").alias("e2"), F.col("risk").alias("r2"))
    out = steps.withColumn("__org", organization(F.col("tenant_id")))
    out = out.join(own, (F.col("tenant_id") == F.col("__t")) & (F.col("contract") == F.col("__c")), "left")
    out = out.join(org, (F.col("__org") == F.col("__ot")) & (F.col("contract") == F.col("__oc")), "left")
    blank = F.lit("")
    return out.withColumn("side_effect", F.coalesce("e1", "e2", blank)).withColumn("risk", F.coalesce("r1", "r2", blank)).drop("__org", "__t", "__c", "__ot", "__oc", "e1", "e2", "r1", "r2")


def foreign_edges(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges whose ends are missing or belong to another tenant. edges(tenant_id, src, dst); ends(tenant_id, id)."""
    e = ends.select("tenant_id", "id")
    ok = edges.join(e.withColumnRenamed("id", "src"), ["tenant_id", "src"], "left_semi").join(e.withColumnRenamed("id", "dst"), ["tenant_id", "dst"], "left_semi")
    return edges.join(ok, ["tenant_id", "src", "dst"], "left_anti")


# --- procedures --------------------------------------------------------------------------------------------------


def procedure_ids(procedures: DataFrame) -> DataFrame:
    """procedures(tenant_id, intent, effect, steps: array<string>, policy) plus family_id and version_id; neither depends
    on event ids."""
    family = canonical.struct_hash("proc_", tenant_id=F.col("tenant_id"), intent_hash=F.col("intent"), effect_signature_hash=F.col("effect"))
    out = procedures.withColumn("family_id", family)
    return out.withColumn("version_id", canonical.struct_hash("pv_", family_id=F.col("family_id"), steps=F.col("steps"), policy=F.col("policy")))


def negative_paths(failed: DataFrame) -> DataFrame:
    """failed(trace_id, position, contract, failure, environment) -> trace_id, predicate, path_id: one path per failed
    step, named by what failed and by the scope in which it did."""
    predicate = F.concat_ws(":", F.lit("tool_failure"), "contract", F.sha2("failure", 256))
    out = failed.withColumn("predicate", predicate)
    return out.select("trace_id", "position", "predicate", canonical.struct_hash("neg_", failure_predicate_id=F.col("predicate"), position=F.col("position"), environment_hash=F.sha2("environment", 256)).alias("path_id"))


def verification_strength(facts: DataFrame) -> DataFrame:
    """outcome_id, strength: 5 for an independent verifier down to 1, over satisfied facts; 0 without any."""
    from tracewright.operators.evidence import class_rank

    return facts.groupBy("outcome_id").agg(F.coalesce(F.max(F.when(F.col("verdict") == "satisfied", 6 - class_rank(F.col("class")))), F.lit(0)).cast("long").alias("strength"))


def serving_metadata(nodes: DataFrame) -> DataFrame:
    """nodes(plan_id, resources, effects, side_effect, risk) -> plan_id, resources, effects, risk (highest)."""
    fallback = F.when((F.size("effects") == 0) & (F.col("side_effect") != "none"), F.array(F.concat(F.lit("side_effect:"), "side_effect"))).otherwise(F.col("effects"))
    rows = nodes.withColumn("effects", fallback)
    return rows.groupBy("plan_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("resources")))).alias("resources"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("effects")))).alias("effects"), F.max("risk").alias("risk")
    )


def novelty(plans: DataFrame) -> DataFrame:
    """plans(complete, nodes, bridges, exact_hit) plus novelty: partial, bridged, exact or known_shape."""
    kind = F.when(~F.col("complete"), "partial").when(F.col("bridges") > 0, "bridged").when((F.col("nodes") == 1) & F.col("exact_hit"), "exact").otherwise("known_shape")
    return plans.withColumn("novelty", kind)


def plan_totals(nodes: DataFrame) -> DataFrame:
    """plan_id, risk_cost, tool_cost, evidence, observed: sums, the weakest evidence, and whether all were observed."""
    return nodes.groupBy("plan_id").agg(F.sum("risk_cost").alias("risk_cost"), F.sum("tool_cost").alias("tool_cost"), F.min("evidence").alias("evidence"), F.bool_and("observed").alias("observed"))


# --- workflow ----------------------------------------------------------------------------------------------------

STAGES = ("load", "evaluate", "build_graph", "synthesize", "publish")


def stage_chain(inputs: DataFrame, transforms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """inputs(workflow_id, content) -> workflow_id, stage, input_hash, output_hash: each stage's input is the output of
    the one before; a stage whose output is null ends its workflow."""
    content, out, alive = F.col("content"), [], F.lit(True)
    for name in STAGES:
        result = transforms[name](content)
        out.append(F.when(alive, F.struct(F.lit(name).alias("stage"), F.sha2(content, 256).alias("input_hash"), F.sha2(result, 256).alias("output_hash"))))
        alive, content = alive & result.isNotNull(), result
    return inputs.select("workflow_id", F.inline(F.array_compact(F.array(*out))))


def broken_chains(stages: DataFrame) -> DataFrame:
    """workflow_id, stage whose input is not the output of the stage before it."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    w = Window.partitionBy("workflow_id").orderBy(order)
    return stages.withColumn("__p", F.lag("output_hash").over(w)).where("__p IS NOT NULL AND __p <> input_hash").select("workflow_id", "stage")


def quarantine(rows: DataFrame, rules: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, audit): audit has one row per key and broken rule, under an id that a repeat gives again."""
    broken = violations(rows, key, rules)
    audit = broken.withColumn("audit_id", canonical.struct_hash("audit_", key=F.col(key).cast("string"), rule=F.col("rule"))).dropDuplicates(["audit_id"])
    return rows.join(broken.select(key).distinct(), key, "left_anti"), audit


# --- judgments and embeddings ------------------------------------------------------------------------------------


def judgment_features(j: DataFrame) -> DataFrame:
    """Micros of a judgment as features: scores from 0 to 4 are quartered, contradiction is turned round. Plus in_range: a
    judgment out of range keeps its row and its figures, and is marked, so that it does not end the batch."""
    c = F.col
    scores = ("intent_score", "coverage_score")
    inside = [c(n).between(0, 4 * S.PPM) for n in scores] + [c(n).between(0, S.PPM) for n in ("contradicts", "preconditions", "partial_plan")]
    return j.withColumns({
        "intent_fit": F.call_function("div", c("intent_score"), F.lit(4)).cast("long"), "task_coverage": F.call_function("div", c("coverage_score"), F.lit(4)).cast("long"),
        "non_contradiction": (S.PPM - c("contradicts")).cast("long"), "in_range": F.coalesce(reduce(Column.__and__, inside), F.lit(False)),
    })


def judge_requests(states: DataFrame) -> DataFrame:
    """states(key, state JSON) that may go to a judge: nothing that looks like a credential; plus tokens asked for."""
    tokens = F.floor((F.octet_length("state") + 3) / 4).cast("long") + 600
    return states.where(~S.holds_credentials(F.col("state"))).withColumn("tokens", tokens)


def rerank(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """Final scores with the judge's bonus, but only for requests whose admitted candidates were all judged.
    judged(query_id, version_id, committed, bonus)."""
    j = judged.withColumn("__all", F.bool_and("committed").over(Window.partitionBy("query_id"))).where("__all").select("query_id", "version_id", F.col("bonus").alias("__b"))
    return ranked.join(j, ["query_id", "version_id"], "left").withColumn("final", F.col("final") + F.coalesce("__b", F.lit(0))).drop("__b")


def hashed_embedding(dimension: int) -> Callable[[pd.Series], pd.Series]:
    """A deterministic local embedder: words hashed into signed buckets."""

    def embed(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(text: str) -> list[float]:
            out = [0.0] * dimension
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[h % dimension] += 1.0 if h >> 63 else -1.0
            return out

        return texts.map(one)

    return embed


def embed_missing(inputs: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """inputs(id, text) plus vector. Each text is embedded once, and only if cache(input_hash, vector) lacks it; null text
    counts as empty."""
    hashed = inputs.withColumn("input_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    todo = hashed.select("input_hash", "text").dropDuplicates(["input_hash"]).join(cache.select("input_hash"), "input_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"input_hash": b["input_hash"], "vector": embed(b["text"])})

    fresh = todo.mapInPandas(run, "input_hash string, vector array<double>")
    return hashed.join(cache.select("input_hash", "vector").unionByName(fresh), "input_hash").drop("input_hash")
