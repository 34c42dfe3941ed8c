"""Hard eligibility gates. Every gate is tried for every candidate and all rejections are kept; what is unknown rejects.

One row per (query, candidate) carries both sides' facts; each gate is an expression that gives a rejection or null, so
all gates run in one pass without a join or a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import RISKS


@dataclass(frozen=True)
class Policy:
    lifecycles: tuple[str, ...] = ("active", "trial")
    advisory_candidates: bool = True
    maximum_risk: int = 2
    validation_policies: tuple[str, ...] = ("default",)
    maximum_age_seconds: int = 90 * 86400
    regions: tuple[str, ...] = ("eu",)

    def __post_init__(self):
        if not set(self.lifecycles) <= {"candidate", "trial", "active"} or not 1 <= self.maximum_risk <= 4:
            raise ValueError("invalid policy")


def rejection(code: str, subject: Column | str, name: str, expected: str | Column, observed: str | Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(code).alias("code"), F.coalesce(as_col(subject).cast("string"), F.lit("")).alias("subject"), F.lit(name).alias("field"), as_col(expected).alias("expected"), as_col(observed).alias("observed"))


def _if(test: Column, what: Column) -> Column:
    """The rejection where the test holds or cannot be answered."""
    return F.when(F.coalesce(test, F.lit(True)), what)


def risk_name(ordinal: Column) -> Column:
    out = F.lit("unknown")
    for i, name in enumerate(RISKS):
        out = F.when(ordinal == i + 1, name).otherwise(out)
    return out


def single_gates(policy: Policy) -> list[Column]:
    """Gates of one rejection at most. Columns: version_id, owner, shared_with, tenant, lifecycle, superseded_by, risk,
    maximum_risk, harness, harness_version, required_harness, required_harness_version, validated_at, as_of,
    validation_policy, query_recall, recall, region, query_regions."""
    c = F.col
    shared = F.coalesce(c("shared_with"), F.array().cast("array<string>"))
    foreign = c("owner") != c("tenant")
    allowed = c("lifecycle").isin(list(policy.lifecycles)) | ((c("lifecycle") == "candidate") & F.lit(policy.advisory_candidates))
    most = F.when(c("maximum_risk").between(1, 4), F.least(c("maximum_risk"), F.lit(policy.maximum_risk))).otherwise(policy.maximum_risk)
    wrong_harness = (c("required_harness") != "") & ((c("required_harness") != c("harness")) | ((c("required_harness_version") != "") & (c("required_harness_version") != c("harness_version"))))
    age = c("as_of") - c("validated_at")
    absent = c("validated_at").isNull() | (c("validated_at") <= 0)
    return [
        _if((c("tenant") == "") | (c("as_of") <= 0) | ~c("maximum_risk").between(1, 4), rejection("context_invalid", "request", "server_context", "complete", "invalid")),
        _if((c("owner") == "") | (c("lifecycle") == "") | ~c("risk").between(1, 4) | (c("region") == ""), rejection("candidate_invalid", "candidate", "metadata", "complete", "invalid")),
        _if(foreign & (F.size(shared) == 0), rejection("tenant_scope_denied", c("version_id"), "tenant_scope", "owner_or_explicit_share", "different_owner")),
        _if(foreign & (F.size(shared) > 0) & ~F.array_contains(shared, c("tenant")), rejection("sharing_scope_denied", c("version_id"), "sharing_scope", "tenant_grant", "grant_absent")),
        _if(~allowed, rejection("lifecycle_ineligible", c("version_id"), "lifecycle", "active_or_trial", F.coalesce(c("lifecycle"), F.lit("")))),
        F.when((F.coalesce(c("superseded_by"), F.lit("")) != "") | (c("lifecycle") == "superseded"), rejection("superseded", c("version_id"), "supersession", "current", "superseded")),
        _if(~c("risk").between(1, 4) | (c("risk") > most), rejection("risk_budget_exceeded", c("version_id"), "risk", risk_name(most), risk_name(c("risk")))),
        _if(wrong_harness, rejection("harness_incompatible", c("required_harness"), "harness", "compatible", "missing_or_different")),
        F.when(absent, rejection("validation_missing", c("version_id"), "validation", "present", "missing")),
        F.when(~absent & F.coalesce((age < 0) | (age > policy.maximum_age_seconds), F.lit(True)), rejection("validation_stale", c("version_id"), "validation_age", "within_policy", "stale_or_future")),
        _if(~c("validation_policy").isin(list(policy.validation_policies)), rejection("policy_incompatible", c("version_id"), "validation_policy", "compatible", "incompatible")),
        _if(~(c("query_recall") & c("recall")), rejection("consent_denied", c("version_id"), "recall_consent", "allowed", "denied")),
        _if(~(c("region").isin(list(policy.regions)) & F.array_contains("query_regions", c("region"))), rejection("residency_denied", c("version_id"), "residency", "allowed_region", "denied_or_unknown")),
    ]


def tool_gates() -> Column:
    """Rejections per required tool: tools(name, contract) of the request against required_tools of the candidate. A tool
    that the request names with two contracts is usable with neither."""

    def one(r: Column) -> Column:
        versions = F.array_distinct(F.transform(F.filter("tools", lambda t: t["name"] == r["name"]), lambda t: t["contract"]))
        usable = (F.size(versions) == 1) & (F.element_at(versions, 1) == r["contract"])
        return F.when(F.size(versions) == 0, rejection("tool_unavailable", r["name"], "tool", "available", "missing")).when(
            ~F.coalesce(usable, F.lit(False)), rejection("tool_contract_incompatible", r["name"], "contract_version", "compatible", "incompatible")
        )

    return F.transform("required_tools", one)


def resource_gates() -> Column:
    """resources(type, namespace, identity, schema) present, with the schema asked for. The identity is never shown."""

    def one(r: Column) -> Column:
        same = F.filter("resources", lambda x: (x["type"] == r["type"]) & (x["namespace"] == r["namespace"]) & (x["identity"] == r["identity"]))
        schemas = F.array_distinct(F.transform(same, lambda x: x["schema"]))
        fits = (r["schema"] == "") | ((F.size(schemas) == 1) & (F.element_at(schemas, 1) == r["schema"]))
        subject = F.concat_ws(":", r["type"], r["namespace"])
        return F.when(F.size(same) == 0, rejection("resource_precondition_missing", subject, "resource", "present", "missing")).when(
            ~F.coalesce(fits, F.lit(False)), rejection("resource_schema_incompatible", subject, "schema_version", "compatible", "incompatible")
        )

    return F.transform("required_resources", one)


def effect_gates() -> Column:
    return F.transform(F.array_intersect("effects", "forbidden_effects"), lambda e: rejection("forbidden_effect", e, "effect", "allowed", "forbidden"))


def environment_gates() -> Column:
    """environment(name, value) of the request has every fact the candidate requires."""

    def one(r: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter("environment", lambda x: x["name"] == r["name"]), lambda x: x["value"]))
        same = (F.size(values) == 1) & (F.element_at(values, 1) == r["value"])
        return F.when(~F.coalesce(same, F.lit(False)), rejection("environment_incompatible", r["name"], "environment", "compatible", "missing_or_different"))

    return F.transform("required_environment", one)


def evaluate(pairs: DataFrame, policy: Policy, lists: tuple[str, ...] = ("tools", "resources", "effects", "environment")) -> DataFrame:
    """pairs plus rejections (sorted), eligible, advisory. `lists` names the gates over lists whose columns are there."""
    found = F.array(*single_gates(policy))
    more = {"tools": tool_gates, "resources": resource_gates, "effects": effect_gates, "environment": environment_gates}
    found = F.array_sort(F.array_compact(F.concat(found, *[more[name]() for name in lists])))
    eligible = F.size("rejections") == 0
    return pairs.withColumn("rejections", found).withColumn("eligible", eligible).withColumn("advisory", eligible & (F.col("lifecycle") == "candidate"))


def codes(rejections: Column) -> Column:
    """The distinct codes, sorted: what is stored with a run."""
    return F.array_sort(F.array_distinct(F.transform(rejections, lambda r: r["code"])))


def safe_without_promotion(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """Documents a plan may use before promotion: low or medium risk, at least one step, none of which is of unknown or
    irreversible effect or of high risk. steps(version_id, side_effect, risk); a missing contract is unsafe."""
    bad = steps.where(F.coalesce(F.col("side_effect"), F.lit("")).isin("", "irreversible", "unknown") | F.coalesce(F.col("risk"), F.lit("")).isin("", "high", "critical"))
    fit = documents.where(F.col("risk").between(1, 2)).join(steps.select("version_id").distinct(), "version_id", "left_semi")
    return fit.join(bad.select("version_id").distinct(), "version_id", "left_anti")
