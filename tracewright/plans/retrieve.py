"""The retrieval path: a batch of requests through channels, gates, fusion and selection, in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import channels, gates, manifests, ranking, records
from tracewright.sources.tables import checkpoint

RANKER = ranking.Ranker()
POLICY = gates.Policy(regions=("en", "fr", "de", "es"))


#: The channels that the ranker weighs, and those that the SQL of the registered queries runs.
ALL, IN_SQL = ("exact", "lexical", "vector", "facet", "graph"), ("exact", "lexical", "facet")
DIMENSION = 64


def vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, vector: hashed embeddings of the tasks; a task without a direction has none."""
    embed = F.pandas_udf(records.hashed_embedding(DIMENSION), "array<double>")
    return rows.select(key, embed(F.coalesce("task", F.lit(""))).alias("vector")).where(F.exists("vector", lambda x: x != 0))


def candidates(docs: DataFrame, requests: DataFrame, limit: int = 20, names: tuple[str, ...] = ALL) -> DataFrame:
    """The hits of the named channels, long form."""
    run = {
        "exact": lambda: channels.exact(docs, requests, limit), "lexical": lambda: channels.lexical(docs, requests, limit), "facet": lambda: channels.facet(docs, requests, limit),
        "graph": lambda: channels.graph(docs.select("version_id", F.explode("contracts").alias("contract")), requests, limit),
        "vector": lambda: channels.vector(vectors(docs, "version_id"), vectors(requests, "query_id"), limit),
    }
    found = [run[name]() for name in names]
    return reduce(DataFrame.unionByName, found)


def pairs(hits: DataFrame, docs: DataFrame, requests: DataFrame, as_of: int) -> DataFrame:
    """One row per candidate with the facts of both sides. The documents are met by id, their texts are not read."""
    c = F.col
    d = docs.select(
        "version_id", "lifecycle", "risk", "contracts", c("harness").alias("required_harness"), c("toxic"), c("quality"), c("n_chars"),
        F.when(c("quality").isNotNull(), F.lit(as_of) - c("n_chars") * 3600).alias("validated_at"),
    )
    q = requests.select("query_id", "harness", c("contracts").alias("offered"))
    out = hits.select("query_id", "version_id", "rrf").join(q, "query_id").join(d, "version_id")
    empty = F.array().cast("array<string>")
    return out.select(
        "query_id", "version_id", "rrf", "lifecycle", "risk", "harness", "required_harness", "validated_at", "n_chars", "quality",
        F.lit("acme").alias("tenant"), F.when(c("version_id") % 10 == 9, "other").otherwise("acme").alias("owner"),
        F.when(c("version_id") % 20 == 9, F.array(F.lit("acme"))).when(c("version_id") % 20 == 19, F.array(F.lit("third"))).otherwise(empty).alias("shared_with"),
        F.when(c("version_id") % 13 == 12, "newer").otherwise("").alias("superseded_by"), F.lit(3).alias("maximum_risk"),
        F.lit("").alias("harness_version"), F.lit("").alias("required_harness_version"), F.lit(as_of).cast("long").alias("as_of"), F.lit("default").alias("validation_policy"),
        F.lit(True).alias("query_recall"), (c("n_chars") % 11 != 0).alias("recall"), c("required_harness").alias("region"), F.array(F.lit("en"), F.lit("fr"), F.lit("de")).alias("query_regions"),
        F.transform("offered", lambda t: F.struct(t.alias("name"), F.lit("1").alias("contract"))).alias("tools"),
        F.transform(F.slice("contracts", 1, 1), lambda t: F.struct(t.alias("name"), F.when(t == "tool3", "2").otherwise("1").alias("contract"))).alias("required_tools"),
        F.when(c("toxic") == 1, F.array(F.lit("toxic"))).otherwise(empty).alias("effects"), F.array(F.lit("toxic")).alias("forbidden_effects"),
    )


def evaluated(docs: DataFrame, requests: DataFrame, as_of: int, names: tuple[str, ...] = ALL) -> DataFrame:
    fused = ranking.rrf(candidates(docs, requests, names=names), RANKER)
    return gates.evaluate(pairs(fused, docs, requests, as_of), POLICY, ("tools", "effects"))


def ordered(docs: DataFrame, requests: DataFrame, as_of: int, names: tuple[str, ...] = ALL) -> DataFrame:
    """Eligible candidates in total order."""
    return ranked(evaluated(docs, requests, as_of, names))


def ranked(gated: DataFrame) -> DataFrame:
    """Gated candidates in total order, eligible ones only."""
    e = gated.where("eligible").withColumn("verification_strength", F.when(F.col("quality").isNotNull(), F.lit(5) - F.col("risk")).cast("int")).withColumn("observed", F.col("n_chars") % 2 == 0)
    return ranking.total_order(ranking.fuse(e, RANKER))


def retrieve(docs: DataFrame, requests: DataFrame, as_of: int, minimum: int = 0, most: int = 5, names: tuple[str, ...] = ALL) -> DataFrame:
    """query_id, version_id, rank, final of what is selected."""
    chosen = ranking.select_top(ordered(docs, requests, as_of, names), minimum, most)
    return chosen.where("selected").select("query_id", "version_id", "rank", "final")


#: Channels without whose answer a request fails; the others' absence is noted with it.
REQUIRED = ("exact", "facet", "graph", "lexical")


@dataclass(frozen=True)
class Answer:
    """What a batch of requests came to: the channels' hits that counted, gated candidates, their order, and the runs."""

    hits: DataFrame
    gated: DataFrame
    order: DataFrame
    runs: DataFrame


def answer(
    index: DataFrame, docs: DataFrame, requests: DataFrame, as_of: int, serving: tuple[DataFrame, DataFrame], runs: DataFrame, judged: DataFrame | None = None,
    required: tuple[str, ...] = REQUIRED, minimum: int = 0, most: int = 5, distance: int = 0, judge_most: int = 5,
) -> Answer:
    """A batch of requests from snapshot to disposition. The runs: query_id, disposition (selected, abstained, failed), reason,
    degraded (optional channels that did not answer) and selected (version ids in order).

    serving: the configured channels(channel, index_id) and the snapshot's; a required channel that the snapshot does not
    bind is an error of the whole batch, another one does not run. runs(query_id, channel, code): how channels ended;
    what a channel with a code has found does not count. index is what the channels search, docs what the snapshot
    holds: a request with a candidate that docs lack, or hold twice, fails. judged(query_id, version_id, committed,
    bonus) re-ranks the requests whose whole ambiguity band was judged."""
    binding = {r.channel: r.binding for r in manifests.bound_channels(*serving).collect()}  # one row per channel
    if loose := sorted(f"{name} {binding.get(name, 'not_configured')}" for name in required if binding.get(name) != "bound"):
        raise ValueError(f"serving_config_mismatch: {', '.join(loose)}")
    c, ended = F.col, runs.where("code IS NOT NULL").select("query_id", "channel").distinct()
    hits = candidates(index, requests, names=tuple(name for name in ALL if binding.get(name) == "bound"))
    hits = checkpoint(hits.join(ended, ["query_id", "channel"], "left_anti"))  # the channels run once
    fused = checkpoint(ranking.rrf(hits, RANKER))
    once = docs.groupBy("version_id").agg(F.count("*").alias("n")).where("n = 1")
    absent = fused.join(once, "version_id", "left_anti").select("query_id").distinct().withColumn("failure", F.lit("candidate_snapshot_missing"))
    failed = channels.degraded(runs, list(required)).withColumn("first", F.lit(0)).unionByName(absent.withColumn("first", F.lit(1)))
    failed = checkpoint(failed.groupBy("query_id").agg(F.min_by("failure", "first").alias("reason")))
    live = requests.join(failed, "query_id", "left_anti")
    gated = checkpoint(gates.evaluate(pairs(fused, docs, live, as_of), POLICY, ("tools", "effects")))
    order = checkpoint(ranked(gated))
    if judged is not None:
        band = ranking.ambiguity_band(order, distance, judge_most).select("query_id", "version_id").join(judged, ["query_id", "version_id"], "left")
        band = band.select("query_id", "version_id", F.coalesce("committed", F.lit(False)).alias("committed"), F.coalesce("bonus", F.lit(0)).alias("bonus"))
        order = ranking.total_order(records.rerank(order.drop("rank"), band))
    order = checkpoint(ranking.select_top(order, minimum, most).select("query_id", "version_id", "rank", "final", "selected"))
    chosen = order.where("selected").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "version_id"))), lambda x: x["version_id"]).alias("selected"))
    facts = gated.select("query_id", "version_id", "eligible", "advisory").join(order.select("query_id", "version_id", "final"), ["query_id", "version_id"], "left")
    out = ranking.disposition(live, facts, minimum).unionByName(failed.join(requests.select("query_id"), "query_id", "left_semi").select("query_id", F.lit("failed").alias("disposition"), "reason"))
    noted = ended.where(~c("channel").isin(list(required))).groupBy("query_id").agg(F.array_sort(F.collect_set("channel")).alias("degraded"))
    none = F.array()
    ended_as = out.join(noted, "query_id", "left").join(chosen, "query_id", "left").select("query_id", "disposition", "reason", F.coalesce("degraded", none).alias("degraded"), F.coalesce("selected", none).alias("selected"))
    return Answer(hits, gated, order, ended_as)


def serve(*args, **options) -> DataFrame:
    """The runs of `answer`."""
    return answer(*args, **options).runs
