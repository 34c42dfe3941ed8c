"""The record of answered requests: what was found, rejected, ranked and selected, stored once and read back to explain or
to answer the same request again.

A run is several tables published by one commit. Its id names the tenant, the request and the snapshot it was answered
from; its content hash covers the canonical text of the answer. The same run again is not stored again; another answer
under the same id is a conflict, and the stored one stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import canonical
from tracewright.functions import scalars as S
from tracewright.operators import gates
from tracewright.plans import retrieve
from tracewright.sources.tables import Catalog, checkpoint

TABLES = {
    "retrieval_runs": "tenant_id STRING, run_id STRING, query_id BIGINT, query_hash STRING, snapshot_id STRING, disposition STRING, reason STRING, degraded ARRAY<STRING>, selected ARRAY<BIGINT>, body STRING, content_hash STRING, created_at BIGINT, expires_at BIGINT",
    "run_hits": "tenant_id STRING, run_id STRING, channel STRING, version_id BIGINT, rank BIGINT, score BIGINT",
    "run_gates": "tenant_id STRING, run_id STRING, version_id BIGINT, eligible BOOLEAN, advisory BOOLEAN, codes ARRAY<STRING>",
    "run_ranks": "tenant_id STRING, run_id STRING, version_id BIGINT, rank BIGINT, final BIGINT, selected BOOLEAN",
}


def stored(catalog: Catalog, table: str, as_of: int | None = None) -> DataFrame:
    return catalog.read(table, as_of, T.StructType.fromDDL(TABLES[table]))


def snapshot_id(as_of: int, serving: DataFrame) -> str:
    """Names what a batch is answered from: the time, the ranker and the bound indexes."""
    bound = {r.channel: str(r.index_id) for r in serving.select("channel", "index_id").collect()}  # one row per channel
    return canonical.identity({"as_of": as_of, "indexes": bound, "ranker": retrieve.RANKER.manifest_id()}, "snap_")


def query_hash(requests: DataFrame) -> DataFrame:
    """query_id, query_hash over everything a request asks for."""
    told = F.to_json(F.struct(*(F.col(c) for c in sorted(requests.columns) if c != "query_id")), {"ignoreNullFields": "false"})
    return requests.select("query_id", F.sha2(told, 256).alias("query_hash"))


def record(catalog: Catalog, tenant_id: str, requests: DataFrame, parts: retrieve.Answer, snapshot: str, now: int, keep_seconds: int = 30 * 86400) -> DataFrame:
    """Store a batch of answers -> query_id, run_id, outcome: stored, known (the same answer is there) or conflict."""
    c, key = F.col, ["tenant_id", "run_id"]
    run_id = F.concat(F.lit("run_"), S.nul_hash(F.lit(tenant_id), c("query_id").cast("string"), c("query_hash"), F.lit(snapshot)))
    body = canonical.struct_json(
        degraded=F.to_json("degraded"), disposition=c("disposition"), query_hash=c("query_hash"), reason=F.coalesce("reason", F.lit("")), selected=F.to_json("selected"), snapshot_id=F.lit(snapshot)
    )
    runs = parts.runs.join(query_hash(requests), "query_id").withColumn("tenant_id", F.lit(tenant_id)).withColumn("run_id", run_id).withColumn("body", body)
    runs = runs.withColumns({"content_hash": F.sha2("body", 256), "snapshot_id": F.lit(snapshot), "created_at": F.lit(now).cast("long"), "expires_at": F.lit(now + keep_seconds).cast("long")})
    heads = catalog.heads(*TABLES)
    known = stored(catalog, "retrieval_runs", heads["retrieval_runs"]).select(*key, c("content_hash").alias("__stored"))
    outcome = F.when(c("__stored").isNull(), "stored").when(c("__stored") == c("content_hash"), "known").otherwise("conflict")
    runs = checkpoint(runs.join(known, key, "left").withColumn("outcome", outcome))
    fresh = runs.where("outcome = 'stored'")
    if not fresh.isEmpty():
        ids = fresh.select(*key, "query_id")
        of = lambda rows: rows.join(ids, "query_id")
        columns = lambda t: [f.name for f in T.StructType.fromDDL(TABLES[t]).fields]
        catalog.commit({
            "retrieval_runs": fresh.select(*columns("retrieval_runs")), "run_hits": of(parts.hits).select(*columns("run_hits")),
            "run_gates": of(parts.gated.select("query_id", "version_id", "eligible", "advisory", gates.codes(c("rejections")).alias("codes"))).select(*columns("run_gates")),
            "run_ranks": of(parts.order).select(*columns("run_ranks")),
        }, heads)
    return runs.select("query_id", "run_id", "outcome")


def answer(catalog: Catalog, tenant_id: str, requests: DataFrame, snapshot: str, serve, now: int) -> DataFrame:
    """Answer a batch: requests that this snapshot has answered before get the stored answer, byte for byte, the others go
    through serve(requests) and are stored -> query_id, run_id, replayed, body."""
    told = query_hash(requests).withColumn("snapshot_id", F.lit(snapshot))
    live = stored(catalog, "retrieval_runs").where((F.col("tenant_id") == tenant_id) & (F.col("expires_at") > now)).select("query_id", "query_hash", "snapshot_id", "run_id", "body")
    found = checkpoint(told.join(live, ["query_id", "query_hash", "snapshot_id"]).select("query_id", "run_id", "body"))
    rest = checkpoint(requests.join(found, "query_id", "left_anti"))
    out = found.withColumn("replayed", F.lit(True))
    if not rest.isEmpty():
        ids = record(catalog, tenant_id, rest, serve(rest), snapshot, now)
        bodies = stored(catalog, "retrieval_runs").where(F.col("tenant_id") == tenant_id).select("run_id", "body")
        out = out.unionByName(ids.select("query_id", "run_id").join(bodies, "run_id").withColumn("replayed", F.lit(False)))
    return out.select("query_id", "run_id", "replayed", "body")


def explain(catalog: Catalog, tenant_id: str, wanted: DataFrame) -> DataFrame:
    """wanted(run_id) -> run_id, disposition, reason, version_id, hits (channel, rank, score), eligible, codes, rank, final,
    selected: one record per candidate with all that was decided about it; runs without candidates have one with nulls."""
    mine = lambda t: stored(catalog, t).where(F.col("tenant_id") == tenant_id).drop("tenant_id", "epoch").join(wanted.select("run_id").distinct(), "run_id", "left_semi")
    hits = mine("run_hits").groupBy("run_id", "version_id").agg(F.array_sort(F.collect_list(F.struct("channel", "rank", "score"))).alias("hits"))  # one per channel
    both = ["run_id", "version_id"]
    facts = hits.join(mine("run_gates"), both, "left").join(mine("run_ranks"), both, "left")
    return mine("retrieval_runs").select("run_id", "disposition", "reason").join(facts, "run_id", "left").select("run_id", "disposition", "reason", "version_id", "hits", "eligible", "codes", "rank", "final", "selected")


def tampered(catalog: Catalog, tenant_id: str) -> DataFrame:
    """run_id, reason: stored runs that no longer hold: text against hash, ranks that are not 1 .. n, or selected versions that
    have no eligible gate."""
    mine = lambda t: stored(catalog, t).where(F.col("tenant_id") == tenant_id)
    runs = mine("retrieval_runs")
    body = runs.where(F.sha2("body", 256) != F.col("content_hash")).select("run_id", F.lit("content_hash_mismatch").alias("reason"))
    ranks = mine("run_ranks").groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("kinds"), F.min("rank").alias("least"), F.max("rank").alias("most"))
    loose = ranks.where("least <> 1 OR most <> n OR kinds <> n").select("run_id", F.lit("ranks_not_gapless").alias("reason"))
    chosen = runs.select("run_id", F.explode("selected").alias("version_id"))
    bare = chosen.join(mine("run_gates").where("eligible").select("run_id", "version_id"), ["run_id", "version_id"], "left_anti").select("run_id", F.lit("selected_without_gate").alias("reason"))
    return body.unionByName(loose).unionByName(bare).distinct()

