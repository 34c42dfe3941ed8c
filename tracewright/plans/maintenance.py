"""Maintenance: jobs of six kinds, claimed from the stored queue and handed to one handler per kind in batches.

A handler takes the claimed jobs of its kind, does its work once for all of them, and says by (tenant_id, job_id) which
failed and why; all others are done. Handlers may be run again for a job whose lease ran out, so each is idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import canonical
from tracewright.operators import evidence, tables
from tracewright.operators.leases import Queue
from tracewright.plans import ingest, runs
from tracewright.sources.tables import Catalog, checkpoint

KINDS = ("compatibility_projection", "exposure_aggregation", "lifecycle_evaluation", "lifecycle_rollback", "projection_rebuild", "transient_expiry")
#: Failures of a handler, keyed like jobs.
FAILED = "tenant_id STRING, job_id STRING, error STRING"
Handler = Callable[[DataFrame, int], DataFrame | None]


def run_once(queue: Queue, handlers: dict[str, Handler], owner: str, now: int, limit: int = 32, lease_seconds: int = 30) -> dict[str, int]:
    """Claim due jobs of all kinds with a handler, run each kind's batch, settle -> number of jobs by outcome. What a handler
    raises counts as a failure of its batch, and of no other."""
    leased, counts = queue.claim(owner, now, lease_seconds, limit, sorted(handlers)), {}
    for kind in [r.kind for r in leased.select("kind").distinct().orderBy("kind").collect()]:  # six kinds
        own = leased.where(F.col("kind") == kind)
        try:
            failed = handlers[kind](own, now)
        except Exception as e:  # noqa: BLE001
            failed = own.select("tenant_id", "job_id", F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
        if failed is None:
            failed = own.sparkSession.createDataFrame([], FAILED)
        told = own.join(failed.select("tenant_id", "job_id", F.col("error").alias("__error")), ["tenant_id", "job_id"], "left")
        results = told.select("tenant_id", "job_id", "owner", "generation", F.col("__error").isNull().alias("ok"), F.col("__error").alias("error"))
        for r in queue.settle(results, now).groupBy("outcome").count().collect():
            counts[r.outcome] = counts.get(r.outcome, 0) + r["count"]
    return counts


def of_tenants(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """failures(tenant_id, error) as failures of those tenants' jobs."""
    return jobs.select("tenant_id", "job_id").join(failures.groupBy("tenant_id").agg(F.min("error").alias("error")), "tenant_id")


# --- transient expiry --------------------------------------------------------------------------------------------


def expire_runs(catalog: Catalog, most: int = 100_000) -> Handler:
    """Stored runs whose time is over go from all run tables in one commit, the `most` oldest of a sweep."""

    def handle(jobs: DataFrame, now: int) -> None:
        live = runs.stored(catalog, "retrieval_runs").join(jobs.select("tenant_id").distinct(), "tenant_id", "left_semi")
        gone = checkpoint(live.where(F.col("expires_at") <= now).orderBy("expires_at", "run_id").limit(most).select("run_id"))
        catalog.finish_rewrites(now)
        catalog.rewrite(f"expiry-{now}-{canonical.identity(sorted(r.job_id for r in jobs.select('job_id').collect()))[:16]}", list(runs.TABLES), "run_id", gone)
        catalog.finish_rewrites(now)

    return handle


# --- lifecycle ---------------------------------------------------------------------------------------------------


def evaluate_lifecycle(catalog: Catalog, families: DataFrame | None = None) -> Handler:
    return lambda jobs, now: ingest.promote(catalog, now, families=families).limit(0).select(F.lit("").alias("tenant_id"), F.lit("").alias("job_id"), F.lit("").alias("error"))


def roll_back(catalog: Catalog, families: DataFrame | None = None) -> Handler:
    """An evaluation that must take at least one version out of active service; nothing to roll back is a failure."""

    def handle(jobs: DataFrame, now: int) -> DataFrame | None:
        fell = ingest.promote(catalog, now, families=families).where("prior_state = 'active' AND next_state <> 'active'")
        return jobs.select("tenant_id", "job_id", F.lit("nothing_to_roll_back").alias("error")) if fell.isEmpty() else None

    return handle


# --- exposure ----------------------------------------------------------------------------------------------------


def audit_exposure(assignments: DataFrame, budgets: DataFrame) -> Handler:
    """budgets(tenant_id, window_start, exposures, unsafe) must equal the counters of the assignments."""

    def handle(jobs: DataFrame, now: int) -> DataFrame:
        told = evidence.exposure(assignments).where("is_global = 0").drop("is_global")
        key = ["tenant_id", "window_start"]
        both = told.join(budgets.select(*key, F.col("exposures").alias("__e"), F.col("unsafe").alias("__u")), key, "full")
        wrong = both.where(~(F.col("exposures").eqNullSafe(F.col("__e")) & F.col("unsafe").eqNullSafe(F.col("__u"))))
        return of_tenants(jobs, wrong.select("tenant_id", F.concat(F.lit("exposure_mismatch:"), "window_start").alias("error")))

    return handle


# --- projections -------------------------------------------------------------------------------------------------

PROJECTION = "tenant_id STRING, id STRING, body STRING, digest STRING"


def projection(rows: DataFrame) -> DataFrame:
    """rows(tenant_id, id, body) with the digest that a comparison goes by."""
    return rows.select("tenant_id", "id", "body", F.sha2("body", 256).alias("digest"))


def active(catalog: Catalog, table: str) -> DataFrame:
    """The rows of the generation that each tenant's head names, and no others: readers never see half of a swap."""
    heads = catalog.read(f"{table}_heads", schema=T.StructType.fromDDL("tenant_id STRING, generation STRING, set_hash STRING"))
    heads = tables.latest_as_of(heads, ["tenant_id"], "epoch", F.lit(1 << 62)).select("tenant_id", "generation")
    rows = catalog.read(table, schema=T.StructType.fromDDL(PROJECTION + ", generation STRING"))
    return rows.join(heads, ["tenant_id", "generation"]).select("tenant_id", "id", "body", "digest", "generation")


def set_hash(rows: DataFrame) -> DataFrame:
    """tenant_id, set_hash: over the number of rows and the sum of their digests, in any order, without gathering them."""
    part = lambda i: F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy("tenant_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(part(i).cast("string") for i in range(4))), 256).alias("set_hash"))


def publish(catalog: Catalog, table: str, rows: DataFrame, generation: str) -> dict[str, int]:
    """Rows of a new generation and the heads that name it, in one commit."""
    told = checkpoint(projection(rows).withColumn("generation", F.lit(generation)))
    return catalog.commit({table: told, f"{table}_heads": set_hash(told).withColumn("generation", F.lit(generation)).select("tenant_id", "generation", "set_hash")}, catalog.heads(table, f"{table}_heads"))


def rebuild(catalog: Catalog, table: str, build: Callable[[], DataFrame], generation: str) -> Handler:
    """A shadow build takes the place of the stored projection only if it holds the same rows; a tenant whose rows differ
    gets no permit, and keeps the old generation."""

    def handle(jobs: DataFrame, now: int) -> DataFrame:
        mine = jobs.select("tenant_id").distinct()
        fresh = checkpoint(projection(build()).join(mine, "tenant_id", "left_semi"))
        held = active(catalog, table).join(mine, "tenant_id", "left_semi")
        named = lambda rows: rows.select(F.to_json(F.struct("tenant_id", "id")).alias("id"), "digest")
        wrong = checkpoint(tables.digest_difference(named(held), named(fresh)).select(F.get_json_object("id", "$.tenant_id").alias("tenant_id"), F.concat_ws(":", "reason", F.get_json_object("id", "$.id")).alias("error")))
        permitted = fresh.join(wrong.select("tenant_id").distinct(), "tenant_id", "left_anti")
        if not permitted.isEmpty():
            publish(catalog, table, permitted.select("tenant_id", "id", "body"), generation)
        return of_tenants(jobs, wrong)

    return handle


# --- compatibility graphs ----------------------------------------------------------------------------------------

GRAPHS = {
    "graphs": "tenant_id STRING, graph_id STRING, epoch_no BIGINT, planner STRING, policy STRING, content_hash STRING",
    "graph_edges": "tenant_id STRING, graph_id STRING, src STRING, dst STRING, kind STRING",
}
IDENTITY = ["tenant_id", "epoch_no", "planner", "policy"]


def graph_hash(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, content_hash over the distinct edges in any order, not gathered."""
    one = edges.select(*key, "src", "dst", "kind").distinct().withColumn("digest", F.sha2(F.to_json(F.struct("src", "dst", "kind")), 256))
    part = lambda i: F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return one.groupBy(*key).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(part(i).cast("string") for i in range(4))), 256).alias("content_hash"))


def publish_graphs(catalog: Catalog, edges: DataFrame) -> DataFrame:
    """edges(tenant_id, epoch_no, planner, policy, src, dst, kind) -> one row per graph: IDENTITY, graph_id, outcome: stored,
    known (the same edges are there) or conflict (others are, and stay). A graph is named by what it is for and its edges."""
    c = F.col
    heads = catalog.heads(*GRAPHS)
    known = catalog.read("graphs", heads["graphs"], T.StructType.fromDDL(GRAPHS["graphs"])).select(*IDENTITY, c("content_hash").alias("__stored"))
    graph_id = F.concat(F.lit("graph_"), F.sha2(F.concat_ws("\0", *IDENTITY, "content_hash"), 256))
    outcome = F.when(c("__stored").isNull(), "stored").when(c("__stored") == c("content_hash"), "known").otherwise("conflict")
    told = checkpoint(graph_hash(edges, IDENTITY).join(known, IDENTITY, "left").withColumn("outcome", outcome).withColumn("graph_id", graph_id))
    fresh = told.where("outcome = 'stored'")
    if not fresh.isEmpty():
        rows = edges.join(fresh.select(*IDENTITY, "graph_id"), IDENTITY).select("tenant_id", "graph_id", "src", "dst", "kind").distinct()
        catalog.commit({"graphs": fresh.select("tenant_id", "graph_id", "epoch_no", "planner", "policy", "content_hash"), "graph_edges": rows}, heads)
    return told.select(*IDENTITY, "graph_id", "outcome")


def read_graphs(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """(edges of graphs that hold, graph_id and reason of those that do not): every graph is hashed again after reading."""
    graphs = catalog.read("graphs", schema=T.StructType.fromDDL(GRAPHS["graphs"])).drop("epoch")
    edges = catalog.read("graph_edges", schema=T.StructType.fromDDL(GRAPHS["graph_edges"])).drop("epoch")
    again = graph_hash(edges, ["tenant_id", "graph_id"]).withColumnRenamed("content_hash", "__again")
    told = checkpoint(graphs.join(again, ["tenant_id", "graph_id"], "full"))
    named = F.concat(F.lit("graph_"), F.sha2(F.concat_ws("\0", *IDENTITY, "content_hash"), 256))
    reason = F.when(F.col("content_hash").isNull(), "edges_without_graph").when(~F.col("content_hash").eqNullSafe(F.col("__again")), "edges_changed").when(named != F.col("graph_id"), "graph_renamed")
    bad = told.withColumn("reason", reason).where("reason IS NOT NULL").select("tenant_id", "graph_id", "reason")
    good = graphs.join(bad, ["tenant_id", "graph_id"], "left_anti")
    return good.join(edges, ["tenant_id", "graph_id"]), bad


def project_compatibility(catalog: Catalog, edges: DataFrame) -> Handler:
    """Publish the graphs of the jobs' tenants; one that would replace another is a failure."""

    def handle(jobs: DataFrame, now: int) -> DataFrame:
        told = publish_graphs(catalog, edges.join(jobs.select("tenant_id").distinct(), "tenant_id", "left_semi"))
        return of_tenants(jobs, told.where("outcome = 'conflict'").select("tenant_id", F.concat(F.lit("graph_conflict:"), "epoch_no").alias("error")))

    return handle
