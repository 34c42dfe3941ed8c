"""A stored queue whose leases are transactions.

The queue is a table of the catalog that only grows: every change of a job is a new row, and a job is what its newest
row says. A claim reads the queue as of a head, and is published only if the head is still the same: of two claimers at
once one publishes, the other reads again and takes other jobs. A lease carries a generation; results count only under
the owner and generation that hold the lease, so a worker that was too slow changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators import tables
from tracewright.sources.tables import Catalog, checkpoint

JOB = "tenant_id STRING, job_id STRING, kind STRING, state STRING, available_at BIGINT, created_at BIGINT, owner STRING, generation INT, lease_expires_at BIGINT, attempts INT, error STRING"
COLUMNS = [f.split()[0] for f in JOB.split(", ")]
#: How often a change is tried again when another writer was first.
TRIES = 8


class Queue:
    def __init__(self, catalog: Catalog, table: str = "queue"):
        self.catalog, self.table = catalog, table

    def jobs(self, as_of: int | None = None) -> DataFrame:
        """Every job as its newest row says; one aggregate, combined before the shuffle."""
        rows = self.catalog.read(self.table, as_of, T.StructType.fromDDL(JOB))
        return tables.latest_as_of(rows, ["tenant_id", "job_id"], "epoch", F.lit(1 << 62)).select(*COLUMNS)

    def _change(self, change) -> DataFrame:
        """Publish the rows that change(jobs as of the head) gives, or try again if another writer was first."""
        for _ in range(TRIES):
            head = self.catalog.head(self.table)
            rows = checkpoint(change(self.jobs(head)))
            changed = rows.where("__changed").select(*COLUMNS)
            if changed.isEmpty():
                return rows
            try:
                self.catalog.append(self.table, changed, expected=head)
                return rows
            except RuntimeError:
                if self.catalog.head(self.table) == head:
                    raise
        raise RuntimeError(f"{self.table}: another writer was first {TRIES} times")

    def add(self, jobs: DataFrame) -> DataFrame:
        """jobs(tenant_id, job_id, kind, available_at, created_at) -> plus added: those whose id was not there yet."""
        none = {"owner": "string", "lease_expires_at": "long", "error": "string"}
        fresh = jobs.dropDuplicates(["tenant_id", "job_id"]).select(
            "tenant_id", "job_id", "kind", F.lit("pending").alias("state"), F.col("available_at").cast("long").alias("available_at"), F.col("created_at").cast("long").alias("created_at"),
            F.lit(0).alias("generation"), F.lit(0).alias("attempts"), *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()),
        )

        def change(now: DataFrame) -> DataFrame:
            known = now.select("tenant_id", "job_id", F.lit(True).alias("__known"))
            return fresh.join(known, ["tenant_id", "job_id"], "left").withColumn("__changed", F.col("__known").isNull()).drop("__known")

        return self._change(change).select("tenant_id", "job_id", F.col("__changed").alias("added"))

    def claim(self, owner: str, now: int, lease_seconds: int, limit: int, kinds: list[str] | None = None) -> DataFrame:
        """The first `limit` due jobs of the given kinds, leased to `owner`: no job is handed out twice while its lease
        holds. The limit is the feature: a worker takes a bounded batch."""

        def change(jobs: DataFrame) -> DataFrame:
            wanted = jobs if kinds is None else jobs.where(F.col("kind").isin(kinds))
            due = wanted.where(tables.claimable(F.lit(now))).orderBy("available_at", "created_at", "tenant_id", "job_id").limit(limit)
            return due.withColumns({
                "state": F.lit("leased"), "owner": F.lit(owner), "generation": F.col("generation") + 1, "attempts": F.col("attempts") + 1,
                "lease_expires_at": F.lit(now + lease_seconds).cast("long"), "__changed": F.lit(True),
            })

        return self._change(change).select(*COLUMNS)

    def settle(self, results: DataFrame, now: int, most_attempts: int = 8, most_backoff: int = 300) -> DataFrame:
        """results(tenant_id, job_id, owner, generation, ok, error) -> tenant_id, job_id, outcome: completed, pending again
        (after a wait that doubles with each attempt), dead_letter (stored with its error, never claimed again) or
        stale_lease: the lease was lost, or another result was given under it. Repeating a result changes nothing."""
        given = checkpoint(results.select("tenant_id", "job_id", F.col("owner").alias("__o"), F.col("generation").alias("__g"), "ok", F.col("error").alias("__e")).dropDuplicates(["tenant_id", "job_id"]))

        def change(jobs: DataFrame) -> DataFrame:
            q, c = jobs.join(given, ["tenant_id", "job_id"], "right"), F.col
            mine = F.coalesce((c("owner") == c("__o")) & (c("generation") == c("__g")), F.lit(False))
            held = mine & (c("state") == "leased") & (c("lease_expires_at") > now)
            target = F.when(c("ok"), "completed").when(c("attempts") >= most_attempts, "dead_letter").otherwise("pending")
            wait = F.least(F.pow(F.lit(2), c("attempts") - 1), F.lit(most_backoff)).cast("long")
            again = mine & (c("state") == target)
            q = q.withColumns({"__changed": held, "outcome": F.when(held | again, target).otherwise("stale_lease"), "error": F.when(held, c("__e")).otherwise(c("error"))})
            q = q.withColumn("available_at", F.when(held & (target == "pending"), F.lit(now) + wait).otherwise(c("available_at")))
            lease = lambda name: F.when(held, F.lit(None)).otherwise(c(name)).alias(name)
            return q.select(*(F.when(held, target).otherwise(c("state")).alias("state") if x == "state" else lease(x) if x == "lease_expires_at" else x for x in COLUMNS), "outcome", "__changed")

        return self._change(change).select("tenant_id", "job_id", "outcome")

    def dead_letters(self) -> DataFrame:
        return self.jobs().where("state = 'dead_letter'").select("tenant_id", "job_id", "kind", "attempts", "error")

    def revive(self, which: Column, now: int) -> DataFrame:
        """Dead letters that are to be tried again, with no attempts behind them."""

        def change(jobs: DataFrame) -> DataFrame:
            dead = jobs.where(F.col("state") == "dead_letter").where(which)
            return dead.withColumns({"state": F.lit("pending"), "attempts": F.lit(0), "available_at": F.lit(now).cast("long"), "__changed": F.lit(True)})

        return self._change(change).select("tenant_id", "job_id")
