"""Erasure of a tenant from the archive and all tables, driven by a journal that a retry goes on from.

1. intent: the request is written down before anything happens. A tenant has one request, a request one tenant.
2. fence: the tenant's rows pass no write from now on, and no write that began earlier can be published.
3. archive: its objects are deleted and looked for again.
4. tables: one commit puts epochs without its rows in the places of those with them.
5. folders: what was replaced, and what was written and never published, is deleted once no reader's pin holds it.
6. receipt: what went, under the tenant's hash. The first receipt is the answer to every later call.

Every phase can be repeated; each has its entry in the journal, so a retry does only what is left."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.sources.tables import Catalog, ReadersHold, archive_count, archive_wipe, journal, journaled


class Erasure:
    """`journal_root` holds one folder per request and one file per tenant hash."""

    def __init__(self, catalog: Catalog, archive: str, journal_root: str, column: str = "tenant_id"):
        self.catalog, self.archive, self.root, self.column = catalog, archive, journal_root.rstrip("/"), column
        self.spark = catalog.spark

    def erase(self, request_id: str, tenant_id: str, now: int) -> dict:
        """The receipt. ReadersHold is raised while readers' pins hold folders with the tenant's rows: call again later."""
        tenant_hash = hashlib.sha256(tenant_id.encode()).hexdigest()
        done = journaled(self.spark, f"{self.root}/{request_id}", "receipt")
        if done is not None:
            if done["tenant_hash"] != tenant_hash:
                raise ValueError(f"{request_id} was for another tenant")
            return done
        self.intend(request_id, tenant_id, tenant_hash)
        fence = self.fence(request_id, tenant_id)
        objects = self.clear_archive(request_id, tenant_id)
        rows = self.clear_tables(request_id, tenant_id)
        self.clear_folders(request_id, fence, now)
        archive_wipe(self.spark, self.archive, tenant_id)  # a write that the fence stopped may have put objects since
        body = {"archive_objects": objects, "completed_at": now, "request_id": request_id, "rows": rows, "tenant_hash": tenant_hash}
        receipt = body | {"content_hash": canonical.identity(body)}
        journal(self.spark, f"{self.root}/{request_id}", "receipt", receipt)
        return receipt

    def intend(self, request_id: str, tenant_id: str, tenant_hash: str) -> None:
        """Both files are written before anything is erased; either with another body is a conflict."""
        journal(self.spark, f"{self.root}/tenants", tenant_hash, {"request_id": request_id})
        journal(self.spark, f"{self.root}/{request_id}", "intent", {"request_id": request_id, "tenant_id": tenant_id})

    def fence(self, request_id: str, tenant_id: str) -> int:
        """The number of fences that a writer must know from now on."""
        seen = self.catalog.head("_fences")
        known = self.catalog.fences().where(F.col("tenant_id") == tenant_id)
        if known.isEmpty():
            row = self.spark.createDataFrame([(tenant_id, request_id)], "tenant_id string, request_id string")
            self.catalog.append("_fences", row, expected=seen)
        at = self.catalog.read("_fences").where(F.col("tenant_id") == tenant_id).agg(F.min("epoch").alias("e")).first().e
        journal(self.spark, f"{self.root}/{request_id}", "fence", {"epoch": at})
        return at

    def clear_archive(self, request_id: str, tenant_id: str) -> int:
        where = f"{self.root}/{request_id}"
        done = journaled(self.spark, where, "archive")
        if done is None:
            done = journaled(self.spark, where, "archive-plan")
            if done is None:
                done = {"objects": archive_count(self.spark, self.archive, tenant_id)}
                journal(self.spark, where, "archive-plan", done)
            if not archive_wipe(self.spark, self.archive, tenant_id):
                raise RuntimeError("archived objects are still there")
            journal(self.spark, where, "archive", done)
        return done["objects"]

    def clear_tables(self, request_id: str, tenant_id: str) -> dict[str, int]:
        """Rows that went, by table. They are written down before the commit that hides them."""
        where = f"{self.root}/{request_id}"
        done = journaled(self.spark, where, "tables")
        if done is None:
            planned = journaled(self.spark, where, "tables-plan")
            if planned is None:
                planned = {"rows": self.count(tenant_id)}
                journal(self.spark, where, "tables-plan", planned)
            self.catalog.finish_rewrites(0)  # what an earlier attempt wrote and did not publish
            for kind, tables in self.by_type():
                gone = self.spark.range(1).select(F.lit(tenant_id).try_cast(kind).alias(self.column))
                self.catalog.rewrite(f"{request_id}-{uuid.uuid4().hex}", tables, self.column, gone)
            if left := self.count(tenant_id):
                raise RuntimeError(f"rows are still there: {left}")
            journal(self.spark, where, "tables", planned)
            done = planned
        return done["rows"]

    def by_type(self) -> list[tuple[str, list[str]]]:
        """Tables with the tenant's column, by its type."""
        found: dict[str, list[str]] = {}
        for table in self.catalog.tables():
            types = dict(self.catalog.read(table).dtypes)
            if self.column in types:
                found.setdefault(types[self.column], []).append(table)
        return sorted(found.items())

    def count(self, tenant_id: str) -> dict[str, int]:
        """The tenant's visible rows in each table that has any; an aggregate over the column alone."""
        rows: list[DataFrame] = [
            self.catalog.read(t).where(F.col(self.column).cast("string") == tenant_id).groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for _, tables in self.by_type() for t in tables
        ]
        return {r.table: r.n for one in rows for r in one.collect() if r.n}  # one row per table

    def clear_folders(self, request_id: str, fence: int, now: int) -> None:
        if journaled(self.spark, f"{self.root}/{request_id}", "folders") is None:
            if self.catalog.finish_rewrites(now):
                raise ReadersHold("readers still hold folders with the tenant's rows")
            self.catalog.drop_unpublished(fence)
            journal(self.spark, f"{self.root}/{request_id}", "folders", {"fence": fence})

    def resume(self, now: int) -> list[dict]:
        """Receipts of all requests in the journal, unfinished ones brought to their end: after a restart."""
        out = []
        for request_id in Catalog(self.spark, self.root)._names(""):
            entry = journaled(self.spark, f"{self.root}/{request_id}", "intent")
            if entry is not None:
                out.append(self.erase(request_id, entry["tenant_id"], now))
        return out
