"""Versioned reads, queues, retention, ledgers, audits: operators over tables that only ever grow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the values of a group are dealt.
PERCENTILE_RANGES = 1024

# --- snapshots ---------------------------------------------------------------------------------------------------


def latest_as_of(rows: DataFrame, key: list[str], epoch: str, at: Column) -> DataFrame:
    """Per key the row with the greatest epoch not after `at`. One aggregate with a map-side maximum; no window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.where(F.col(epoch) <= at).groupBy(*key).agg(F.max_by(F.struct(*rest), epoch).alias("__r"))
    return best.select(*key, "__r.*")


def stale(rows: DataFrame, key: str, epoch: str) -> DataFrame:
    """Rows that are not at their key's greatest epoch."""
    newest = rows.groupBy(key).agg(F.max(epoch).alias("__e"))
    return rows.join(newest, key).where(F.col(epoch) < F.col("__e")).drop("__e")


# --- sets --------------------------------------------------------------------------------------------------------


def digest_difference(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """id, reason: what keeps a rebuilt table (id, digest) from taking the stored one's place; empty is a permit."""
    s, r = stored.select("id", F.col("digest").alias("a")), rebuilt.select("id", F.col("digest").alias("b"))
    reason = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return s.join(r, "id", "full").withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")


def conflicting(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value: what may be collapsed only where this is empty."""
    return rows.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.count("*").alias("n")).where("least <> greatest")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def idempotent(rows: DataFrame, key: list[str], content: str, order: list[str]) -> DataFrame:
    """Plus status: accepted for the first row of a key, duplicate for the same content again, conflict for other."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.first(content).over(w)
    n = F.row_number().over(w)
    return rows.withColumn("status", F.when(n == 1, "accepted").when(F.col(content) == first, "duplicate").otherwise("conflict"))


def without_fenced(rows: DataFrame, fences: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Rows of tenants that are not being erased: before every write."""
    return rows.join(fences.select(tenant).distinct(), tenant, "left_anti")


# --- queues ------------------------------------------------------------------------------------------------------


def claimable(now: Column) -> Column:
    pending = (F.col("state") == "pending") & (F.col("available_at") <= now)
    return pending | ((F.col("state") == "leased") & (F.col("lease_expires_at") <= now))


def claim(queue: DataFrame, now: Column, owner: str, lease_seconds: int, limit: int) -> DataFrame:
    """The first `limit` rows that are due or whose lease ran out, leased to `owner` under the next generation."""
    due = queue.where(claimable(now)).orderBy("available_at", "created_at", "job_id").limit(limit)
    return due.withColumns({
        "state": F.lit("leased"), "owner": F.lit(owner), "generation": F.col("generation") + 1,
        "attempts": F.col("attempts") + 1, "lease_expires_at": now + lease_seconds,
    })


def settle(queue: DataFrame, results: DataFrame, now: Column, most_attempts: int, most_backoff: int) -> DataFrame:
    """queue with results(job_id, owner, generation, ok) applied: only the owner of the current generation counts.
    Success completes; failure waits 2^(attempts-1) seconds, or is dead after most_attempts."""
    r = results.select("job_id", F.col("owner").alias("__o"), F.col("generation").alias("__g"), "ok")
    q = queue.join(r, "job_id", "left")
    own = F.coalesce((F.col("state") == "leased") & (F.col("owner") == F.col("__o")) & (F.col("generation") == F.col("__g")), F.lit(False))
    wait = F.least(F.pow(F.lit(2), F.col("attempts") - 1), F.lit(most_backoff)).cast("long")
    failed = own & ~F.col("ok")
    state = F.when(own & F.col("ok"), "completed").when(failed & (F.col("attempts") >= most_attempts), "dead_letter").when(failed, "pending").otherwise(F.col("state"))
    return q.withColumn("available_at", F.when(failed, now + wait).otherwise(F.col("available_at"))).withColumn("state", state).drop("__o", "__g", "ok")


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.where("state = 'pending'").groupBy("kind").agg(F.count("*").alias("pending"), F.min("available_at").alias("oldest"))


def expire(rows: DataFrame, cutoff: Column, limit: int, key: str) -> DataFrame:
    """rows without the `limit` that expired first. The limit is the feature: a sweep deletes a bounded batch."""
    gone = rows.where(F.col("expires_at") <= cutoff).orderBy("expires_at", key).limit(limit).select(key)
    return rows.join(gone, key, "left_anti")


# --- ledgers and audits ------------------------------------------------------------------------------------------


def ledger_heads(ledger: DataFrame, key: list[str], now: Column) -> DataFrame:
    """The latest judgment of each key and whether it may still be used."""
    rest = [c for c in ledger.columns if c not in key]
    head = ledger.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("created_at", "judgment_id")).alias("__r")).select(*key, "__r.*")
    return head.withColumn("reusable", F.col("expires_at") > now)


def gaps_in_positions(events: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose positions are not 0 .. n-1, each once."""
    found = events.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(position).alias("kinds"), F.min(position).alias("first"), F.max(position).alias("last"))
    return found.where("first <> 0 OR last + 1 <> n OR kinds <> n")


def percentile_at_floor(rows: DataFrame, key: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """The element at floor((n - 1) * q) of the sorted values, exact, without gathering a group's rows. Equal values are
    counted before the shuffle, different ones are dealt into ranges, and two running sums (over the ranges of a group,
    then inside the ranges that hold a wanted position) lead to the wanted values."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("__c"))
    limits = counts.groupBy(*key).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("__c").alias("__n"))
    share = (F.col(value).cast("double") - F.col("__low").cast("double")) / F.greatest(F.col("__high").cast("double") - F.col("__low").cast("double"), F.lit(1e-300))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    named = limits.select(*[F.col(k).alias(f"__{k}") for k in key], "__low", "__high", "__n")
    dealt = counts.join(named, reduce(lambda a, b: a & b, same)).select(*key, value, "__c", "__n", F.floor(share * PERCENTILE_RANGES).alias("__range"))
    ranges = dealt.groupBy(*key, "__range").agg(F.sum("__c").alias("__rc"))
    order = Window.partitionBy(*key).orderBy("__range")
    before = ranges.withColumn("__before", F.sum("__rc").over(order) - F.col("__rc"))
    before = before.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__range").alias("__r"), "__before", "__rc")
    at = [F.floor((F.col("__n") - 1) * q) for q in quantiles]
    wanted = reduce(lambda a, b: a | b, [(x >= F.col("__before")) & (x < F.col("__before") + F.col("__rc")) for x in at])
    near = dealt.join(before, reduce(lambda a, b: a & b, [*same, F.col("__range") == F.col("__r")])).where(wanted)
    inside = Window.partitionBy(*key, "__range").orderBy(value)
    near = near.withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
    hit = lambda x: (x < F.col("__end")) & (x >= F.col("__end") - F.col("__c"))
    return near.groupBy(*key).agg(*[F.max(F.when(hit(x), F.col(value))).alias(f"p{round(q * 100)}") for x, q in zip(at, quantiles, strict=True)])
