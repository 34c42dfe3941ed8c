"""The engine's concepts over the driver's tables: what stands in for documents, queries, facts, traces and queues.

Each adapter has its SQL beside it, so that a query's SQL starts from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.sources.tables import read

HARNESSES = ("en", "fr", "de", "es")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    c = F.col
    return d.select(
        c("doc_id").alias("version_id"), c("text").alias("task"), c("lang").alias("harness"), c("source").alias("environment"),
        F.array_distinct(F.array(F.concat(F.lit("tool"), c("doc_id") % 7), F.concat(F.lit("tool"), c("n_chars") % 5))).alias("contracts"),
        F.concat_ws(":", "source", "lang", F.floor(c("n_chars") / 1000)).alias("intent"), F.concat_ws(":", "lang", c("n_chars") % 2).alias("effect"),
        F.when(c("n_chars") < 1000, 1).when(c("n_chars") < 4000, 2).when(c("n_chars") < 10000, 3).otherwise(4).alias("risk"),
        F.when((c("quality") == 1) & (c("toxic") == 0), "active").when(c("quality") == 1, "quarantined").when(c("quality") == 0, "candidate").otherwise("trial").alias("lifecycle"),
        c("quality"), c("toxic"), c("n_chars"),
    )


DOCUMENTS = """docs AS (
  SELECT doc_id AS version_id, text AS task, lang AS harness, source AS environment,
    list_distinct(['tool' || (doc_id % 7), 'tool' || (n_chars % 5)]) AS contracts,
    source || ':' || lang || ':' || (n_chars // 1000) AS intent, lang || ':' || (n_chars % 2) AS effect,
    CASE WHEN n_chars < 1000 THEN 1 WHEN n_chars < 4000 THEN 2 WHEN n_chars < 10000 THEN 3 ELSE 4 END AS risk,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'active' WHEN quality = 1 THEN 'quarantined' WHEN quality = 0 THEN 'candidate' ELSE 'trial' END AS lifecycle,
    quality, toxic, n_chars
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    q, c = read(spark, sf, "benchmark"), F.col
    harness = F.element_at(F.array(*map(F.lit, HARNESSES)), (c("item_id") % 4 + 1).cast("int"))
    environment = F.concat(F.lit("src"), c("item_id") % 20)
    return q.select(
        c("item_id").alias("query_id"), c("text").alias("task"), harness.alias("harness"), environment.alias("environment"),
        F.array_distinct(F.array(F.concat(F.lit("tool"), c("item_id") % 7), F.concat(F.lit("tool"), c("item_id") % 5))).alias("contracts"),
        F.concat_ws(":", environment, harness, c("item_id") % 5).alias("intent"),
    )


REQUESTS = """requests AS (
  SELECT item_id AS query_id, text AS task, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS harness, 'src' || (item_id % 20) AS environment,
    list_distinct(['tool' || (item_id % 7), 'tool' || (item_id % 5)]) AS contracts,
    'src' || (item_id % 20) || ':' || ['en', 'fr', 'de', 'es'][item_id % 4 + 1] || ':' || (item_id % 5) AS intent
  FROM benchmark
)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """events as evidence: a user's day is an outcome, the value's hundreds are the class, the type is the verdict."""
    c = F.col
    k = F.get_json_object("props", "$.k").cast("long")
    rank = F.least(F.floor(c("value") / 100) + 1, F.lit(5)).cast("int")
    verdict = F.when(c("event_type").isin("purchase", "signup"), "satisfied").when(c("event_type") == "error", "failed").otherwise("unknown")
    from tracewright.operators.evidence import CLASSES

    return read(spark, sf, "events").select(
        c("event_id").alias("evidence_id"), (c("user_id") * 100 + F.dayofmonth("ts")).cast("long").alias("outcome_id"), c("user_id"), F.concat(F.lit("p"), k % 20).alias("predicate"),
        F.element_at(F.array(*map(F.lit, CLASSES)), rank).alias("class"), verdict.alias("verdict"), S.unix_seconds("ts").alias("observed_at"), k.alias("k"),
        c("event_type"), c("value"),
    )


FACTS = """facts AS (
  SELECT event_id AS evidence_id, user_id * 100 + day(ts) AS outcome_id, user_id, 'p' || (k % 20) AS predicate,
    CAST(least(floor(value / 100) + 1, 5) AS INTEGER) AS class_rank,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'satisfied' WHEN event_type = 'error' THEN 'failed' ELSE 'unknown' END AS verdict,
    CAST(floor(epoch(ts)) AS BIGINT) AS observed_at, k, event_type, value
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""


def accesses(spark: SparkSession, sf: str) -> DataFrame:
    """events as tool calls: a user is a trace, the id is the position, k names the resource."""
    f = facts(spark, sf)
    return f.select(
        F.col("user_id").alias("trace_id"), F.col("evidence_id").alias("position"), F.concat(F.lit("r"), F.col("k") % 12).alias("resource"),
        (F.col("event_type") != "signup").alias("reads"), F.col("event_type").isin("purchase", "click").alias("writes"), (F.col("event_type") != "error").alias("succeeded"),
        F.col("value"),
    )


ACCESSES = (
    FACTS
    + """, accesses AS (
  SELECT user_id AS trace_id, evidence_id AS position, 'r' || (k % 12) AS resource, event_type <> 'signup' AS reads,
    event_type IN ('purchase', 'click') AS writes, event_type <> 'error' AS succeeded, value
  FROM facts
)"""
)

EDGES = (
    ACCESSES
    + """, linked AS (
  SELECT *, last_value(CASE WHEN writes THEN position END IGNORE NULLS) OVER (PARTITION BY trace_id, resource ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer
  FROM accesses
), edges AS (
  SELECT DISTINCT trace_id, writer AS src, position AS dst, resource FROM linked WHERE reads AND writer IS NOT NULL
)"""
)


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """orders as jobs: O is pending, F is leased, P is completed; the priority is the kind."""
    c = F.col
    state = F.when(c("o_orderstatus") == "O", "pending").when(c("o_orderstatus") == "F", "leased").otherwise("completed")
    return read(spark, sf, "orders").select(
        c("o_orderkey").alias("job_id"), c("o_orderpriority").alias("kind"), state.alias("state"), S.unix_seconds("o_orderdate").alias("available_at"),
        (S.unix_seconds("o_orderdate") - c("o_custkey")).alias("created_at"), (S.unix_seconds("o_orderdate") + 86400 * (c("o_orderkey") % 30)).alias("lease_expires_at"),
        (c("o_orderkey") % 4).alias("attempts"), (c("o_orderkey") % 9).alias("generation"), F.concat(F.lit("w"), c("o_custkey") % 5).alias("owner"), c("o_custkey").alias("tenant_id"),
    )


QUEUE = """queue AS (
  SELECT o_orderkey AS job_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'leased' ELSE 'completed' END AS state,
    CAST(epoch(o_orderdate) AS BIGINT) AS available_at, CAST(epoch(o_orderdate) AS BIGINT) - o_custkey AS created_at,
    CAST(epoch(o_orderdate) AS BIGINT) + 86400 * (o_orderkey % 30) AS lease_expires_at, o_orderkey % 4 AS attempts, o_orderkey % 9 AS generation,
    'w' || (o_custkey % 5) AS owner, o_custkey AS tenant_id
  FROM orders
)"""

#: 1998-06-01 00:00:00 UTC, in the middle of the orders.
NOW = 896_659_200


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as credits: a supplier is a version, a returned line is a failure."""
    li, c = read(spark, sf, "lineitem"), F.col
    shipped = S.unix_seconds("l_shipdate")
    return li.groupBy(c("l_suppkey").alias("version_id")).agg(
        F.count_if(c("l_returnflag") != "R").alias("successes"), F.count_if(c("l_returnflag") == "R").alias("failures"), F.max(shipped).alias("latest_causal_at"), F.min(shipped).alias("trial_started_at")
    )


SUPPLIERS = """suppliers AS (
  SELECT l_suppkey AS version_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS successes, count(*) FILTER (WHERE l_returnflag = 'R') AS failures,
    CAST(max(epoch(l_shipdate)) AS BIGINT) AS latest_causal_at, CAST(min(epoch(l_shipdate)) AS BIGINT) AS trial_started_at
  FROM lineitem GROUP BY l_suppkey
)"""
