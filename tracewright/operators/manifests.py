"""Content-addressed configuration: frozen, validated, named by the hash of its canonical JSON."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import canonical
from tracewright.functions import scalars as S


def manifest_id(manifest, prefix: str) -> str:
    return canonical.identity(asdict(manifest), prefix)


@dataclass(frozen=True)
class Embedding:
    provider: str
    model: str
    dimension: int
    scale: int = 1_000_000
    distance: str = "cosine"

    def __post_init__(self):
        if not (self.provider and self.model and 1 <= self.dimension <= 65_536 and self.scale > 0 and self.distance in ("cosine", "euclidean")):
            raise ValueError("invalid embedding manifest")


@dataclass(frozen=True)
class VectorIndex:
    embedding_id: str
    degree: int = 32
    build: int = 100
    search: int = 100
    overfetch: int = 8
    most: int = 4096

    def __post_init__(self):
        if not (self.embedding_id and 1 <= self.degree <= 256 and self.build >= self.degree and self.search >= 1 and self.overfetch >= 1):
            raise ValueError("invalid vector index manifest")

    def pool(self, limit: int) -> int:
        return min(limit * self.overfetch, self.most)

    def table(self) -> str:
        return "vector_" + manifest_id(self, "")[:16]


@dataclass(frozen=True)
class Rubric:
    model: str
    questions: tuple[str, ...] = ("intent_fit", "task_coverage", "preconditions", "contradicts", "partial_plan")

    def __post_init__(self):
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*@[a-z0-9._-]+", self.model) or not 1 <= len(self.questions) <= 32 or len(set(self.questions)) != len(self.questions):
            raise ValueError("invalid rubric: a pinned model and up to 32 distinct questions")


def as_row(spark: SparkSession, manifest, prefix: str) -> DataFrame:
    """One row: manifest_id, body. What a run stores and a reader verifies."""
    return spark.createDataFrame([(manifest_id(manifest, prefix), canonical.dumps(asdict(manifest)))], "manifest_id string, body string")


def forged(manifests: DataFrame) -> DataFrame:
    """Stored manifests (manifest_id, body) whose id is not the hash of their body."""
    return manifests.where(F.substring_index("manifest_id", "_", -1) != F.sha2("body", 256))


# --- judge answers -----------------------------------------------------------------------------------------------

ANSWER = "score double, confidence double, probabilities array<double>"


def decode_answers(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with score_micros, confidence_micros and valid: a score from 0 to 4, a confidence and probabilities from 0 to
    1 that sum to 1 within a millionth. Text that is no answer is not valid; nothing is dropped."""
    a = F.from_json(payload, ANSWER)
    rows = rows.withColumn("__a", a)
    p = F.col("__a.probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    ok = F.col("__a.score").between(0, 4) & F.col("__a.confidence").between(0, 1) & F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= 1e-6)
    out = rows.withColumn("valid", F.coalesce(ok, F.lit(False)))
    return out.withColumn("score_micros", S.score_micros(F.col("__a.score"))).withColumn("confidence_micros", S.score_micros(F.col("__a.confidence"))).drop("__a")


# --- serving snapshots -------------------------------------------------------------------------------------------


def bound_channels(channels: DataFrame, snapshot: DataFrame) -> DataFrame:
    """channels(channel, index_id) that the snapshot(channel, index_id) pins, and why the others may not run."""
    s = snapshot.select(F.col("channel").alias("__c"), F.col("index_id").alias("__i"))
    joined = channels.join(s, F.col("channel") == F.col("__c"), "left")
    return joined.select("channel", F.when(F.col("__c").isNull(), "not_in_snapshot").when(F.col("index_id") != F.col("__i"), "index_mismatch").otherwise("bound").alias("binding"))


def window_exhausted(revisions: DataFrame, limit: int, factor: int = 64) -> DataFrame:
    """query_id for which a scan of factor * limit + 1 revisions would not have seen `limit` versions though there are
    more rows: reported, never enforced; reads here are complete."""
    found = revisions.groupBy("query_id").agg(F.count("*").alias("rows"), F.count_distinct("version_id").alias("versions"))
    return found.where((F.col("rows") > factor * limit) & (F.col("versions") < limit))


# --- graph rows of a procedure -----------------------------------------------------------------------------------


def depends_on(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """version_id, dependent, prerequisite (ordinals): stored edges point from the dependent step to what it needs."""
    s = steps.select("trace_id", "position", "ordinal")
    a = s.withColumnRenamed("position", "src").withColumnRenamed("ordinal", "prerequisite")
    b = s.withColumnRenamed("position", "dst").withColumnRenamed("ordinal", "dependent")
    return edges.join(a, ["trace_id", "src"]).join(b, ["trace_id", "dst"]).select(F.col("trace_id").alias("version_id"), "dependent", "prerequisite").distinct()


def conflicting_metadata(resources: DataFrame) -> DataFrame:
    """trace_id, resource_id described in more than one way. resources(trace_id, resource_id, name, kind, schema)."""
    kinds = F.count_distinct(F.struct("name", "kind", "schema"))
    return resources.groupBy("trace_id", "resource_id").agg(kinds.alias("descriptions")).where("descriptions > 1")


def alert_windows(samples: DataFrame, seconds: int, value: str, bad: str, threshold: float, most_bad: float) -> DataFrame:
    """samples(at, ...) -> since, n, bad_ratio, p95 (nearest rank) and whether either alert fires."""
    start = (F.col("at") - F.pmod(F.col("at"), F.lit(seconds))).alias("since")
    g = samples.groupBy(start).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    ratio = F.col("n_bad") / F.col("n")
    return g.select("since", "n", F.round(ratio, 9).alias("bad_ratio"), "p95", ((F.col("p95") > threshold) | (ratio > most_bad)).alias("firing"))


# --- tool contracts ----------------------------------------------------------------------------------------------


def register_contracts(known: DataFrame, batch: DataFrame) -> DataFrame:
    """batch(tool_id, version, content_hash, aliases) plus status: new, known (same content), version_conflict (a version
    never changes) or alias_conflict (a name or alias belongs to another tool, stored or in the batch)."""
    have = known.groupBy("tool_id", "version").agg(F.max("content_hash").alias("__h"))
    names = known.select("tool_id", "aliases").unionByName(batch.select("tool_id", "aliases"))
    owned = names.select("tool_id", F.explode(F.concat(F.array("tool_id"), "aliases")).alias("name")).groupBy("name").agg(F.min("tool_id").alias("a"), F.max("tool_id").alias("b"))
    clash = owned.where("a <> b").select("name")
    hit = batch.select("tool_id", "version", F.explode(F.concat(F.array("tool_id"), "aliases")).alias("name")).join(clash, "name", "left_semi").select("tool_id", "version").distinct().withColumn("__clash", F.lit(True))
    rows = batch.join(have, ["tool_id", "version"], "left").join(hit, ["tool_id", "version"], "left")
    status = F.when(F.col("__clash"), "alias_conflict").when(F.col("__h").isNull(), "new").when(F.col("__h") == F.col("content_hash"), "known").otherwise("version_conflict")
    return rows.withColumn("status", status).drop("__h", "__clash")
