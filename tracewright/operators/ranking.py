"""Integer rank fusion, total order, selection. No floating point between a channel's rank and the final order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import canonical

SCALE = 1_000_000


@dataclass(frozen=True)
class Feature:
    name: str
    minimum: int
    maximum: int
    missing: int
    coefficient: int


@dataclass(frozen=True)
class Ranker:
    """Channel weights in millionths, the constant of reciprocal rank fusion, and calibrated features."""

    weights: dict[str, int] = field(default_factory=lambda: {"exact": 1_000_000, "lexical": 700_000, "vector": 600_000, "facet": 500_000, "graph": 300_000})
    k: int = 60
    coefficient: int = 1
    intercept: int = 0
    features: tuple[Feature, ...] = (Feature("verification_strength", 0, 10, 0, 1000),)

    def __post_init__(self):
        worst = abs(self.intercept) + abs(self.coefficient) * sum(w * SCALE // (self.k + 1) for w in self.weights.values())
        worst += sum(abs(f.coefficient) * max(abs(f.minimum), abs(f.maximum), abs(f.missing)) for f in self.features)
        if worst > 2**63 - 1:
            raise ValueError("a score could leave 64 bits")

    def manifest_id(self) -> str:
        body = {
            "channels": [{"name": n, "weight_micros": w} for n, w in sorted(self.weights.items())],
            "features": [vars(f) for f in sorted(self.features, key=lambda f: f.name)],
            "intercept": self.intercept, "rrf_coefficient": self.coefficient, "rrf_k": self.k,
        }
        return canonical.identity(body, "rnk_")


def rrf(hits: DataFrame, ranker: Ranker) -> DataFrame:
    """hits(query_id, version_id, channel, rank) -> query_id, version_id, rrf. Every term is divided for itself."""
    weight = F.create_map(*[x for name, w in sorted(ranker.weights.items()) for x in (F.lit(name), F.lit(w).cast("long"))])
    term = F.call_function("div", weight[F.col("channel")] * SCALE, ranker.k + F.col("rank"))
    return hits.withColumn("term", term).groupBy("query_id", "version_id").agg(F.sum("term").alias("rrf"))


def fuse(candidates: DataFrame, ranker: Ranker) -> DataFrame:
    """candidates with rrf and the features' columns -> plus final and missing (names of absent features)."""
    final = F.lit(ranker.intercept).cast("long") + F.col("rrf") * ranker.coefficient
    absent = []
    for f in ranker.features:
        value = F.col(f.name)
        inside = F.when(value.isNull(), F.lit(f.missing)).otherwise(value)
        checked = F.when(value.isNotNull() & ~value.between(f.minimum, f.maximum), F.raise_error(F.lit(f"feature {f.name} out of range")).cast("long")).otherwise(inside)
        final = final + checked * f.coefficient
        absent.append(F.when(value.isNull(), F.lit(f.name)))
    missing = F.array_compact(F.array(*absent)) if absent else F.array().cast("array<string>")
    return candidates.withColumn("final", final.cast("long")).withColumn("missing", missing)


def total_order(fused: DataFrame) -> DataFrame:
    """Plus rank: final, verification strength, observed end to end, version id. A unique key ends it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("verification_strength"), F.desc("observed"), "version_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def select_top(ranked: DataFrame, minimum: int, most: int) -> DataFrame:
    """Plus selected: the first `most` that are eligible for more than advice and reach the minimum score."""
    fit = ~F.col("advisory") & (F.col("final") >= minimum)
    place = F.sum(fit.cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("selected", fit & (place <= most))


def disposition(queries: DataFrame, candidates: DataFrame, minimum: int) -> DataFrame:
    """query_id, disposition, reason. candidates(query_id, eligible, advisory, final)."""
    fit = F.col("eligible") & ~F.col("advisory")
    seen = candidates.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.count_if(fit).alias("n_fit"), F.count_if(fit & (F.col("final") >= minimum)).alias("n_selected")
    )
    reason = (
        F.when(F.col("n").isNull(), "no_candidates").when(F.col("n_eligible") == 0, "no_eligible_candidates")
        .when(F.col("n_fit") == 0, "advisory_only").when(F.col("n_selected") == 0, "below_confidence_threshold")
    )
    out = queries.select("query_id").join(seen, "query_id", "left").withColumn("reason", reason)
    return out.select("query_id", F.when(F.col("reason").isNull(), "selected").otherwise("abstained").alias("disposition"), "reason")


def ambiguity_band(ranked: DataFrame, distance: int, most: int) -> DataFrame:
    """The candidates a judge would see: where the first two are within `distance`, the first `most` within it."""
    w = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    banded = ranked.withColumn("top", F.first("final").over(w)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("final"))).over(whole))
    return banded.where((F.col("top") - F.col("second") <= distance) & (F.col("top") - F.col("final") <= distance) & (F.col("rank") <= most)).drop("top", "second")
