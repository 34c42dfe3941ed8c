"""A stored index of quantized vectors: coarse centroids, inverted lists, exact integer scores of what is opened.

Centroids are fitted on a bounded sample and stored with the index; every vector then lies in the list of its nearest
centroid, with its squared distance to it and the facets by which requests may be restricted. Lists are Parquet sorted
by list, so that opening some of them reads some row groups.

A search opens the nearest lists of each query until its pool (the limit times the index's overfetch) holds enough rows
that are eligible: of the document's latest epoch and sharing a facet with the request. `exact=True` goes on until no
unopened list can hold a better vector: for a query x and a centroid c, no vector of c's list scores above
x.c + |x| r, where r is the list's radius.

Vectors are scaled integers (`scalars.quantize`), scores are their integer inner products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators.channels import ranked
from tracewright.operators.manifests import VectorIndex, manifest_id
from tracewright.sources.tables import Catalog, checkpoint

#: Vectors that centroids are fitted on, at most, and passes over them.
SAMPLE, PASSES = 20_000, 8
#: A list holds about so many vectors, as long as the number of lists stays within LISTS (their centroids are broadcast).
PER_LIST, LISTS = 1_000, 4_096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sample(rows: DataFrame, n: int, sample: int) -> list:
    """The `sample` first of n rows(o, version_id, qv) by the hash o. Taking them by order would send as many from every
    partition to the driver; hashes are spread evenly, so a bound on them leaves little more than is wanted."""
    share = (sample + 6 * sample**0.5) / max(n, 1)
    if share < 1:
        low = rows.where(F.col("o") <= int(-(2**63) + share * 2**64))
        if sample <= low.count() <= 2 * sample:
            return sorted(low.collect(), key=lambda r: (r.o, r.version_id))[:sample]  # 2 * `sample` rows at most
    return checkpoint(rows.orderBy("o", "version_id").limit(sample)).orderBy("o", "version_id").collect()  # `sample` rows at most


def fit(vectors: DataFrame, lists: int | None = None, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of a seeded sample of at most `sample` vectors(version_id, qv), by k-means; rows are centroids."""
    n = vectors.count()
    lists = lists or max(1, min(LISTS, n // PER_LIST or 1))
    rows = _sample(vectors.select("version_id", "qv", F.xxhash64(F.col("version_id"), F.lit(seed)).alias("o")), n, sample)
    x = np.array([r.qv for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    centroids = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(PASSES):
        own = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class Index:
    """An index as of an epoch: its centroids, its lists (list, version_id, epoch, qv, facets, away) and their radii."""

    manifest: VectorIndex
    centroids: np.ndarray
    rows: DataFrame
    radii: DataFrame


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors(version_id, qv, facets) with their list and distance to its centroid. Centroids: LISTS rows at most."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = _matrix(batch.column("qv")), held.value
                square = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
                own = np.argmin(square, axis=1)
                away = np.sqrt(np.maximum(((x - c[own]) ** 2).sum(1), 0))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("version_id"), batch.column("qv"), batch.column("facets"), pa.array(away)], names=["list", "version_id", "qv", "facets", "away"])

    kind = vectors.schema["version_id"].dataType.simpleString()
    return vectors.select("version_id", "qv", "facets").mapInArrow(run, f"list int, version_id {kind}, qv array<bigint>, facets array<string>, away double")


def quantized(vectors: DataFrame, scale: int = S.PPM) -> DataFrame:
    """version_id, qv, facets of vectors(version_id, vector, facets) that have a direction."""
    facets = F.col("facets") if "facets" in vectors.columns else F.array().cast("array<string>")
    directed = F.exists("vector", lambda x: x != 0)
    return vectors.select("version_id", F.when(directed, S.quantize(F.col("vector"), scale)).alias("qv"), facets.alias("facets")).where("qv IS NOT NULL")


def provision(catalog: Catalog, manifest: VectorIndex, vectors: DataFrame, lists: int | None = None) -> str:
    """Create the index's tables: its manifest and centroids, once. Another manifest has other tables; centroids never
    change, so all epochs agree on the lists. Returns the table's name."""
    name = manifest.table()
    if catalog.head(f"{name}_centroids") < 0:
        c = fit(vectors, lists)
        rows = catalog.spark.createDataFrame([(manifest_id(manifest, "vix_"), i, [float(v) for v in x]) for i, x in enumerate(c)], "manifest_id string, list int, centroid array<double>")
        catalog.append(f"{name}_centroids", rows, expected=-1)
    return name


def _centroids(catalog: Catalog, manifest: VectorIndex) -> np.ndarray:
    rows = sorted(catalog.read(f"{manifest.table()}_centroids").collect(), key=lambda r: r.list)  # LISTS rows at most
    if any(r.manifest_id != manifest_id(manifest, "vix_") for r in rows):
        raise ValueError("the stored index has another manifest")
    return np.array([r.centroid for r in rows])


def put(catalog: Catalog, manifest: VectorIndex, vectors: DataFrame) -> int:
    """Store a batch of quantized vectors as the next epoch, sorted by list."""
    rows = assigned(vectors, _centroids(catalog, manifest))
    return catalog.append(manifest.table(), rows.repartition("list").sortWithinPartitions("list", "version_id"))


def open_index(catalog: Catalog, manifest: VectorIndex, as_of: int | None = None) -> Index:
    rows = catalog.read(manifest.table(), as_of)
    return Index(manifest, _centroids(catalog, manifest), rows, rows.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n")))


def latest_only(index: Index, documents: DataFrame | None = None) -> DataFrame:
    """version_id, epoch of each version's latest row; documents(version_id, epoch) says it for the documents themselves,
    so that vectors of a revision that was replaced since are left out."""
    rows = documents if documents is not None else index.rows.select("version_id", "epoch")
    return rows.groupBy("version_id").agg(F.max("epoch").alias("epoch"))


def distances(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, list, dot, bound, nth: every query's lists, most promising first. queries(query_id, qv)."""
    held = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x, c = _matrix(part.column("qv")), held.value
                if len(c):
                    ids = part.column("query_id").take(pa.array(np.repeat(np.arange(len(x)), len(c))))
                    length = np.repeat(np.sqrt((x**2).sum(1)), len(c))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(c), dtype=np.int32), len(x))), pa.array((x @ c.T).ravel()), pa.array(length)], names=["query_id", "list", "dot", "length"])

    kind = queries.schema["query_id"].dataType.simpleString()
    dots = queries.select("query_id", "qv").mapInArrow(run, f"query_id {kind}, list int, dot double, length double")
    reach = dots.join(index.radii, "list").withColumn("bound", F.col("dot") + F.col("length") * F.col("radius"))
    return reach.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "list"))).select("query_id", "list", "dot", "bound", "nth", "n")


def search(index: Index, queries: DataFrame, limit: int, documents: DataFrame | None = None, exact: bool = False, channel: str = "vector") -> DataFrame:
    """The best `limit` eligible versions of every query(query_id, qv, facets); facets that are null or not there restrict
    nothing. Rounds open twice as many lists as the one before, for the queries that still need any: until the pool is
    full, or, if `exact`, until no list is left whose bound reaches the query's limit-th score."""
    asked = F.col("facets") if "facets" in queries.columns else F.lit(None).cast("array<string>")
    q = checkpoint(queries.where("qv IS NOT NULL").select("query_id", F.col("qv").alias("asked_qv"), asked.alias("asked")))
    lists = checkpoint(distances(index, q.select("query_id", F.col("asked_qv").alias("qv"))))
    live = index.rows.join(latest_only(index, documents), ["version_id", "epoch"], "left_semi").dropDuplicates(["version_id"])
    live = checkpoint(live.select("list", "version_id", "qv", "facets"))
    pool, opened, wanted = index.manifest.pool(limit), 0, max(1, round(2 * len(index.centroids) ** 0.5))
    hits, waiting = None, q.select("query_id")
    while True:
        fresh = lists.join(waiting, "query_id").where((F.col("nth") > opened) & (F.col("nth") <= wanted)).select("query_id", "list")
        met = fresh.join(q, "query_id").join(live, "list").where("asked IS NULL OR arrays_overlap(asked, facets)")
        found = met.select("query_id", "version_id", S.inner_product(F.col("asked_qv"), F.col("qv")).alias("score"))
        if hits is not None:
            found = found.unionByName(hits.select("query_id", "version_id", "score"))
        hits = checkpoint(ranked(found, channel, pool))
        opened, wanted = wanted, wanted * 2
        have = hits.groupBy("query_id").agg(F.count("*").alias("have"), F.max(F.when(F.col("rank") == limit, F.col("score"))).alias("kth"))
        rest = lists.where(F.col("nth") > opened).groupBy("query_id").agg(F.max("bound").alias("bound")).join(have, "query_id", "left")
        if exact:  # the bound is a sum of doubles: one unit and a billionth more than it can be off
            rest = rest.where(F.col("kth").isNull() | (F.col("bound") + F.abs("bound") * 1e-9 + 1 >= F.col("kth")))
        else:
            rest = rest.where(F.coalesce("have", F.lit(0)) < pool)
        waiting = checkpoint(rest.select("query_id"))
        if waiting.isEmpty():
            return hits.where(F.col("rank") <= limit)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true hits(query_id, version_id) that were found."""
    n = true.count()
    return true.join(found.select("query_id", "version_id"), ["query_id", "version_id"], "left_semi").count() / n if n else 1.0
