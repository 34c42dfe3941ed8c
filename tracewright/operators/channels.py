"""Candidate channels: queries against documents, scored in integers, the best of each query ranked.

Common shape: `docs` has version_id, `queries` has query_id; a channel returns query_id, channel, version_id, score,
rank, ordered by score (descending) and version_id. Where few pairs share anything, pairs are found by
equality joins on what they share; which side is broadcast is left to the optimizer's size check. Where most pairs share
something, a bounded batch of queries is counted beside the documents. Ranking is a window with a limit, which Spark
applies before the shuffle as well."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from tracewright.functions import scalars as S
from tracewright.sources.tables import checkpoint


def ranked(hits: DataFrame, channel: str, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "version_id")
    best = hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", F.lit(channel).alias("channel"), "version_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


#: A batch of requests that is counted beside the documents; a larger one is joined on its members.
BATCH_QUERIES, BATCH_TEXT = 4096, 16 << 20
#: Cells of a matrix that a task holds at a time.
CELLS = 1 << 23


def set_similarity(docs: DataFrame, queries: DataFrame, members, doc_text: str, query_text: str, limit: int | None = None) -> DataFrame:
    """query_id, version_id, score: integer Jaccard of two sets, of pairs that share a member. Pairs are found by joining
    on the members, so nothing is compared that shares none. With `limit`, only pairs that can be among the best of their
    query are counted in full: a bounded batch of queries goes to the documents (`counted`). For a larger one, similarity
    is at most the smaller size over the larger one, so the limit-th best score among sets of nearly equal size bounds the
    sizes of all others."""
    d = docs.select("version_id", members(F.col(doc_text)).alias("m")).select("version_id", F.size("m").alias("nd"), "m")
    q = queries.select("query_id", members(F.col(query_text)).alias("m")).select("query_id", F.size("m").alias("nq"), F.explode("m").alias("member"))

    def scored(asked: DataFrame, ratio: Column) -> DataFrame:
        """Pairs whose sizes are within `ratio` of each other."""
        near = F.least("nd", "nq") >= ratio * F.greatest("nd", "nq")
        pairs = d.join(widest, (F.col("nd") * F.col("__ratio") <= F.col("__nq")) & (F.col("nd") >= F.col("__small"))) if limit else d
        shared = pairs.select("version_id", "nd", F.explode("m").alias("member")).join(asked, "member").where(near)
        shared = shared.groupBy("query_id", "version_id").agg(F.count("*").alias("shared"), F.min("nd").alias("nd"), F.min("nq").alias("nq"))
        return shared.select("query_id", "version_id", S.jaccard_ppm(F.col("shared"), F.col("nd"), F.col("nq")).alias("score"))

    def extent(asked: DataFrame, ratio: Column) -> DataFrame:
        """One row: the sizes of documents that any query may meet."""
        return F.broadcast(asked.agg(F.max(F.col("nq") / ratio).alias("__nq"), F.min(F.col("nq") * ratio).alias("__small"), F.lit(1).alias("__ratio")))

    if limit is None:
        return scored(q, F.lit(0.0))
    size = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.coalesce(F.sum(F.octet_length(query_text)), F.lit(0)).alias("bytes")).first()  # one row
    if size.n == size.ids and size.n <= BATCH_QUERIES and size.bytes <= BATCH_TEXT:
        again = checkpoint(docs.groupBy("version_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("version_id").alias("__id")))
        asked = queries.select("query_id", members(F.col(query_text)).alias("m")).where("size(m) > 0").toArrow()  # bounded by the batch
        if again.isEmpty():
            return counted(docs.select("version_id", members(F.col(doc_text)).alias("m")), asked, limit)
        # ids that repeat are one document with the members of all its rows
        same = F.col("version_id").eqNullSafe(F.col("__id"))
        once = counted(docs.join(again, same, "left_anti").select("version_id", members(F.col(doc_text)).alias("m")), asked, limit)
        d, limit = d.join(again, same, "left_semi"), None
        return once.unionByName(scored(q, F.lit(0.0)))
    widest = extent(q, F.lit(0.5))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"))
    best = scored(q, F.lit(0.5)).withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
    reached = best.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).otherwise(0).alias("__least"))
    # scores are rounded down, so a ratio below the score by one millionth is on the safe side
    asked = checkpoint(q.join(reached, "query_id", "left").withColumn("ratio", F.greatest(F.coalesce("__least", F.lit(0)) - 1, F.lit(1)) / S.PPM / 1.000001).drop("__least"))
    widest = extent(asked, F.col("ratio"))
    return scored(asked, F.col("ratio"))


def blocks(queries: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(ids, their members, members x ids as 0 and 1, sizes) of runs of queries whose matrix has about CELLS cells at most."""
    ids, sets = queries["query_id"].combine_chunks(), queries["m"].combine_chunks()
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    while begin < len(sizes):
        cells = np.cumsum(sizes[begin:]) * np.arange(1, len(sizes) - begin + 1)
        end = begin + max(1, int(np.searchsorted(cells, CELLS, "right")))
        flat = sets.slice(begin, end - begin).flatten()
        known = flat.unique()
        has = np.zeros((len(known), end - begin), np.float32)
        has[pc.index_in(flat, known).to_numpy(), np.repeat(np.arange(end - begin), sizes[begin:end])] = 1
        yield ids.slice(begin, end - begin), known, has, sizes[begin:end]
        begin = end


def counted(docs: DataFrame, queries: pa.Table, limit: int) -> DataFrame:
    """docs(version_id, m) with distinct ids -> query_id, version_id, score of pairs that share a member; of each query at
    least the best `limit`. A batch of documents times the queries' members is one matrix product, whole numbers below
    2^24 throughout, and what cannot be among its query's best is left where it was counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(blocks(queries))
        floors = [np.ones(len(ids), np.int64) for ids, *_ in parts]
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("version_id"), null_placement="at_start"))
            versions, sets = batch.column("version_id"), batch.column("m")
            sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = sets.flatten(), np.cumsum(sizes)
            for (ids, known, has, asked), floor in zip(parts, floors, strict=True):
                found = pc.index_in(flat, known)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                member, row = found.drop_null().to_numpy(), np.searchsorted(ends, at, "right")
                step = max(1, min(CELLS // len(known), CELLS // len(ids)))
                for begin in range(0, len(sizes), step):
                    end = min(begin + step, len(sizes))
                    here = slice(*np.searchsorted(row, [begin, end]))
                    holds = np.zeros((end - begin, len(known)), np.float32)
                    holds[row[here] - begin, member[here]] = 1
                    shared = (holds @ has).astype(np.int64)
                    score = shared * S.PPM // np.maximum(sizes[begin:end, None] + asked - shared, 1)
                    if end - begin >= limit:
                        np.maximum(floor, np.partition(score, end - begin - limit, axis=0)[end - begin - limit], out=floor)
                    level = score == floor  # rows go by version, so the first of those that tie are the best
                    keep = (score > floor) | (level & (np.cumsum(level, axis=0) <= limit))
                    v, k = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), versions.take(pa.array(v + begin)), pa.array(score[keep])], names=["query_id", "version_id", "score"])

    kind = {"query_id": queries.schema.field("query_id").type, "version_id": docs.schema["version_id"].dataType}
    return docs.mapInArrow(run, T.StructType([T.StructField("query_id", from_arrow_type(kind["query_id"])), T.StructField("version_id", kind["version_id"]), T.StructField("score", T.LongType())]))


def lexical(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    return ranked(set_similarity(docs, queries, S.words, "task", "task", limit), "lexical", limit)


def trigram_codes(text: Column) -> Column:
    """The set of `S.trigrams` as numbers of 21 bits a character."""

    @F.arrow_udf("array<long>")
    def codes(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        c = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        windows = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        sets = [np.unique(windows[a : max(a, b - 2)]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([windows[:0], *sets])))

    return codes(F.lower(text))


def trigram(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    return ranked(set_similarity(docs, queries, trigram_codes, "task", "task", limit), "vector", limit)


def bm25(docs: DataFrame, queries: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Full-text score in millionths. The reference's parameters are its database's; 1.2 and 0.75 are the usual ones.

    Texts are shuffled by version once; terms are counted and scores summed where their text lies, so neither words nor
    hits are shuffled. The requests' weighted terms, a batch, are broadcast to them."""
    tokens = F.filter(F.split(F.lower("task"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    d = docs.select("version_id", "task").repartition("version_id").select("version_id", tokens.alias("t")).withColumn("len", F.size("t"))
    stats = d.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    tf = d.select("version_id", "len", F.explode("t").alias("term")).groupBy("version_id", "len", "term").agg(F.count("*").alias("tf"))
    q = queries.select("query_id", F.explode(S.words(F.col("task"))).alias("term"))
    df = tf.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len")  # stats is one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    hits = tf.join(F.broadcast(q.join(weighted, "term")), "term").groupBy("query_id", "version_id").agg(F.round(F.sum(part) * S.PPM).cast("long").alias("score"))
    return ranked(hits, "bm25", limit)


FACETS = ["environment", "harness"]


def first_versions(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The `limit` smallest version ids under each key, cut before the shuffle as well."""
    place = Window.partitionBy(*keys).orderBy("version_id")
    return rows.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= limit).drop("__place")


def facet(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """4 for the environment, 2 for the harness, 1 for any shared contract; one row per version and per query. Ties go to
    the smaller version id, so a version among the best is one of the `limit` smallest under the facets it shares with the
    query: whatever precedes it there scores as high. Those lists are made once for all queries; a query meets at most
    `limit` versions for each of three sets of facets, and for four of each of its contracts, however many versions share
    a facet."""
    q, d = queries.select("query_id", *FACETS, "contracts"), docs.select("version_id", *FACETS, "contracts")
    both = first_versions(d, FACETS, limit)
    lists = [(both, FACETS), *((first_versions(both, [f], limit), [f]) for f in FACETS)]
    one = first_versions(d.withColumn("contract", F.explode(F.array_distinct("contracts"))), ["contract", *FACETS], limit)
    of_facet = [(first_versions(one, ["contract", f], limit), ["contract", f]) for f in FACETS]
    lists += [(one, ["contract", *FACETS]), *of_facet, (first_versions(one, ["contract"], limit), ["contract"])]
    asked = q.withColumn("contract", F.explode(F.array_distinct("contracts")))
    version = F.struct("version_id", *FACETS, "contracts").alias("d")
    met = [(asked if "contract" in keys else q).select("query_id", *keys).join(rows.select(*keys, version), keys).select("query_id", "d") for rows, keys in lists]
    pairs = reduce(DataFrame.unionByName, met).distinct().join(q, "query_id")
    same = lambda ok, points: F.when(ok, points).otherwise(0)
    score = same(F.col("d.environment") == F.col("environment"), 4) + same(F.col("d.harness") == F.col("harness"), 2) + same(F.arrays_overlap("d.contracts", "contracts"), 1)
    return ranked(pairs.select("query_id", "d.version_id", score.cast("long").alias("score")), "facet", limit)


def graph(edges: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Number of edges from a version to any contract the query asks for. edges(version_id, contract)."""
    wanted = queries.select("query_id", F.explode("contracts").alias("contract")).distinct()
    return ranked(edges.join(wanted, "contract").groupBy("query_id", "version_id").agg(F.count("*").alias("score")), "graph", limit)


def exact(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Equal intent and effect; a query's effect is inferred where its intent has one effect only."""
    known = docs.where("intent IS NOT NULL AND effect IS NOT NULL")
    single = known.groupBy("intent").agg(F.count_distinct("effect").alias("n"), F.min("effect").alias("effect")).where("n = 1").select("intent", "effect")
    hits = queries.select("query_id", "intent").join(single, "intent").join(known.select("version_id", "intent", "effect"), ["intent", "effect"])
    return ranked(hits.select("query_id", "version_id", F.lit(S.PPM).alias("score")), "exact", limit)


def vector(docs: DataFrame, queries: DataFrame, limit: int, scale: int = S.PPM) -> DataFrame:
    """Exact integer inner products of quantized vectors: a stated query set against every row. A bounded batch of requests
    of one dimension is multiplied beside the documents; a larger one is paired by Spark, which broadcasts it below its
    size threshold and pairs partition by partition above it."""
    q = queries.select("query_id", S.quantize(F.col("vector"), scale).alias("qv"))
    d = docs.select("version_id", S.quantize(F.col("vector"), scale).alias("dv"))
    whole = q.where("qv IS NOT NULL AND size(qv) > 0 AND NOT exists(qv, x -> x IS NULL)")
    size = whole.agg(F.count("*").alias("n"), F.min(F.size("qv")).alias("least"), F.max(F.size("qv")).alias("most")).first()  # one row
    if 0 < size.n <= BATCH_QUERIES and size.least == size.most and size.n * size.most <= CELLS and scale <= EXACT:
        same = d.where((F.size("dv") == size.most) & ~F.exists("dv", lambda x: x.isNull()))  # other lengths have no score
        return ranked(multiplied(same, whole.toArrow(), limit), "vector", limit)
    return ranked(q.crossJoin(d).select("query_id", "version_id", S.inner_product(F.col("qv"), F.col("dv")).alias("score")), "vector", limit)


#: Unit vectors in this scale have products, and partial sums of them, below 2^53: doubles hold them exactly.
EXACT = 10**7


def multiplied(docs: DataFrame, queries: pa.Table, limit: int) -> DataFrame:
    """docs(version_id, dv), queries(query_id, qv) of one dimension -> query_id, version_id, score above 0; of each query at
    least the best `limit`."""
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = queries["query_id"].combine_chunks(), matrix(queries["qv"].combine_chunks()).T
        floor, step = np.ones(len(ids), np.int64), max(1, CELLS // len(ids))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("version_id"), null_placement="at_start"))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                score = (matrix(part.column("dv")) @ asked).astype(np.int64)
                if len(score) >= limit:
                    np.maximum(floor, np.partition(score, len(score) - limit, axis=0)[len(score) - limit], out=floor)
                level = score == floor  # rows go by version, so the first of those that tie are the best
                keep = (score > floor) | (level & (np.cumsum(level, axis=0) <= limit))
                v, k = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), part.column("version_id").take(pa.array(v)), pa.array(score[keep])], names=["query_id", "version_id", "score"])

    fields = [T.StructField("query_id", from_arrow_type(queries.schema.field("query_id").type)), T.StructField("version_id", docs.schema["version_id"].dataType), T.StructField("score", T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields))


def union(*channels: DataFrame) -> DataFrame:
    """query_id, version_id, hits (by channel): every candidate with all channels that found it."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    hits = F.array_sort(F.collect_list(F.struct("channel", "rank", "score")))
    return out.groupBy("query_id", "version_id").agg(hits.alias("hits"))


def degraded(runs: DataFrame, required: list[str]) -> DataFrame:
    """query_id, failure: the first required channel that did not answer. runs(query_id, channel, code)."""
    missed = runs.where(F.col("code").isNotNull() & F.col("channel").isin(required))
    return missed.groupBy("query_id").agg(F.concat(F.lit("required_channel_unavailable:"), F.min("channel")).alias("failure"))


def hit_score(channel: Column, score: Column) -> Column:
    return F.when(channel == "exact", F.lit(S.PPM)).otherwise(score)
