"""Exact top-k inner products with vector-approximation files.

Rows are written once to the shared folder as integers, each under a number. Beside them lies the *approximation*: rows
packed into blocks, each dimension cut into CELLS cells of equal width, the list of every vector's cell numbers, one
byte a component. The search has three steps, of which the first two read approximations alone:

1. Scan: for a query, the cells' numbers bound every score from below and above; each task keeps the k best lower bounds
   of each query, and the k-th best of all tasks is what a result must reach.
2. Nominate: pairs of a query and a row whose upper bound reaches that go on, as two numbers and a bound.
3. Read: each query's k first pairs, in the order of their bounds, meet their exact vectors; of the other pairs only those
   are read whose bound reaches the k-th score so far. Rows that no pair asks for are left in the scan: it passes a
   Bloom filter of the numbers asked for (16 bits each, MAX_BITS at most), and what it lets through meets the pairs in
   a join, so nothing depends on the filter.

Queries are packed into blocks as well and every query block meets every block of approximations (a stated query set
against all rows, in blocks; what is paired are blocks, not rows). All pairs of blocks are independent.

Of equal vectors only the k + 1 rows with the smallest ids can be among the best of any query; the others are candidates
no more, so that very many copies of one vector do not meet as many copies of a query.

Vectors are integers, floor(256 * x) of each component, and so are scores. Cell borders are integers; only the bounds'
sums are floating-point numbers, taken with a slack above their rounding error, so that no row is passed over.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
vectors meet queries of their own length only; a query's candidates are all rows but itself, also those that share its
id; rows that repeat are candidates each, and queries each, with a ranking of their own; ties go to the smaller id;
scores that might leave the range of a long are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, materialize

CELLS = 64
VECTOR_BLOCK, QUERY_BLOCK = 1024, 512
SCALE = 256.0
#: Of the filter of row numbers: bits that a number sets, and bits at most.
PROBES, MAX_BITS = 5, 1 << 28


def usable(vector: str, row_id: str) -> Column:
    infinite = F.lit(float("inf"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    return F.col(row_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(vector, sound), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component; any two such vectors have a product below 2^62."""
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1)))
    small = F.forall(vector, lambda x: F.abs(x * SCALE) < most - 1)
    return F.when(small, F.transform(vector, lambda x: F.floor(x * SCALE).cast("long"))).otherwise(F.raise_error(F.lit("components are too large: a score might not fit a long")).cast("array<long>"))


def approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes uint8 n x d, low d, step d): low + codes * step <= exact < low + (codes + 1) * step."""
    low = exact.min(0, initial=0) if not len(exact) else exact.min(0)
    step = (exact.max(0) - low) // CELLS + 1 if len(exact) else np.ones_like(low)
    return ((exact - low) // step).astype(np.uint8), low, step


def upper_bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds queries x vectors, width of the bounds of each query): one product over the cells' numbers."""
    weight = queries * step.astype(np.float64)
    base = queries.astype(np.float64) @ low.astype(np.float64)
    above = (np.maximum(queries, 0) * (step - 1.0)).sum(1)
    below = (np.minimum(queries, 0) * (step - 1.0)).sum(1)
    slack = 2.0**-22 * (len(step) + 4) * (np.abs(weight).sum(1) * CELLS + np.abs(base)) + 0.5
    product = weight.astype(np.float32) @ codes.T.astype(np.float32)
    return product + (base + above + slack)[:, None], above - below + 2 * slack


def pack(rows: DataFrame, block: int, extra: list[str], approximated: bool) -> DataFrame:
    """rows(row, v, `extra`) -> one row per block: number, width, rows and `extra` columns of doubles, and the exact
    vectors or, if asked for, their approximation; arrays as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def row(width: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            held = approximate(parts[1]) if approximated else [parts[1]]
            values = [number, width, *(x.tobytes() for x in (parts[0], *parts[2:], *held))]
            number += 1
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * (len(values) - 2)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            vectors = batch.column("v")
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", *extra)]
            widths = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                exact = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), width)
                held = waiting.setdefault(width, [])
                held.append([columns[0][own], exact, *(c[own] for c in columns[1:])])
                while sum(len(x[0]) for x in held) >= block:
                    parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield row(width, [x[:block] for x in parts])
                    held[:] = [[x[block:] for x in parts]]
        for width, held in waiting.items():
            if sum(len(x[0]) for x in held):
                yield row(width, [np.concatenate(x) for x in zip(*held, strict=True)])

    names = ["block", "width", "rows", *extra, *(["codes", "low", "step"] if approximated else ["exact"])]
    return arrow(rows.select("row", "v", *extra), run, ", ".join(f"{n} {'long' if n == 'block' else 'int' if n == 'width' else 'binary'}" for n in names))


def approximation(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, codes, low, step) of a block row."""
    rows = np.frombuffer(r["rows"], np.int64)
    return rows, np.frombuffer(r["codes"], np.uint8).reshape(len(rows), r["width"]), np.frombuffer(r["low"], np.int64), np.frombuffer(r["step"], np.int64)


def best(values: np.ndarray, k: int) -> np.ndarray:
    return -np.sort(-values, axis=1)[:, :k] if values.shape[1] <= k else -np.sort(np.partition(-values, k - 1, axis=1)[:, :k], axis=1)


def bits_of(rows: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each row number."""
    x = rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(17)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def asked_filter(asked: DataFrame) -> tuple[np.ndarray, int]:
    """A packed Bloom filter of asked(row): at most MAX_BITS / 8 bytes. Tasks set bits, segments are merged in parallel."""
    bits = min(MAX_BITS, max(1 << 13, 1 << (16 * asked.count()).bit_length()))
    segment = min(bits >> 3, 1 << 13)

    def emit(packed: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(packed.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([int(numbers[i])], pa.int64()), pa.array([packed[i].tobytes()], pa.binary())], names=["segment", "bits"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = bits_of(batch.column("row").to_numpy(), bits).ravel()
            np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from emit(packed.reshape(-1, segment), np.arange(len(packed) // segment))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, piece in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                held[number] = held.get(number, 0) | np.frombuffer(piece, np.uint8)
        if held:
            yield from emit(np.stack(list(held.values())), np.array(list(held)))

    schema = "segment long, bits binary"
    out = np.zeros((bits >> 3) // segment * segment, np.uint8).reshape(-1, segment)
    for r in arrow(arrow(asked.select("row"), build, schema).repartition("segment"), fold, schema).toLocalIterator():
        out[r.segment] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel(), bits


def fetch(exact: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of exact(row, ...) that `asked`(row) names, and few others: all that leaves the scan."""
    packed, bits = asked_filter(asked)
    held = exact.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bits_of(batch.column("row").to_numpy(), bits)
            yield batch.filter(pa.array(((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)))

    return arrow(exact, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in exact.schema.fields))


def top_k(rows: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding", count_reads: bool = False) -> DataFrame:
    """query_id, rank (from 1), <row_id>, score: the k best rows of each query row, all of them if there are fewer.
    With `count_reads`, instead: query_id, n_read, the exact vectors read for each query."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sound = rows.where(usable(vector, row_id)).select(F.col(row_id).cast("long").alias("id"), integers(F.col(vector).cast("array<double>")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    numbered = materialize(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))
    exact = materialize(numbered.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("row", "id", "v"), "exact")
    queries = numbered.where("asked").select("row", "id", "v")
    vectors = materialize(pack(exact, VECTOR_BLOCK, [], True), "vector-blocks").repartition(tasks, "block")
    dealt = lambda df: df.repartition(F.expr(f"pmod(xxhash64(row), {tasks})"))
    asked = materialize(pack(dealt(queries), QUERY_BLOCK, [], False), "query-blocks").select(*(F.col(c).alias(f"q_{c}") for c in ("block", "width", "rows", "exact")))

    def bounds(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, rows, upper bounds, width of the bounds) of a pair of blocks; a query's own row is out of reach."""
        own, codes, low, step = approximation(r)
        q = np.frombuffer(r["q_rows"], np.int64)
        upper, width = upper_bounds(np.frombuffer(r["q_exact"], np.int64).reshape(len(q), r["width"]), codes, low, step)
        upper[q[:, None] == own] = -np.inf
        return q, own, upper, width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["width"] == r["q_width"]:
                    q, _, upper, width = bounds(r)
                    lower, held = upper - width[:, None], reached.get(r["q_block"])
                    reached[r["q_block"]] = [q, best(lower if held is None else np.concatenate((held[1], lower), 1), k)]
        for q, lower in reached.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, lower.shape[1])), pa.array(lower.reshape(-1))], names=["query", "bound"])

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["width"] == r["q_width"]:
                    q, own, upper, _ = bounds(r)
                    threshold = np.frombuffer(r["q_threshold"])
                    i, j = np.nonzero((upper >= threshold[:, None]) & (upper > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(own[j]), pa.array(upper[i, j].astype(np.float64))], names=["query", "row", "upper"])

    # blocks against blocks: Spark broadcasts the query blocks only while they are under its size threshold
    place = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
    reach = arrow(vectors.crossJoin(asked), scan, "query long, bound double").withColumn("place", place([F.desc("bound")])).where(F.col("place") <= k)
    reach = reach.groupBy("query").agg(F.when(F.count("*") == k, F.min("bound")).otherwise(float("-inf")).alias("threshold"))
    known = queries.join(reach, F.col("row") == F.col("query")).select("row", "v", "threshold")
    known = pack(dealt(known), QUERY_BLOCK, ["threshold"], False).select(*(F.col(c).alias(f"q_{c}") for c in ("width", "rows", "exact", "threshold")))
    named = arrow(vectors.crossJoin(materialize(known, "known-queries")), nominate, "query long, row long, upper double")
    named = materialize(named.withColumn("place", place([F.desc("upper"), F.col("row")])), "nominated")

    q = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("qv"))

    def scored(pairs: DataFrame) -> DataFrame:
        found = fetch(exact, pairs.select("row").distinct())
        score = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.select("query", "row").join(found, "row").join(q, "query").select("query", "query_id", F.col("id").alias(row_id), score.alias("score"))

    first = materialize(scored(named.where(F.col("place") <= k)), "first")
    kth = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = named.where(F.col("place") > k).join(kth, "query").where("kth IS NULL OR upper >= kth")
    found = first.unionByName(scored(materialize(rest.select("query", "row"), "rest")))
    if count_reads:
        return found.groupBy("query", "query_id").agg(F.count("*").alias("n_read")).select("query_id", "n_read")
    rank = place([F.desc("score"), F.col(row_id)])
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", row_id, "score")
