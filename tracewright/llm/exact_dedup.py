"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of the last 32 bytes has its low bits zero, so equal texts are cut alike wherever
they lie. Each chunk has a name, a hash. Chunks move once, by their names, and are deduplicated by their bytes: every
different chunk gets one number, and no two may share a name; should two do, all chunks are named anew with another
seed. A document becomes its *recipe*, the ordered list of its chunks' numbers. Two texts are equal exactly when their
recipes are, so from then on only recipes (8 bytes per two kilobytes of text) move; documents stay where they are.

Defined cases: null text counts as empty; empty texts form one group; of equal texts the largest doc_id stays (a null
doc_id is smaller than any); rows repeated with the same doc_id and text count as several rows of the group, one of
which stays. Columns other than doc_id and text are ignored here and carried along by `drop_copies`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, checkpoint, materialize, slices, utf8

WINDOW = 32
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16384
_GEAR = np.random.Generator(np.random.PCG64(20240101)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Offsets after which the gear hash of the last WINDOW bytes has MASK_BITS zero bits, over a whole buffer."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:  # h over 2n bytes from h over n bytes
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def boundaries(cuts: np.ndarray, begin: int, end: int) -> list[int]:
    """Chunk ends of the document at [begin, end): cuts nearer than MIN_CHUNK to the last are passed over."""
    ends, last = [], begin
    for cut in cuts.tolist():
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if cut - last >= MIN_CHUNK and cut < end:
            ends.append(cut)
            last = cut
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return [*ends, end]


def chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(text, its chunks) of each text; the empty text is one empty chunk."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    cuts = cut_points(data) if len(data) > MIN_CHUNK else np.zeros(0, np.int64)
    begin = 0
    for text in texts:
        end = begin + len(text)
        own = cuts[np.searchsorted(cuts, begin + MIN_CHUNK) : np.searchsorted(cuts, end)]
        out, last = [], begin
        for stop in boundaries(own, begin, end):
            out.append(joined[last:stop])
            last = stop
        yield text, out
        begin = end


def name(part: bytes, size: int, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(part, seed)[:size]


def recipes(docs: DataFrame, name_bytes: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, n_bytes, text_sha256, names (of its chunks, in order), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            digests, names = [], []
            for a, b in slices(texts):
                for text, parts in chunks(utf8(texts.slice(a, b - a).to_pylist())):
                    digests.append(hashlib.sha256(text).hexdigest())
                    names.append([name(part, name_bytes, seed) for part in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(digests, pa.string()), pa.array(names, pa.list_(pa.binary()))],
                names=["doc_id", "n_bytes", "text_sha256", "names"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "doc_id long, n_bytes long, text_sha256 string, names array<binary>")


def chunk_store(docs: DataFrame, name_bytes: int = 16, seed: int = 0) -> DataFrame:
    """name, bytes, n_uses: each different chunk once. Grouping compares bytes, so chunks that only share a name stay two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(texts := as_bytes(batch, "text")):
                found = Counter(part for _, parts in chunks(utf8(texts.slice(a, b - a).to_pylist())) for part in parts)
                columns = [pa.array([name(part, name_bytes, seed) for part in found], pa.binary()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "bytes", "n"])

    parts = arrow(docs.select(F.col("text").cast("string").alias("text")), run, "name binary, bytes binary, n long")
    return parts.groupBy("name", "bytes").agg(F.sum("n").alias("n_uses"))


def identified(docs: DataFrame, name_bytes: int = 16, tries: int = 20) -> tuple[DataFrame, DataFrame]:
    """(recipes with a number `row`, name and chunk_id of every different chunk): written tables, names verified."""
    for seed in range(tries):
        ids = materialize(chunk_store(docs, name_bytes, seed).select("name", F.monotonically_increasing_id().alias("chunk_id")), "chunks")
        if ids.groupBy("name").count().where("count > 1").isEmpty():
            return materialize(recipes(docs, name_bytes, seed).withColumn("row", F.monotonically_increasing_id()), "recipes"), ids
    raise RuntimeError(f"chunk names of {name_bytes} bytes collide under {tries} seeds")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, text_sha256, keep_id, group_size, kept.

    Copies are counted before the shuffle; the join back puts one row per text that has copies beside the narrow rows.
    Both sides are read from the shared folder, so AQE can broadcast the small one or split a group that holds a third
    of the corpus, which a window over the recipe could not."""
    rows, ids = identified(docs)
    used = rows.select("row", F.posexplode("names").alias("at", "name")).join(ids, "name")
    listed = used.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))).alias("parts"))
    recipe = materialize(listed.select("row", F.col("parts.chunk_id").alias("recipe")).join(rows.select("row", "doc_id"), "row"), "lists")
    copies = recipe.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    copies = copies.select("recipe", "keep.doc_id", F.col("keep.row").alias("keep_row"), "group_size").withColumnRenamed("doc_id", "keep_id")
    found = recipe.select("recipe", "row").join(checkpoint(copies), "recipe").select("row", "keep_id", "keep_row", "group_size")
    out = rows.join(found, "row", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep_id).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return out.select("doc_id", "n_bytes", "text_sha256", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, order: Column | None = None) -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest doc_id; all columns stay.

    What goes is named by (doc_id, digest) in a written table, far smaller than what stays; texts move once to meet it,
    and are not sorted for that. Only if kept rows repeat in full are they numbered to cut them to one."""
    key = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    found = materialize(groups(docs).select(*key, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")), "kept")
    gone = materialize(found.where("NOT stays").select("__id", "__sha").distinct(), "copies")
    columns = docs.columns
    tagged = docs.withColumn("__digest", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    left = tagged.join(gone.hint("shuffle_hash"), same, "left_anti")
    if not found.where("stays").groupBy("__id", "__sha").count().where("count > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id", "__digest").orderBy(order if order is not None else F.lit(0)))
        left = left.withColumn("__n", nth).where("__n = 1")
    return left.select(*columns)
