"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

A line's key is the line without the white space at its ends, A-Z lower-cased. A key that several documents hold stays
only in the one with the smallest doc_id. Most keys of a corpus occur in one document, and those never move:

1. each task sets the bits of its documents' keys in a filter "once"; a key that is already there goes to "twice" as
   well. Tasks' filters are merged segment by segment, in parallel: what lies in two tasks' "once" lies in "twice".
2. the merged "twice" goes to all tasks; a key whose bits are not all in it occurs in one document. Only the others, the
   suspected repeats, are shuffled, and compared by their bytes: the smallest doc_id of each key that several documents
   hold is an aggregate combined before the shuffle.
3. the keys that a document loses come back to it by (doc_id, MD5 of the text), as 16-byte digests.

Filters hold 12 bits for every line of the corpus, `MAX_BITS` at most, so what is broadcast has a fixed bound. Beyond
it more keys are suspected and shuffled than repeat; the results are the same.

Defined cases: null and empty texts are one empty line; keys under `min_length` code points are never dropped; a null
doc_id is larger than any other, and all rows of one doc_id are one document: where it holds a key first, all its lines
with that key stay. A document that loses all lines keeps the empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, materialize, slices, utf8

#: Bits of a filter: a power of two, BITS_PER_LINE for each line or more, within these bounds.
BITS_PER_LINE, MIN_BITS, MAX_BITS = 12, 1 << 16, 1 << 28
#: Bits that a key sets, and bytes of the piece of a filter that is merged at a time.
PROBES, SEGMENT = 6, 1 << 13


def keys_of(text: bytes, min_length: int) -> list[bytes]:
    """The key of every line; b"" for lines that are never dropped."""
    return [k if len(k) >= min_length and (len(k) >= 4 * min_length or len(k.decode()) >= min_length) else b"" for k in map(bytes.strip, text.lower().split(b"\n"))]


def positions(keys: Iterable[bytes], bits: int) -> np.ndarray:
    """Bit numbers of each key, one row of PROBES per key (double hashing)."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((both[:, :1] + steps * (both[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def contains(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of bit numbers are all set in a packed filter."""
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Filters:
    """The two filters of one task. Bits of "once" that lie in a second task's "once" are carried over by `merge`."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    def add(self, keys: list[bytes]) -> None:
        """keys: of several documents, each key once per document."""
        at = positions(keys, self.bits)
        order = np.lexsort((at[:, 1], at[:, 0]))
        at = at[order]
        again = np.r_[False, (at[1:, :2] == at[:-1, :2]).all(axis=1)] | contains(self.once, at)
        for packed, rows in ((self.once, at), (self.twice, at[again])):
            np.bitwise_or.at(packed, rows.ravel() >> 3, np.uint8(1) << (rows.ravel() & 7).astype(np.uint8))

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(number, once, twice) of each piece with a bit set, compressed: little of a large filter is set by one task."""
        once, twice = self.once.reshape(-1, SEGMENT), self.twice.reshape(-1, SEGMENT)
        for i in np.flatnonzero(once.any(axis=1)).tolist():
            yield i, _packed(once[i]), _packed(twice[i])


def _packed(piece: np.ndarray) -> bytes:
    return pa.compress(piece.tobytes(), codec="zstd", asbytes=True)


def _unpacked(piece: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(piece, SEGMENT, codec="zstd", asbytes=True), np.uint8)


def merge(rows: Iterable[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The merged "twice" of each segment among rows (segment, once, twice)."""
    held: dict[int, list[np.ndarray]] = {}
    for segment, once, twice in rows:
        once, twice = _unpacked(once), _unpacked(twice)
        if segment in held:
            a, b = held[segment]
            held[segment] = [a | once, b | twice | (a & once)]
        else:
            held[segment] = [once, twice]
    for segment, (_, twice) in held.items():
        if twice.any():
            yield segment, _packed(twice)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filter_bits(docs: DataFrame, max_bits: int = MAX_BITS) -> int:
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0)).alias("n")).first().n
    return min(max_bits, max(MIN_BITS, 1 << (int(BITS_PER_LINE * n)).bit_length()))


def repeated_filter(docs: DataFrame, bits: int, min_length: int) -> np.ndarray:
    """The merged filter of keys seen twice, packed: at most MAX_BITS / 8 bytes, whatever the size of docs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        for batch in batches:
            filters = filters or Filters(bits)
            for a, b in slices(texts := as_bytes(batch, "text")):
                found = [k for text in utf8(texts.slice(a, b - a).to_pylist()) for k in set(keys_of(text, min_length)) if k]
                if found:
                    filters.add(found)
        if filters is not None:
            waiting: list[tuple[int, bytes, bytes]] = []
            for row in filters.segments():
                waiting.append(row)
                if len(waiting) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*waiting, strict=True)], names=["segment", "once", "twice"])
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*waiting, strict=True)], names=["segment", "once", "twice"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True))
        for segment, twice in merge(rows):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([twice], pa.binary())], names=["segment", "twice"])

    parts = arrow(_texts(docs).select("text"), build, "segment long, once binary, twice binary")
    merged = arrow(parts.repartition("segment"), fold, "segment long, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = _unpacked(bytes(row.twice))
    return out


def suspects(docs: DataFrame, seen_twice, bits: int, min_length: int) -> DataFrame:
    """(doc_id, text_md5, key) of keys whose bits are all in the filter; seen_twice is a broadcast of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b in slices(texts := as_bytes(batch, "text")):
                at, keys = [], []
                for i, text in enumerate(own := utf8(texts.slice(a, b - a).to_pylist())):
                    found = [k for k in dict.fromkeys(keys_of(text, min_length)) if k]
                    at += [i] * len(found)
                    keys += found
                if not keys:
                    continue
                hit = np.flatnonzero(contains(seen_twice.value, positions(keys, bits)))
                rows = np.array(at)[hit]
                digests = {i: hashlib.md5(own[i]).digest() for i in set(rows.tolist())}
                columns = [ids.take(pa.array(rows + a)), pa.array([digests[i] for i in rows.tolist()], pa.binary()), pa.array([keys[i] for i in hit.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_md5", "key"])

    return arrow(_texts(docs), run, "doc_id long, text_md5 binary, key binary")


def lost(found: DataFrame) -> DataFrame:
    """(doc_id, text_md5, gone) of the texts that lose lines: digests of the keys that a document with a smaller id holds.

    The join puts one row per repeated key beside the suspects, so a key held by very many documents can be split."""
    number = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    numbered = found.withColumn("__no", F.struct(F.col("doc_id").isNull().alias("none"), number.alias("id")))
    first = numbered.groupBy("key").agg(F.min("__no").alias("__first"), F.max("__no").alias("__last")).where("__first <> __last")
    gone = numbered.join(first.select("key", "__first"), "key").where("__no <> __first")
    return gone.groupBy("doc_id", "text_md5").agg(F.collect_list(F.unhex(F.md5("key"))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_length: int = 10, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept (the lines that stay, joined)."""
    spark, docs = docs.sparkSession, _texts(docs)
    bits = filter_bits(docs, max_bits)
    seen_twice = spark.sparkContext.broadcast(repeated_filter(docs, bits, min_length))
    found = materialize(suspects(docs, seen_twice, bits, min_length), "suspects")
    gone = materialize(lost(found), "gone").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5"), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, drops = batch.column("doc_id"), batch.column("gone")
            for a, b in slices(texts := as_bytes(batch, "text")):
                kept, lines, dropped = [], [], []
                for text, digests in zip(utf8(texts.slice(a, b - a).to_pylist()), drops.slice(a, b - a).to_pylist(), strict=True):
                    n, k = text.count(b"\n") + 1, 0
                    if digests:
                        out, own = set(digests), text.split(b"\n")
                        stay = [line for line, key in zip(own, keys_of(text, min_length), strict=True) if not key or hashlib.md5(key).digest() not in out]
                        text, k = b"\n".join(stay), n - len(stay)
                    kept.append(text.decode())
                    lines.append(n)
                    dropped.append(k)
                columns = [ids.slice(a, b - a), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept"])

    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("__md5"))
    rows = docs.join(gone, same, "left").select("doc_id", "text", "gone")
    return arrow(rows, run, "doc_id long, n_lines long, n_dropped long, kept string")
