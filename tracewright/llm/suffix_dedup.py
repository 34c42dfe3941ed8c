"""Removal of repeated passages by suffix sorting.

A window is a string of WINDOW bytes inside one text. A window that also starts earlier (smaller doc_id, or the same
document further left) is repeated, and every byte under a repeated window is removed.

A suffix array of a whole corpus needs a global order of all its bytes. What is needed here are only suffixes that agree
in WINDOW bytes, and such suffixes can be brought together first:

1. Every window names its *anchor*: the K-byte string in it with the lowest hash, leftmost of equals. Equal windows have
   equal anchors at equal places. The windows of one anchor are consecutive and make up a *segment* (some 140 bytes).
   Each task sends on one record per segment: a hash of the anchor, and where it lies. An anchor that a task sees twice
   is known to be shared; only its first record goes to meet other tasks' records.
2. Anchors seen once cannot hide a repeat. All segments of the others go on, as text. In a batch, segments equal byte for
   byte are one; the later ones are repeated.
3. Segments of the same anchors meet. Equal ones are again one, and all different ones are joined into a buffer and
   suffix-sorted in two stages: suffixes smaller than their successors are sorted directly, the others are induced by one
   scan over the buckets of first bytes. Adjacent common prefixes of at least WINDOW bytes make groups of equal windows,
   of which the first is kept. An anchor with more than SORT_BYTES of segments is sorted in parts of that size; what is
   first in its part meets the firsts of the other parts by a 128-bit digest of the window.
4. The removed ranges meet their texts.

Hashes decide what meets. That windows are equal is found by comparing their bytes, but for the last step of an anchor
sorted in parts.

Defined cases: null text is empty; texts shorter than WINDOW lose nothing; a null doc_id is smaller than any; rows with
equal (or null) doc_id and different text are ordered by the MD5 of their texts, and (doc_id, MD5) is what tells rows
apart throughout; rows that repeat in full follow each other, so all but one lose every byte if they are WINDOW long; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, checkpoint, materialize, slices, utf8, whole_groups

WINDOW, K = 100, 24
SPAN = WINDOW - K + 1
#: Bytes of text that are looked at together: bounds a task's scratch memory; longer texts are cut, overlapping.
PIECE = 1 << 19
#: Records that a task collects before it sends them on.
RECORDS = 200_000
#: Bytes of text whose records one bucket takes.
BUCKET_BYTES = 16 << 20
#: Added to a record's `lo`: its anchor is known to be shared (it need not meet others), or it was sent on already.
SHARED, SENT = 128, 128
#: Bytes of segments that are suffix-sorted together.
SORT_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64)
#: h: anchor; doc, d1, d2: doc_id and digest of the text; at: place of the anchor; at - lo .. at - hi: window starts.
RECORD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("d1", "<u8"), ("d2", "<u8"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1")])
PLACE = "did long, dig binary, first long, last long"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(PIECE + 2 * WINDOW + 1, _P), _powers(PIECE + 2 * WINDOW + 1, pow(_P, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# --- 1: anchors --------------------------------------------------------------------------------------------------


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[bounds[i]:bounds[i+1]]: (anchor hash, anchor, first start, last start)."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * _UP[:n], out=sums[1:])
    kmers = (sums[K:] - sums[:-K]) * _DOWN[: n + 1 - K]
    low = np.uint64((1 << 24) - 1)
    keys = (_mix(kmers) & ~low) | np.arange(len(kmers), dtype=np.uint64)  # the lowest key also says where it is
    pad = -len(keys) % SPAN
    blocks = np.concatenate((keys, np.full(pad + SPAN, ~np.uint64(0)))).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts_n = n - WINDOW + 1
    anchor = (np.minimum(behind[:starts_n], ahead[SPAN - 1 : SPAN - 1 + starts_n]) & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)  # starts from which a window stays inside its text
    sizes = np.diff(bounds)
    full = sizes >= WINDOW
    valid[bounds[:-1][full]] += 1
    valid[bounds[1:][full] - WINDOW + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid[:starts_n]))
    own = anchor[starts]
    new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(own) != 0)) + 1
    first, last = starts[np.concatenate(([0], new))], starts[np.concatenate((new, [len(starts)])) - 1]
    at = own[np.concatenate(([0], new))]
    return _mix(kmers[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at, first, last


def cut(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, piece) of about PIECE bytes; pieces of a longer text share WINDOW - 1 bytes, so
    that each window is in exactly one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE - WINDOW + 1):
            piece = text[at : at + PIECE]
            if group and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def records(texts: list[bytes], docs: np.ndarray, digests: np.ndarray) -> Iterator[np.ndarray]:
    """digests: texts x 2 uint64, in the order of the digests' bytes."""
    for group in cut(texts):
        bounds = np.concatenate(([0], np.cumsum([len(p) for _, _, p in group])))
        h, at, first, last = segments(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), bounds)
        which = np.searchsorted(bounds, at, side="right") - 1
        text, offset = np.array([i for i, _, _ in group])[which], np.array([o for _, o, _ in group])[which]
        out = np.empty(len(h), RECORD)
        out["h"], out["doc"], out["d1"], out["d2"] = h, docs[text], digests[text, 0], digests[text, 1]
        out["at"], out["lo"], out["hi"] = at - bounds[which] + offset, at - first, at - last
        yield out


def sorted_records(found: np.ndarray) -> np.ndarray:
    """By anchor, without records that repeat (of rows that repeat in full)."""
    order = np.argsort(found["h"], kind="stable")
    found = found[order]
    same = np.flatnonzero(found["h"][1:] == found["h"][:-1])
    if len(same):  # only among equals is the rest of the order of interest
        near = np.unique(np.concatenate((same, same + 1)))
        part = found[near]
        part = part[np.lexsort((part["at"], part["d2"], part["d1"], part["doc"], part["h"]))]
        fresh = np.concatenate(([True], part[1:] != part[:-1]))
        keep = np.ones(len(found), bool)
        found[near] = part
        keep[near] = fresh
        found = found[keep]
    return found


def anchor_table(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, records: the segments' records, those of one task and bucket packed into one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            found = sorted_records(np.concatenate(held))
            first = np.concatenate(([True], found["h"][1:] != found["h"][:-1]))
            shared = ~(first & np.concatenate((first[1:], [True])))
            found["lo"][shared] += SHARED
            by = np.where(shared, _mix(found["doc"].view(np.uint64)), found["h"])  # what is known need not meet its like
            tell = found[shared & first]  # but tells the others
            tell["hi"] += SENT
            found, by = np.concatenate((found, tell)), np.concatenate((by, tell["h"]))
            bucket = (by >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            stops = np.flatnonzero(np.diff(bucket)) + 1
            values = [x.tobytes() for x in np.split(found, stops)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate(([0], stops))].astype(np.int64)), pa.array(values, pa.binary())], names=["bucket", "records"])

        for batch in batches:
            texts = as_bytes(batch, "text")
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            digests = np.frombuffer(b"".join(batch.column("dig").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            for a, b in slices(texts):
                for found in records(utf8(texts.slice(a, b - a).to_pylist()), ids[a:b], digests[a:b]):
                    held.append(found)
                    n += len(found)
                    if n >= RECORDS:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    return arrow(docs.select("did", "dig", "text"), run, "bucket long, records binary")


# --- 2: shared anchors -------------------------------------------------------------------------------------------


def with_partners(found: np.ndarray) -> np.ndarray:
    """The records of shared anchors that have not been sent on: all records of an anchor that go by it are in `found`."""
    known, sent = found["lo"] >= SHARED, found["hi"] >= SENT
    direct = found[known & ~sent]
    found = sorted_records(found[~known | sent])
    first = np.concatenate(([True], found["h"][1:] != found["h"][:-1])) if len(found) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    told = np.bincount(group, found["hi"] >= SENT)[group] > 0 if len(found) else first
    alone = first & np.concatenate((first[1:], [True])) if len(found) else first
    out = np.concatenate((direct, found[(told | ~alone) & (found["hi"] < SENT)]))
    out["lo"] %= SHARED
    return out


def shared_segments(anchors: DataFrame) -> DataFrame:
    """did, dig, first, last, at of every segment of a shared anchor; first..last are window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["bucket"]):
            found = with_partners(np.concatenate([np.frombuffer(x, RECORD) for x in part.column("records").to_pylist()]))
            for begin in range(0, len(found), RECORDS):
                rows = found[begin : begin + RECORDS]
                at = rows["at"].astype(np.int64)
                digests = np.stack((rows["d1"], rows["d2"]), 1).astype(">u8").tobytes()
                dig = pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(digests)]).cast(pa.binary())
                columns = [pa.array(np.ascontiguousarray(rows["doc"])), dig, *(pa.array(c) for c in (at - rows["lo"], at - rows["hi"], at))]
                yield pa.RecordBatch.from_arrays(columns, names=["did", "dig", "first", "last", "at"])

    return arrow(anchors.repartition("bucket").sortWithinPartitions("bucket"), run, f"{PLACE}, at long")


# --- 3: two-stage suffix sorting ---------------------------------------------------------------------------------


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, and from the end, as a big-endian number: numeric order is byte order."""
    padded = np.concatenate((data, np.zeros(9, np.uint8)))
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def sort_directly(positions: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """positions in order of their first `depth` bytes, eight at a time; only ties are looked at further."""
    order = np.argsort(word[positions], kind="stable")
    out, key = positions[order], word[positions][order]
    tied_left = np.concatenate(([False], key[1:] == key[:-1])) if len(out) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        tied = tied_left.copy()
        tied[:-1] |= tied_left[1:]
        here = np.flatnonzero(tied)
        if not len(here):
            break
        group = np.cumsum(~tied_left)[here]
        key = word[np.minimum(out[here] + at, len(word) - 1)]
        order = np.lexsort((key, group))
        out[here] = out[here][order]
        key = key[order]
        tied_left = np.zeros(len(out), bool)
        tied_left[here[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
    return out


def two_stage(data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffix array of data, in order of the first `depth` bytes at least."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if its first byte differing from the next one is smaller
    up = np.zeros(n, bool)
    step = np.sign(np.diff(data.astype(np.int16)))
    decided = np.flatnonzero(step)
    if len(decided):
        following = np.searchsorted(decided, np.arange(n - 1))
        inside = following < len(decided)
        up[:-1][inside] = step[decided[following[inside]]] > 0
    smaller = np.flatnonzero(up)
    count = np.bincount(data, minlength=256)
    stop = np.cumsum(count)
    sa = np.full(n, -1, np.int64)
    placed = sort_directly(smaller, words(data), depth)
    own = np.bincount(data[smaller], minlength=256)
    # within a bucket the induced suffixes come first, the sorted ones last
    sa[np.repeat(stop - own - (np.cumsum(own) - own), own) + np.arange(len(placed))] = placed
    head = stop - count
    sa[head[data[n - 1]]] = n - 1  # the last suffix is greater than the empty one after it
    head[data[n - 1]] += 1

    def induce(entries: np.ndarray) -> None:
        """The predecessors that are not sorted yet go to the heads of their buckets, in this order."""
        before = entries[entries > 0] - 1
        before = before[~up[before]]
        order = np.argsort(data[before], kind="stable")
        before = before[order]
        first = data[before].astype(np.int64)
        n_of = np.bincount(first, minlength=256)
        sa[head[first] + np.arange(len(first)) - (np.cumsum(n_of) - n_of)[first]] = before
        np.add(head, n_of, out=head)

    for c in np.flatnonzero(count).tolist():
        at, end = int(stop[c] - count[c]), int(stop[c] - own[c])
        while at < end:  # a bucket's own scan may add to it: runs of one byte
            filled = int(head[c])
            induce(sa[at:filled])
            at = filled
        induce(sa[end : stop[c]])
    return sa


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at a and b agree in their first `depth` bytes (depth at most what lies behind either)."""
    same = np.ones(len(a), bool)
    for at in [*range(0, depth - 7, 8), depth - 8]:
        same[same] = word[a[same] + at] == word[b[same] + at]
    return same


def repeated_windows(segments_: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window inside it) of each window that equals one of an earlier place. place: (rank of the text, first
    window start) of each segment; its windows start at its bytes 0 to length - WINDOW."""
    data = np.frombuffer(b"".join(segments_), np.uint8)
    sizes = np.array([len(s) for s in segments_])
    base = np.cumsum(sizes) - sizes
    sa = two_stage(data)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(data)) - base[of]
    sa = sa[(inside <= sizes[of] - WINDOW)[sa]]
    same = common_prefix(words(data), sa[:-1], sa[1:], WINDOW)
    group = np.cumsum(np.concatenate(([True], ~same)))
    of, inside = of[sa], inside[sa]
    order = np.lexsort((place[of, 1] + inside, place[of, 0], group))
    again = order[1:][np.diff(group[order]) == 0]
    return of[again], inside[again]


def runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, first, last) of the maximal runs of consecutive starts."""
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    new = np.flatnonzero((np.diff(of) != 0) | (np.diff(start) != 1)) + 1
    a, b = np.concatenate(([0], new)), np.concatenate((new, [len(of)])) - 1
    return of[a], start[a], start[b]


def equal_segments(values: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that come first of those with equal bytes, the other rows)."""
    first: dict[bytes, int] = {}
    later = []
    for i in np.lexsort((place[:, 1], place[:, 0])).tolist():
        if first.setdefault(values[i], i) != i:
            later.append(i)
    return np.array(sorted(first.values()), np.int64), np.array(later, np.int64)


def distinct(place: np.ndarray) -> np.ndarray:
    """One row of each place: rows that repeat in full give their segments more than once."""
    order = np.lexsort((place[:, 1], place[:, 0]))
    return order[np.concatenate(([True], (np.diff(place[order], axis=0) != 0).any(1)))[: len(order)]]


def text_ranks(did: np.ndarray, dig: list[bytes]) -> np.ndarray:
    """Rank of each row's (did, dig), equal for equal ones."""
    halves = np.frombuffer(b"".join(dig), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], did))
    new = (np.diff(did[order]) != 0) | (np.diff(halves[order], axis=0) != 0).any(1)
    out = np.empty(len(did), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], new)))
    return out


def in_parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, set[int]]]:
    """Tables of about `limit` bytes of segments, from batches sorted by kmer, and which of their anchors are in parts of
    other tables as well."""
    held: list[pa.Table] = []
    size, cut_, step = 0, None, max(1, min(1024, limit // 256))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            held.append(pa.Table.from_batches([batch.slice(at, step)]))
            size += pc.sum(pc.binary_length(held[-1].column("segment"))).as_py() or 0
            if size < limit:
                continue
            whole = pa.concat_tables(held)
            kmer = whole.column("kmer").to_numpy()
            begins = int(np.searchsorted(kmer, kmer[-1]))
            if begins:
                yield whole.slice(0, begins), {cut_}
                held, cut_ = [whole.slice(begins)], None
            else:
                cut_ = int(kmer[-1])
                yield whole, {cut_}
                held = []
            size = sum(pc.sum(pc.binary_length(t.column("segment"))).as_py() or 0 for t in held)
    if held:
        yield pa.concat_tables(held), {cut_}


def compared(docs: DataFrame, segments_: DataFrame) -> DataFrame:
    """did, dig, first, last: the repeated windows of all segments of shared anchors."""

    def places(did, dig, first, last, **more) -> pa.RecordBatch:
        columns = [pa.array(did, pa.int64()), pa.array(dig, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), *more.values()]
        return pa.RecordBatch.from_arrays(columns, names=["did", "dig", "first", "last", *more])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per segment with its bytes, or without them if an equal one of this batch comes earlier."""
        for batch in batches:
            for begin, end in slices(as_bytes(batch, "text")):
                rows = batch.slice(begin, end - begin)
                data = np.frombuffer(b"".join(utf8(as_bytes(rows, "text").to_pylist())), np.uint8)
                sizes = pc.binary_length(as_bytes(rows, "text")).to_numpy(zero_copy_only=False).astype(np.int64)
                items = rows.column("items")
                of = np.repeat(np.arange(rows.num_rows), np.diff(items.offsets.to_numpy()))
                first, last, at = (items.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                base = (np.cumsum(sizes) - sizes)[of]
                anchor = np.ascontiguousarray(data[(base + at)[:, None] + np.arange(K)]).view(np.uint64)
                kmer = _mix(_mix(_mix(anchor[:, 0]) ^ anchor[:, 1]) ^ anchor[:, 2]).view(np.int64)
                did, dig = rows.column("did").to_numpy(zero_copy_only=False), rows.column("dig").to_pylist()
                place = np.stack((text_ranks(did, dig)[of], first), 1)
                fresh = distinct(place)
                of, base, first, last, kmer, place = (x[fresh] for x in (of, base, first, last, kmer, place))
                values = [data[b : b + n].tobytes() for b, n in zip((base + first).tolist(), (last - first + WINDOW).tolist(), strict=True)]
                _, later = equal_segments(values, place)
                for i in later.tolist():
                    values[i] = None
                kmer[later] = _mix((did[of][later] ^ first[later]).view(np.uint64)).view(np.int64)  # it need not meet its like
                out = places(did[of], [dig[i] for i in of.tolist()], first, last, kmer=pa.array(kmer), segment=pa.array(values, pa.binary()))
                yield from (out.slice(x, 8192) for x in range(0, out.num_rows, 8192))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(0, pa.binary())
        for table, cut_ in in_parts(batches, SORT_BYTES):
            known = table.filter(pc.is_null(table.column("segment")))
            yield from known.select(["did", "dig", "first", "last"]).append_column("window", pa.nulls(known.num_rows, pa.binary())).to_batches()
            table = table.filter(pc.is_valid(table.column("segment")))
            if not table.num_rows:
                continue
            did, kmer, start = (table.column(c).to_numpy() for c in ("did", "kmer", "first"))
            dig, values = table.column("dig").to_pylist(), table.column("segment").to_pylist()
            place = np.stack((text_ranks(did, dig), start), 1)
            fresh = distinct(place)
            first, later = equal_segments([values[i] for i in fresh.tolist()], place[fresh])
            first, later = fresh[first], fresh[later]
            # of an anchor with one different segment, nothing else can be repeated
            _, anchor, n_of = np.unique(kmer[first], return_inverse=True, return_counts=True)
            parts = np.isin(kmer[first], list(cut_ - {None}))
            first = first[(n_of[anchor] > 1) | parts]
            out = [(later, start[later], start[later] + np.array([len(values[i]) for i in later.tolist()], np.int64) - WINDOW)]
            window = [none]
            if len(first):
                of, inside = repeated_windows([values[i] for i in first.tolist()], place[first])
                if len(of):
                    of_, a, b = runs(of, inside)
                    out.append((first[of_], start[first[of_]] + a, start[first[of_]] + b))
                for i in np.flatnonzero(np.isin(kmer[first], list(cut_ - {None}))).tolist():
                    row = int(first[i])
                    left = np.setdiff1d(np.arange(len(values[row]) - WINDOW + 1), inside[of == i])
                    out.append((np.full(len(left), row), start[row] + left, start[row] + left))
                    window.append(pa.array([hashlib.blake2b(values[row][x : x + WINDOW], digest_size=16).digest() for x in left.tolist()], pa.binary()))
            row, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
            digests = pa.concat_arrays(window)
            digests = pa.concat_arrays([pa.nulls(len(row) - len(digests), pa.binary()), digests])
            yield places(did[row], [dig[i] for i in row.tolist()], a, b, window=digests)

    items = segments_.groupBy("did", "dig").agg(F.collect_list(F.struct("first", "last", "at")).alias("items"))
    open_ = docs.select("did", "dig", "text").dropna(subset=["text"]).join(items, ["did", "dig"])
    met = arrow(open_, texts, f"{PLACE}, kmer long, segment binary").repartition("kmer").sortWithinPartitions("kmer")
    found = materialize(arrow(met, sort, f"{PLACE}, window binary"), "windows")
    # firsts of the parts of one anchor: partial minima first, so no task gets them all
    firsts = found.where("window IS NOT NULL")
    earliest = firsts.groupBy("window").agg(F.min(F.struct("did", "dig", "first")).alias("m"), F.count("*").alias("n")).where("n > 1")
    again = firsts.join(checkpoint(earliest), "window").where(F.struct("did", "dig", "first") != F.col("m"))
    return found.where("window IS NULL").drop("window").unionByName(again.select("did", "dig", "first", "last"))


# --- 4: texts ----------------------------------------------------------------------------------------------------


def merge(firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs [begin, end) under the windows that start at firsts[i] .. lasts[i]."""
    order = np.argsort(firsts, kind="stable")
    begin, end = firsts[order], np.maximum.accumulate(lasts[order] + WINDOW)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.concatenate((np.flatnonzero(new)[1:], [len(end)])) - 1]


def prepare(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), digest.alias("dig"), "doc_id", "text")


def repeated_ranges(rows: DataFrame, buckets: int) -> DataFrame:
    """did, dig, firsts, lasts: ranges of repeated window starts of each text that has any."""
    found = materialize(shared_segments(anchor_table(rows, buckets)), "segments")
    packed = compared(rows, found).groupBy("did", "dig").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    return packed.select("did", "dig", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256; one row per row of docs."""
    spark, rows = docs.sparkSession, prepare(docs)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    ranges = repeated_ranges(rows, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    counted = rows.groupBy("did", "dig").agg(F.count("*").alias("n")).where("n > 1")
    if checkpoint(counted.limit(1)).isEmpty():
        numbered = rows.withColumn("nth", F.lit(1))
    else:
        numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("did", "dig").orderBy(F.lit(0))))
    joined = numbered.join(ranges.hint("shuffle_hash"), ["did", "dig"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            nth, firsts, lasts = batch.column("nth").to_pylist(), batch.column("firsts"), batch.column("lasts")
            n_bytes, n_removed, n_spans, kept, digests = [], [], [], [], []
            for i in range(batch.num_rows):
                data = texts[i].as_py() or b""
                begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if nth[i] > 1 and len(data) >= WINDOW:
                    begin, end = np.array([0]), np.array([len(data)])
                elif firsts[i].is_valid:
                    begin, end = merge(firsts[i].values.to_numpy(), lasts[i].values.to_numpy())
                left, at = [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    left.append(data[at:b])
                    at = e
                left = b"".join([*left, data[at:]])
                for column, value in zip((n_bytes, n_removed, n_spans, kept, digests), (len(data), len(data) - len(left), len(begin), left, hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary()), pa.array(digests)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return arrow(joined.select("doc_id", "text", "nth", "firsts", "lasts"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
