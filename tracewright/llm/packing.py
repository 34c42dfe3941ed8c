"""Best-fit packing of token pieces by bin completion.

A document's ids (byte-level BPE, then one end id) are cut into pieces of at most `capacity`; only longer documents are
cut, and their first piece takes the remainder. Full pieces fill a sequence by themselves. The others are dealt by a
seeded hash into blocks of about BLOCK_PIECES and each block is packed alone, which costs at most about one part-filled
sequence per block over packing them all together.

In a block, pieces of equal length are alike, so the packer works on how many there are of each length. Best fit
decreasing gives the incumbent. If that misses the lower bound ceil(sum / capacity), bin completion tries to beat it:
fill the sequence around the largest piece left, enumerate its undominated completions (one is dominated if another
piece of the block still fits beside it, or if its pieces can be dealt into those of another one), branch on them, least
waste first, and give a branch up as soon as its waste so far means more sequences than the incumbent. The search gives
up NODE_BUDGET branches a block; then the incumbent, which packs every piece, stands.

Defined cases: null text is empty and gives the end id alone; rows that repeat give their pieces again; null doc_id is
allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, slices

BLOCK_PIECES = 20_000
NODE_BUDGET = 1000
#: Fillings enumerated at a time.
LOT = 40
END_ID = 2


# --- tokens ------------------------------------------------------------------------------------------------------


def load_tokenizer(path: str, pattern: str, ranks_path: str | None = None):
    """A function from a list of texts to lists of ids: those of the tokenizers file at `path`. With `ranks_path`, the same
    vocabulary as merge ranks, ids come from the faster implementation of the same algorithm (three times the throughput),
    save for texts that hold an added token of the file, such as its end-of-text string."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    slow = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda texts: [slow([t])[0] if any(a in t for a in added) else encoding.encode_ordinary(t) for t in texts]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    out = [(0, first)] if first else []
    return out + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: dict, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(**tokenizer)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(texts):
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, found in zip(ids[a:b], encode([t or "" for t in texts.slice(a, b - a).to_pylist()]), strict=True):
                    found.append(END_ID)
                    data = np.asarray(found, "<u4").tobytes()
                    for no, (start, length) in enumerate(cuts(len(found), capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (doc_id, no, start, length, zlib.crc32(own), own if with_ids else None), strict=True):
                            column.append(value)
                arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(rows[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


# --- one block ---------------------------------------------------------------------------------------------------


class Supply:
    """How many pieces there are of each length, with the largest length <= x found by a search over those left."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.sizes = dict(counts), sorted(k for k, n in counts.items() if n)

    def largest(self, most: int) -> int:
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int, n: int = 1) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def give(self, size: int) -> None:
        if not self.counts.get(size):
            self.sizes.insert(bisect_right(self.sizes, size), size)
            self.counts[size] = 0
        self.counts[size] += 1


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each piece, largest first, into the fullest sequence that still takes it."""
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[list[int]] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                left = rooms[at]
                own = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                own, left = len(bins), capacity
                bins.append([])
            bins[own].append(size)
            if left := left - size:
                if left not in room:
                    room[left] = []
                    rooms.insert(bisect_right(rooms, left), left)
                room[left].append(own)
    return bins


def fillings(pieces_: list[tuple[int, int]], room: int) -> Iterator[tuple[int, ...]]:
    """All sets of pieces that fit `room` and to which no further piece can be added, largest pieces first. pieces_:
    (length, how many), largest first. A set to which a piece can be added is dominated by the larger set."""
    sizes, left = [n for n, _ in pieces_], [n for _, n in pieces_]
    negative = [-n for n in sizes]

    def extend(at: int, free: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        leaf = True
        for k in range(max(at, bisect_left(negative, -free)), len(sizes)):
            most = min(left[k], free // sizes[k])
            leaf &= not most
            for n in range(most, 0, -1):
                left[k] -= n
                yield from extend(k + 1, free - n * sizes[k], chosen + (sizes[k],) * n)
                left[k] += n
        if leaf and not any(left[bisect_left(negative, -free) :]):
            yield chosen

    return extend(0, room, ())


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of `other` can be dealt into those of `one` as into sequences: then `one` is never worse."""
    if len(other) > 10 or len(one) > len(other) or (other and (not one or other[0] > one[0])):
        return False

    def place(k: int, rooms: list[int]) -> bool:
        if k == len(other):
            return True
        for at, free in enumerate(rooms):
            if free >= other[k] and free not in rooms[:at] and place(k + 1, [*rooms[:at], free - other[k], *rooms[at + 1 :]]):
                return True
        return False

    return one != other and place(0, list(one))


class Completions:
    """Undominated fillings around the largest piece left, in lots of LOT, each by least waste; later lots are only looked
    for when the search comes back for them."""

    def __init__(self, supply: Supply, capacity: int):
        self.largest = supply.sizes[-1]
        self.room = capacity - self.largest
        supply.take(self.largest)
        fit = supply.sizes[: bisect_right(supply.sizes, self.room)]
        if fit and fit[-1] == self.room:  # dominates every other filling
            self.more: Iterator = iter([(self.room,)])
        else:
            self.more = fillings([(n, supply.counts[n]) for n in reversed(fit)], self.room)
        supply.give(self.largest)
        self.known: list[tuple[int, ...]] = []
        self.lot: list[tuple[int, ...]] = []

    def next(self) -> list[int] | None:
        """A filling; nothing if a whole lot was dominated; None after the last one."""
        if not self.lot:
            fresh = list(islice(self.more, LOT))
            for f in sorted(fresh, key=lambda f: (-sum(f), len(f))):
                if not any(dominates(k, f) for k in self.known):
                    self.lot.append(f)
                    if len(self.known) < LOT // 5:  # what dominates is among the least wasteful
                        self.known.append(f)
            self.lot.reverse()
            if not self.lot:
                return [] if fresh else None
        return [self.largest, *self.lot.pop()]


def bin_completion(counts: dict[int, int], capacity: int, node_budget: int = NODE_BUDGET) -> list[list[int]]:
    """Sequences as lists of lengths. Depth first: the first descent takes the least wasteful filling it knows everywhere.
    A search that ends within its budget has tried every undominated filling, so its result is the best there is."""
    incumbent = best_fit(counts, capacity)
    total = sum(size * n for size, n in counts.items())
    bound = -(-total // capacity)
    if len(incumbent) <= bound:
        return incumbent
    supply, waste, nodes = Supply(counts), 0, 0
    path: list[list[int]] = []
    levels = [Completions(supply, capacity)]
    while levels:
        chosen = levels[-1].next()
        if chosen is None:
            levels.pop()
            nodes += 1
            if path:
                last = path.pop()
                waste -= capacity - sum(last)
                for size in last:
                    supply.give(size)
        elif not chosen or waste + capacity - sum(chosen) > (len(incumbent) - 1) * capacity - total:  # more waste than a better packing has
            nodes += 1
        else:
            for size in chosen:
                supply.take(size)
            path.append(chosen)
            waste += capacity - sum(chosen)
            if supply.sizes:
                levels.append(Completions(supply, capacity))
                continue
            incumbent = [list(b) for b in path]  # fewer sequences: its waste was small enough
            if len(incumbent) <= bound:
                return incumbent
            for size in path.pop():
                supply.give(size)
            waste -= capacity - sum(chosen)
        if nodes > node_budget:
            break
    return incumbent


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of a block."""
    sizes, n = np.unique(lengths, return_counts=True)
    bins = bin_completion(dict(zip(sizes.tolist(), n.tolist(), strict=True)), capacity)
    waiting = {size: iter(np.flatnonzero(lengths == size).tolist()) for size in sizes.tolist()}
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for no, content in enumerate(bins):
        at = 0
        for size in content:
            i = next(waiting[size])
            sequence[i], offset[i] = no, at
            at += size
    return sequence, offset


# --- all blocks --------------------------------------------------------------------------------------------------


def assign(rows: DataFrame, capacity: int, seed: int = 11) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset. Sequence ids are the block's
    number times 2^32 plus a number in the block; full pieces are sequences of their own and are never gathered."""
    loose = F.col("length") < capacity
    n_loose = rows.where(loose).count()
    blocks = max(1, round(n_loose / BLOCK_PIECES))
    dealt = rows.where(loose).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32"), F.lit(blocks)))

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_block(block.column("length").to_numpy(), capacity)
        first = block.column("block")[0].as_py() << 32
        return block.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", sequence_id long, offset long"
    full = rows.where(~loose).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return dealt.groupBy("block").applyInArrow(pack, schema).drop("block").unionByName(full)
