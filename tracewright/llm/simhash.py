"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. Fingerprints that differ in at most
`max_bits` bits are linked, and documents are grouped by what is reachable.

Search: equal fingerprints are merged first. Of max_bits + 1 bit blocks, two linked fingerprints agree in at least one,
so every fingerprint goes once per block to the task that holds this block's value; no pair is missed. A task rotates
the block to the front and sorts by Gray rank, which puts fingerprints with common leading bits, and of those the ones
one flip apart, side by side. Runs of FANOUT neighbours become index nodes: a mask of the bits all of them share, and
their pattern; runs of nodes become upper nodes with the bits all of those share. A lookup goes down from its bucket's
root and adds up differences in the bits each level newly fixes; a node whose sum passes max_bits is pruned with all
below it. So is a node whose members are all connected to the query already: links are wanted for what they connect,
so a dense group of copies costs about its size and not its square. Each task sends on one edge per fingerprint.

Defined cases: null or empty text has fingerprint zero, linked like any other; a text of fewer words than a shingle is
one shingle; null doc_id takes part and is passed over by the minimum; repeated rows get equal results; an empty table
gives no rows; other columns are ignored, `drop_near_copies` carries them along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, checkpoint, materialize, slices, utf8, whole_groups
from tracewright.llm.graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)
FANOUT = 8
#: Pairs of query and node looked at in one numpy step: bounds a task's scratch memory to some tens of MB.
FRONTIER = 1 << 20


# --- fingerprints ------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.translate(LOWER).split()  # bytes.split() cuts at space and \t \n \v \f \r
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint64 fingerprint of each run of counts[i] > 0 hashes: eight byte-wide counters are added at a time, over runs
    of at most 255 so that none overflows."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    runs = -(-counts // 255)
    run_first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), run_first, axis=0)
        for j in range(8):
            out |= (2 * ones[:, j] > counts).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprint(texts: list[bytes], width: int, seed: int) -> np.ndarray:
    lists = [shingle_hashes(t, width, seed) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if counts.sum():
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        out[counts > 0] = majorities(flat, counts[counts > 0])
    return out


def fingerprints(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            parts = [fingerprint(utf8(texts.slice(a, b - a).to_pylist()), width, seed) for a, b in slices(texts)]
            fps = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "doc_id long, fp long")


# --- the index ---------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in Gray-code order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Fingerprints in Gray order under levels of nodes; level 0 are the fingerprints. No node spans two buckets."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        self.codes = codes
        n = len(codes)
        self.levels = [{"mask": np.full(n, ~np.uint64(0)), "pattern": codes, "last": np.arange(n), "bucket": buckets}]
        while True:
            low = self.levels[-1]
            change = np.flatnonzero(np.diff(low["bucket"])) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(low["bucket"])])))
            if len(self.levels) > 1 and sizes.max(initial=1) == 1:
                break
            per = -(-sizes // FANOUT)
            first = np.repeat(starts, per) + FANOUT * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            stop = np.concatenate((first[1:], [len(low["bucket"])]))
            differ = np.bitwise_or.reduceat(low["pattern"] ^ np.repeat(low["pattern"][first], stop - first), first)
            mask = np.bitwise_and.reduceat(low["mask"], first) & ~differ
            self.levels.append({"mask": mask, "pattern": low["pattern"][first] & mask, "last": low["last"][stop - 1], "bucket": low["bucket"][first], "first": first, "n": stop - first})

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level, the label shared by all below a node, or -1."""
        out = [labels]
        for level in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], level["first"]), np.maximum.reduceat(out[-1], level["first"])
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, queries: np.ndarray, max_bits: int, labels: np.ndarray, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(query, other) with other later in order, within max_bits and not yet connected to the query."""
        top = self.levels[-1]
        q = queries
        node = np.searchsorted(top["bucket"], self.levels[0]["bucket"][q])
        fixed = np.zeros(len(q), np.uint64)
        differences = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            fresh = level["mask"][node] & ~fixed  # bits that the levels above have not counted
            differences = differences + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & fresh)
            stay = (differences <= max_bits) & (level["last"][node] > q) & (uniform[depth][node] != labels[q])
            q, node, differences, fixed = q[stay], node[stay], differences[stay], level["mask"][node[stay]]
            if depth == 0:
                return q, node
            n, first = level["n"][node], level["first"][node]
            below = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, differences, fixed, node = np.repeat(q, n), np.repeat(differences, n), np.repeat(fixed, n), below
        raise AssertionError


def connect(codes: np.ndarray, buckets: np.ndarray, max_bits: int, linked=None) -> np.ndarray:
    """Label (smallest position) of each fingerprint's component inside its bucket; codes sorted by (bucket, Gray rank).
    linked(a, b), if given, decides on the pairs of positions that the index lets through."""
    index, n = GrayIndex(codes, buckets), len(codes)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = np.arange(n)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [n]))
    size = np.repeat(np.diff(starts), np.diff(starts))
    cost = np.cumsum(np.minimum(size, 64 * FANOUT) + 1)  # queries whose frontiers together stay near FRONTIER
    at = 0
    while at < n:
        end = int(max(at + 1, np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER // 16)))
        if size[at] > 4096:
            end = min(end, at + max(1, FRONTIER // int(size[at])))
        a, b = index.links(np.arange(at, min(end, n)), max_bits, labels, index.uniform(labels))
        if linked is not None and len(a):
            sure = linked(a, b)
            a, b = a[sure], b[sure]
        if len(a):
            for x, y in np.unique(np.stack([labels[a], labels[b]], 1), axis=0).tolist():
                x, y = sorted((root(x), root(y)))
                parent[y] = x
            touched = np.unique(labels)
            final = np.array([root(x) for x in touched.tolist()])
            labels = final[np.searchsorted(touched, labels)]
        at = end
    return labels


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """distinct(fp) -> edges(a, b) that connect exactly what chains of links within max_bits connect."""
    n_blocks = max_bits + 1
    edges_of = [64 * i // n_blocks for i in range(n_blocks + 1)]
    keys = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", edges_of[i]), 64 - (edges_of[i + 1] - edges_of[i])).alias("key")) for i in range(n_blocks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts or not sum(p.num_rows for p in parts):
            return
        fp = np.concatenate([p.column("fp").to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)
        block = np.concatenate([p.column("block").to_numpy(zero_copy_only=False) for p in parts])
        shift = np.array(edges_of, np.uint64)[block]
        rotated = np.where(shift > 0, (fp << shift) | (fp >> (np.uint64(64) - np.maximum(shift, np.uint64(1)))), fp)
        order = np.lexsort((gray_rank(rotated), block))
        fp, block, rotated = fp[order], block[order], rotated[order]
        width = np.diff(np.array(edges_of, np.uint64))[block]
        lead = rotated >> (np.uint64(64) - width)
        new = np.concatenate(([True], (np.diff(block) != 0) | (np.diff(lead.view(np.int64)) != 0)))
        labels = connect(rotated, np.cumsum(new) - 1, max_bits)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[labels[other]].view(np.int64)), pa.array(fp[other].view(np.int64))], names=["a", "b"])

    dealt = distinct.select("fp", F.inline(F.array(*keys))).repartition("block", "key")
    return arrow(dealt, run, "a long, b long")


# --- documents ---------------------------------------------------------------------------------------------------


def near_groups(docs: DataFrame, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable), one row per row of docs."""
    rows = materialize(fingerprints(docs, width, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct, max_bits))
    by_fp = checkpoint(smallest_of(distinct, "fp", roots))  # read anew, so that AQE can split a fingerprint of very many rows
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def smallest_of(distinct: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """key, component_id: the smallest first_id of each component. Only what has links is joined with its component, and
    with one row per component on the other side, so a large component is split and not gathered."""
    linked = distinct.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), F.col(key) == F.col("__node")).select(key, "first_id", "__root")
    linked = checkpoint(linked)
    smallest = checkpoint(linked.groupBy("__root").agg(F.min("first_id").alias("__least")))
    found = linked.join(smallest, "__root").select(F.col(key).alias("__key"), "__least")
    return distinct.join(found, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("__least", "first_id").alias("component_id"))


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by exact similarity -----------------------------------------------------------------------------

#: Texts meet under KEYS keys, each made of the smallest of ROWS seeded hashes of the text's shingles, so keys are as wide
#: as a hash and unrelated texts do not meet, however large the corpus. A pair at similarity 0.8 shares none of them in
#: 2 of 1,000 cases, at 0.85 in 2 of 10,000.
KEYS, ROWS = 16, 5
#: 64-bit words of a wide fingerprint.
WORDS = 8
#: A group is searched in tiles of at most so many texts and shingles; tiles meet pair by pair.
TILE_TEXTS, TILE_SHINGLES = 4096, 1 << 18
#: Bytes of one scratch table of the exact comparison.
SCRATCH = 1 << 24
_ODD = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 63, (KEYS, ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.random.Generator(np.random.PCG64(98)).integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def loose_bits(similarity: float, bits: int) -> int:
    """Differing bits that a pair at this Jaccard similarity (equal sizes) stays below: the mean plus six deviations. The
    margin also covers sets of four or five shingles, whose fingerprints differ more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, int(bits * p + 6 * math.sqrt(bits * p * (1 - p))))


def shingle_sets(texts: list[bytes], width: int, seed: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    return [np.unique(np.array(shingle_hashes(t, width, seed), np.uint64)) for t in texts]


def set_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())


def meeting_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sets x KEYS int64, of sets that are not empty."""
    out = np.zeros((len(starts), KEYS), np.uint64)
    for k, odds in enumerate(_ODD):
        key = np.full(len(starts), k + 1, np.uint64)
        for odd in odds:
            key = (key ^ np.minimum.reduceat(flat * odd, starts)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out[:, k] = key
    return out.view(np.int64)


def wide_fingerprints(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """sets x WORDS uint64: majorities over each set's shingles, a shingle's bits drawn from its hash."""
    out = np.zeros((len(counts), WORDS), np.uint64)
    for j, odd in enumerate(_MIX):
        h = flat * odd
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, j] = majorities(h ^ (h >> np.uint64(32)), counts)
    return out


class Overlap:
    """Sizes of intersections of sets, by bit tables over the shingles that more than one of them holds."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        _, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n > 1
        column = np.cumsum(shared) - 1
        held = shared[inverse]
        self.row, self.column = np.repeat(np.arange(len(sets)), self.size)[held], column[inverse][held]
        self.width, self.step = int(shared.sum()), max(64, SCRATCH // max(1, len(sets)) // 64 * 64)
        self.cached: tuple[int, np.ndarray] | None = None

    def bits(self, first: int) -> np.ndarray:
        """rows x words: columns first .. first + step, kept until other columns are asked for."""
        if self.cached is None or self.cached[0] != first:
            own = (self.column >= first) & (self.column < first + self.step)
            width = min(self.step, -(-(self.width - first) // 64) * 64)
            table = np.zeros((len(self.size), width), bool)
            table[self.row[own], self.column[own] - first] = True
            self.cached = first, np.packbits(table, axis=1).view(np.uint64)
        return self.cached[1]

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        both = np.zeros(len(a), np.int64)
        for first in range(0, self.width, self.step):
            table = self.bits(first)
            chunk = max(1, SCRATCH // (8 * table.shape[1]))
            for at in range(0, len(a), chunk):
                own = slice(at, at + chunk)
                both[own] += np.bitwise_count(table[a[own]] & table[b[own]]).sum(1, dtype=np.int64)
        return both + 1e-9 >= similarity * (self.size[a] + self.size[b] - both)


def linked_members(fps: np.ndarray, similarity: float, exact: Overlap | None = None) -> np.ndarray:
    """Label (smallest position) of each member's component. Two members are linked if the index lets them through, their
    whole fingerprints are near enough and, if `exact` is given, their sets are as similar as asked."""
    order = np.argsort(gray_rank(fps[:, 0]), kind="stable")
    wide = fps[order]
    limit = loose_bits(similarity, 64 * WORDS)

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sure = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= limit
        if exact is not None:
            at = np.flatnonzero(sure)
            sure[at] = exact.similar(order[a[at]], order[b[at]], similarity)
        return sure

    labels = connect(wide[:, 0], np.zeros(len(wide), np.int64), loose_bits(similarity, 64), linked)
    out = np.empty(len(order), np.int64)
    out[order] = order[labels]
    return out


def dealt_in_tiles(rows: DataFrame, group: str, order: str, tiles) -> DataFrame:
    """Rows of one group together and sorted by group. A group of `tiles` > 1 tiles is dealt as pairs of tiles: no task
    holds more than two, and every two members of a group meet in one task at least."""
    own = F.pmod(F.xxhash64(order), F.col("__n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1))
    rows = rows.withColumn("__n", F.greatest(F.lit(1), F.ceil(tiles)).cast("long")).withColumn("__own", own).withColumn("__other", other)
    rows = rows.withColumn("lo", F.least("__own", "__other")).withColumn("hi", F.greatest("__own", "__other"))
    # with two tiles or more, a tile alone is met inside each of its pairs
    rows = rows.where("__n = 1 OR lo < hi").drop("__n", "__own", "__other")
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", order)


def edges_of_groups(dealt: DataFrame, group: str, similarity: float, exact: bool) -> DataFrame:
    """dealt(group, lo, hi, node, fp, shingles if exact) -> edges(a, b) that connect what links connect in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, [group, "lo", "hi"]):
            node = part.column("node").to_pylist()
            fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
            overlap = None
            if exact:
                shingles = part.column("shingles").combine_chunks()
                ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                overlap = Overlap([flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
            labels = linked_members(fps, similarity, overlap)
            other = np.flatnonzero(labels != np.arange(len(labels))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([node[labels[x]] for x in other], pa.binary()), pa.array([node[x] for x in other], pa.binary())], names=["a", "b"])

    columns = [group, "lo", "hi", "node", "fp", *(["shingles"] if exact else [])]
    return arrow(dealt.select(*columns), run, "a binary, b binary")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, component_id: texts are linked where the Jaccard similarity of their sets of word shingles, counted in
    full, is at least `similarity`; groups are what is reachable.

    Equal sets are merged first. Under each key, the Gray-order index connects the wide fingerprints that are near enough
    for the similarity, with a margin of six deviations: what it connects are loose families, at one edge per text and
    key. Only a family's members can be linked, so their shingle sets move once, to their family, where the index is
    asked again and pairs not yet connected are counted in full. Rows grow with the texts, not with pairs; families and
    keys too large for a task are searched in tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            for a, b in slices(texts, 1 << 20):
                sets = shingle_sets(utf8(texts.slice(a, b - a).to_pylist()), width, seed)
                counts = np.array([len(s) for s in sets], np.int64)
                flat, some = np.concatenate(sets), counts[counts > 0]
                fps = np.zeros((len(sets), WORDS), np.uint64)
                keys = np.zeros(0, np.int64)
                if len(some):
                    fps[counts > 0] = wide_fingerprints(flat, some)
                    keys = meeting_keys(flat, np.cumsum(some) - some).reshape(-1)
                ends = np.cumsum([0, *(KEYS * (counts > 0)).tolist()]).astype(np.int32)
                columns = [batch.column("doc_id").slice(a, b - a), set_ids(sets), pa.array(counts), pa.array([x.tobytes() for x in fps], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "fp", "keys"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            for a, b in slices(texts, 1 << 20):
                sets = shingle_sets(utf8(texts.slice(a, b - a).to_pylist()), width, seed)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([set_ids(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(arrow(narrow, run, "doc_id long, node binary, n long, fp binary, keys array<long>"), "shingle-keys")
    distinct = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "shingle-sets")

    keyed = distinct.select("node", F.explode("keys").alias("key"))
    shared = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = keyed.join(shared, "key").join(distinct.select("node", "fp"), "node")
    loose = edges_of_groups(dealt_in_tiles(met, "key", "node", F.col("size") / (TILE_TEXTS // 2)), "key", similarity, False)
    families = components(loose)

    family = checkpoint(families.join(distinct.select("node", "first_id", "n", "fp"), "node"))
    ids = family.select(F.col("first_id").alias("__id")).distinct()
    wanted = narrow.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = arrow(wanted.select("text"), members, "node binary, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sizes = checkpoint(family.groupBy("root").agg(F.greatest(F.count("*") / (TILE_TEXTS // 2), F.sum("n") / (TILE_SHINGLES // 2)).alias("tiles")))
    gathered = family.select("node", "root", "fp").join(sizes, "root").join(sets, "node")
    links_ = edges_of_groups(dealt_in_tiles(gathered, "root", "node", F.col("tiles")), "root", similarity, True)
    return rows.join(smallest_of(distinct.select("node", "first_id"), "node", components(links_)), "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs without the rows of a near-copy group but those with its smallest doc_id; all columns stay. What goes is named
    by id in a written table; texts move once to meet it and are not sorted for that. Rows that share a doc_id stay if
    any of them does."""
    other = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = similar_groups(docs, width, similarity, seed).groupBy("doc_id").agg(F.bool_and(other).alias("gone"))
    gone = materialize(found.where("gone").select(F.col("doc_id").alias("__id")), "near-copies")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")
