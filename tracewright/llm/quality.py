"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

1. Labellers look at a document and say "reject" or nothing. Some know shapes of junk (repetition, capitals, symbols,
   tables, repeated lines); three know vocabulary that the curated labels of a bounded sample mark as rejected, each
   learned from another fold or from other pieces of words, so that they overlap but err apart.
2. The votes of *all* documents are counted by pattern (at most 2^labellers rows) and expectation-maximisation over
   these counts estimates how often each labeller speaks on good and on bad documents, and how many are bad; no labels
   enter here. A pattern's posterior is the label of every document that shows it.
3. A bounded sample of documents, half from either side of posterior 1/2, trains a linear scorer by logistic loss over
   hashed pieces: words, word beginnings, and thresholds of shape measures. Buckets that few documents of the sample support
   get weight 0, so unknown words weigh nothing.
4. A held-out fold of the curated labels sets the threshold: the smallest that rejects at most MAX_FALSE of the good.

Bounds: MAX_LABELLED labelled and MAX_TRAIN posterior-labelled documents (lowest seeded hashes), either of at most
SAMPLE_BYTES of text, are fetched to the driver; everything else covers every document. Defined cases: null text is empty; an empty text has no pieces and scores the bias; rows that repeat
score alike; an empty table gives no rows; without any curated labels the vocabulary labellers stay silent and the
threshold is 0 (posterior 1/2); other columns are ignored, `keep_good` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, materialize, release, slices, utf8

MAX_LABELLED, MAX_TRAIN, SAMPLE_BYTES = 12000, 6000, 20 << 20
#: Share of the held-out good documents that may be rejected.
MAX_FALSE = 0.002
BITS = 18
MIN_SUPPORT = 8
SUPPORT, PURITY = 6, 0.95
PREFIXES = (4, 5)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_LIMIT = 1 << 22


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_P, -1, 1 << 64)


class Pieces:
    """Words and shapes of some documents joined into one buffer, found with array operations only."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.n = len(texts)
        self.doc_start = np.concatenate(([0], np.cumsum(sizes)))
        space = SPACE[data]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        self.start, self.stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        folded = FOLD[data].astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(data) + 1, _P), _powers(len(data) + 1, _INVERSE)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * up[:-1])))
        mix = lambda a, b: self._mix((sums[b] - sums[a]) * down[a])
        self.words = mix(self.start, self.stop)
        begins, docs = [], []
        for size in PREFIXES:
            long = self.stop - self.start >= size
            begins.append(mix(self.start[long], self.start[long] + size) ^ np.uint64(0x5555555555555555))
            docs.append(self.doc[long])
        self.prefixes, self.prefix_doc = np.concatenate(begins), np.concatenate(docs)
        self.counts = np.bincount(self.doc, minlength=self.n)
        total = np.maximum(sizes - 1, 1)
        per_doc = lambda marks: np.add.reduceat(marks.astype(np.int64), self.doc_start[:-1])
        upper = per_doc((data >= 65) & (data <= 90))
        lower = per_doc((data >= 97) & (data <= 122))
        symbols = per_doc(((data >= 33) & (data <= 47) & (data != 39) & (data != 44) & (data != 45) & (data != 46)) | ((data >= 60) & (data <= 64) & (data != 63)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126)))
        same = np.zeros(len(self.words), np.int64)
        same[1:] = (self.words[1:] == self.words[:-1]) & (self.doc[1:] == self.doc[:-1])
        n = np.maximum(self.counts, 1)
        runs = np.bincount(self.doc, same, self.n) / n
        pair = self.words.copy()
        pair[1:] += self.words[:-1] * np.uint64(0x9E3779B97F4A7C15)
        key = np.unique((pair & ~np.uint64(0xFFFFF)) | (self.doc.astype(np.uint64) & np.uint64(0xFFFFF)))
        distinct = np.bincount((key & np.uint64(0xFFFFF)).astype(np.int64), minlength=self.n) / n
        pipes = per_doc(data == 124) / n
        self.shapes = {
            "capitals": upper / np.maximum(upper + lower, 1),
            "symbols": symbols / total,
            "runs": runs,
            "distinct": distinct,
            "pipes": pipes,
        }

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def shape_votes(self) -> np.ndarray:
        s, enough = self.shapes, self.counts >= 8
        return np.stack([
            (s["capitals"] > 0.5) & enough,
            (s["symbols"] > 0.08) & enough,
            (s["runs"] > 0.2) & enough,
            (s["distinct"] < 0.4) & enough,
            (s["pipes"] > 0.1) & enough,
        ])

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, bucket), each pair once: words, beginnings of words, and thresholds that shapes pass."""
        shift = np.uint64(64 - BITS)
        doc = [self.doc, self.prefix_doc]
        bucket = [self.words >> shift, self.prefixes >> shift]
        for k, values in enumerate(self.shapes.values()):
            for step in range(1, 13):  # one piece per threshold passed
                passed = np.flatnonzero((values >= 0.05 * step) & (self.counts >= 8))
                doc.append(passed)
                bucket.append(self._mix(np.full(len(passed), 100 * (k + 1) + step, np.uint64)) >> shift)
        pairs = np.unique(np.concatenate(doc).astype(np.uint64) << np.uint64(BITS) | np.concatenate(bucket))
        return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


LABELLERS = ("capitals", "symbols", "runs", "distinct", "pipes", "words_a", "words_b", "beginnings")
#: Each group of labellers judges one way of being bad and has a weak-label model of its own: labellers of different
#: ways disagree on most bad documents, which one model would take for errors.
ASPECTS = ((2, 3), (0, 1, 4), (5, 6, 7))


@dataclass
class Lexicons:
    """Sorted 64-bit hashes: words of fold a, words of fold b, word beginnings of both."""

    words_a: np.ndarray
    words_b: np.ndarray
    beginnings: np.ndarray

    def votes(self, p: Pieces) -> np.ndarray:
        def any_in(values: np.ndarray, lexicon: np.ndarray, doc: np.ndarray) -> np.ndarray:
            if not len(lexicon):
                return np.zeros(p.n, bool)
            at = np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)
            return np.bincount(doc[lexicon[at] == values], minlength=p.n) > 0

        return np.stack([any_in(p.words, self.words_a, p.doc), any_in(p.words, self.words_b, p.doc), any_in(p.prefixes, self.beginnings, p.prefix_doc)])


def patterns(p: Pieces, lexicons: Lexicons) -> np.ndarray:
    votes = np.concatenate([p.shape_votes(), lexicons.votes(p)])
    return (votes.astype(np.int64) << np.arange(len(LABELLERS))[:, None]).sum(0)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def distinct_texts(p: Pieces) -> np.ndarray:
    """Marks the first of documents whose three smallest word hashes agree: copies and near copies count once."""
    order = np.lexsort((p.words, p.doc))
    first = np.cumsum(p.counts) - p.counts
    least = np.stack([np.where(p.counts > k, p.words[order][np.minimum(first + k, max(len(order) - 1, 0))] if len(order) else 0, np.uint64(k)) for k in range(3)], 1)
    keep = np.zeros(p.n, bool)
    keep[np.unique(least, axis=0, return_index=True)[1]] = True
    return keep


def learn_lexicons(texts: list[bytes], bad: np.ndarray) -> Lexicons:
    """Pieces of at least SUPPORT rejected documents of a fold, PURITY of the documents they are in being rejected.
    With a fifth of the documents rejected, six agreeing by chance is a matter of one piece in 15,000, and the linear
    scorer has to confirm it."""
    held: dict[tuple[int, str], list[np.ndarray]] = {}

    def collect(only_bad: bool, wanted: dict) -> None:
        """Per fold and kind, the pieces of bad documents; or of good ones, those that bad ones have as well."""
        for begin, end in chunks(texts):
            p = Pieces(texts[begin:end])
            own_bad = bad[begin:end] > 0
            keep, fold = distinct_texts(p) & (own_bad == only_bad), np.arange(p.n) % 2
            for kind, doc, values in (("word", p.doc, p.words), ("beginning", p.prefix_doc, p.prefixes)):
                for f in (0, 1):
                    use = keep[doc] & (fold[doc] == f)
                    if not only_bad:
                        at = np.minimum(np.searchsorted(wanted[f, kind], values), max(len(wanted[f, kind]) - 1, 0))
                        use &= (wanted[f, kind][at] == values) if len(wanted[f, kind]) else False
                    pairs = np.unique(np.stack([doc[use].astype(np.uint64), values[use]], 1), axis=0)
                    held.setdefault((f, kind), []).append(pairs[:, 1])

    collect(True, {})
    seen = {k: np.unique(np.concatenate(v), return_counts=True) for k, v in held.items()}
    seen = {k: (values[n >= SUPPORT], n[n >= SUPPORT]) for k, (values, n) in seen.items()}
    held = {}
    collect(False, {k: v for k, (v, _) in seen.items()})

    def pure(fold: int, kind: str) -> np.ndarray:
        values, k = seen[fold, kind]
        good, n = np.unique(np.concatenate(held[fold, kind]), return_counts=True)
        among = k.copy()
        among[np.searchsorted(values, good)] += n
        return values[k >= PURITY * among]

    return Lexicons(pure(0, "word"), pure(1, "word"), np.union1d(pure(0, "beginning"), pure(1, "beginning")))


# --- the weak-label model ----------------------------------------------------------------------------------------


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, members: tuple[int, ...], rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of "bad" for each vote pattern by the labellers in `members`, and the estimates: prior, how often each
    speaks on bad (`recall`) and on good documents (`false`), how often it is right when it speaks (`precision`)."""
    votes = (pattern[:, None] >> np.array(members)) & 1
    posterior = np.where(votes.sum(1) > 0, 0.9, 0.01)
    total = count.sum()
    for _ in range(rounds):
        bad, good = posterior * count, (1 - posterior) * count
        prior = (bad.sum() + 1) / (total + 2)
        recall = ((bad[:, None] * votes).sum(0) + 0.5) / (bad.sum() + 1)
        false = np.minimum(((good[:, None] * votes).sum(0) + 0.01) / (good.sum() + 1), recall * 0.5)
        log = lambda q: (votes * np.log(q) + (1 - votes) * np.log(1 - q)).sum(1)
        odds = np.log(prior) - np.log(1 - prior) + log(recall) - log(false)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done, posterior = np.abs(new - posterior).max(initial=0) < 1e-9, new
        if done:
            break
    return posterior, {"labellers": members, "prior": prior, "recall": recall, "false": false, "precision": prior * recall / (prior * recall + (1 - prior) * false)}


def weak_labels(pattern: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """Posterior of being bad in any way, and the estimates of each aspect."""
    good, estimates = np.ones(len(pattern)), []
    for members in ASPECTS:
        posterior, found = expectation_maximisation(pattern, count, members)
        good *= 1 - posterior
        estimates.append(found)
    return 1 - good, estimates


# --- the scorer --------------------------------------------------------------------------------------------------


def fit_linear(doc: np.ndarray, bucket: np.ndarray, target: np.ndarray, epochs: int = 150, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adagrad with L2; target is a posterior in [0, 1]. After each round but the last
    the buckets of small weight are given up, so that a long text does not gather a score from words without meaning."""
    support = np.bincount(bucket, minlength=1 << BITS)
    known = np.flatnonzero(support >= MIN_SUPPORT)
    n, out = len(target), np.zeros(1 << BITS)
    for r in range(rounds):
        column_of = np.full(1 << BITS, -1, np.int32)
        column_of[known] = np.arange(len(known))
        column = column_of[bucket]
        doc, bucket, column = doc[column >= 0], bucket[column >= 0], column[column >= 0]
        w, bias = np.zeros(len(known)), 0.0
        square, bias_square = np.full(len(known), 1e-6), 1e-6
        for _ in range(epochs):
            z = np.bincount(doc, w[column], n) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            gradient = np.bincount(column, error[doc], len(known)) / n + 1e-4 * w
            square += gradient**2
            w -= 0.5 * gradient / np.sqrt(square)
            bias_square += error.mean() ** 2
            bias -= 0.5 * error.mean() / np.sqrt(bias_square)
        if r + 1 < rounds:
            known = known[np.abs(w) > 0.2 * np.abs(w).max(initial=0)]
    out[known] = w
    return out, bias


@dataclass
class Model:
    lexicons: Lexicons
    posterior: np.ndarray
    estimates: list[dict]
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, p: Pieces) -> np.ndarray:
        doc, bucket = p.hashed()
        return np.bincount(doc, self.weights[bucket], p.n) + self.bias


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _each(run, names: list[str]):
    """A mapInArrow function that calls run(Pieces) -> arrays on texts of bounded size and puts doc_id before them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch, "text"), batch.column("doc_id")
            for a, b in slices(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *map(pa.array, run(Pieces(utf8(texts.slice(a, b - a).to_pylist()))))], names=["doc_id", *names])

    return go


def fetch(rows: DataFrame, chosen: list) -> list:
    """The texts of the chosen rows (doc_id, n_bytes, mark), in that order, as far as SAMPLE_BYTES reach, texts of over a
    64th of that passed over: [(text, mark)]."""
    ids, total = {}, 0
    for r in chosen:
        if r.n_bytes > SAMPLE_BYTES // 64:
            continue
        if total + r.n_bytes > SAMPLE_BYTES:
            break
        if r.doc_id not in ids:
            ids[r.doc_id] = (len(ids), r[2])
            total += r.n_bytes
    wanted = rows.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    found = {r.doc_id: r.text for r in rows.join(F.broadcast(wanted), "doc_id").collect()}  # at most MAX_LABELLED ids
    return [(found[k].encode(), mark) for k, (_, mark) in ids.items() if k in found]


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    rows = _narrow(docs)
    order = F.xxhash64("doc_id", F.lit(seed))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    marks = marks.where("bad IS NOT NULL AND doc_id IS NOT NULL").orderBy(order, "doc_id").limit(MAX_LABELLED)
    sizes = rows.select("doc_id", F.octet_length("text").alias("n_bytes")).join(marks, "doc_id").orderBy(order, "doc_id")
    curated = fetch(rows, sizes.limit(MAX_LABELLED).collect())
    held, taught = curated[::3], [x for i, x in enumerate(curated) if i % 3]
    lexicons = learn_lexicons([t for t, _ in taught], np.array([bad for _, bad in taught], float)) if taught else Lexicons(*[np.zeros(0, np.uint64)] * 3)

    voting = arrow(rows, _each(lambda p: [np.diff(p.doc_start) - 1, patterns(p, lexicons)], ["n_bytes", "pattern"]), "doc_id long, n_bytes long, pattern long")
    voted = materialize(voting, "votes")
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 2^labellers rows
    pattern, n = np.array([r.pattern for r in counts], np.int64), np.array([r.n for r in counts], float)
    known, estimates = weak_labels(pattern, n)
    posterior = np.zeros(1 << len(LABELLERS))
    posterior[pattern] = known

    # the sample: lowest seeded hashes from either side of posterior 1/2
    bad_patterns = [int(x) for x, q in zip(pattern, known, strict=True) if q >= 0.5]
    is_bad = F.col("pattern").isin(bad_patterns) if bad_patterns else F.lit(False)
    sides = [voted.where(side & F.col("doc_id").isNotNull()).orderBy(order, "doc_id", "pattern").limit(MAX_TRAIN // 2).collect() for side in (is_bad, ~is_bad)]
    chosen = [r for pair in zip_longest(*sides) for r in pair if r is not None]
    taken = fetch(rows, chosen)
    texts, docs_, buckets = [t for t, _ in taken], [], []
    for begin, end in chunks(texts):
        doc, bucket = Pieces(texts[begin:end]).hashed()
        docs_.append((doc + begin).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
    weights, bias = fit_linear(np.concatenate(docs_), np.concatenate(buckets), posterior[[k for _, k in taken]]) if taken else (np.zeros(1 << BITS), 0.0)
    model = Model(lexicons, posterior, estimates, weights, bias, 0.0)
    good = [t for t, bad in held if not bad]
    if good:
        scores = np.sort(np.concatenate([model.score(Pieces(good[a:b])) for a, b in chunks(good)]))
        model.threshold = max(0.0, float(scores[-1 - int(MAX_FALSE * len(scores))]) + 1e-9)
    return model


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_votes, posterior, score, kept: one row per row of docs."""
    model = model or train(docs, labels)

    def run(p: Pieces) -> list[np.ndarray]:
        pattern, score = patterns(p, model.lexicons), model.score(p)
        return [np.bitwise_count(pattern).astype(np.int32), model.posterior[pattern], score, score <= model.threshold]

    return arrow(_narrow(docs), _each(run, ["n_votes", "posterior", "score", "kept"]), "doc_id long, n_votes int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, all columns; scored where they lie, nothing is shuffled."""
    model = train(docs, labels)
    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        out, column = [], pa.array(texts, pa.string()).cast(pa.binary())
        for a, b in slices(column, 1 << 20):
            out.append(model.score(Pieces(utf8(column.slice(a, b - a).to_pylist()))) <= model.threshold)
        release()
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(kept(F.coalesce(F.col("text"), F.lit(""))))
