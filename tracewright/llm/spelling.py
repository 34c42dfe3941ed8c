"""Spelling variant grouping by full neighbourhood generation.

Words are counted over whole texts. Every word then emits all its distinct deletions, replacements and insertions over
the observed alphabet, and what of them the vocabulary holds is near: the emission is exact, so no distance is ever
computed. Some hundred strings a word would be shuffled for that, were each looked up on its own. They need not be: an
edit in the second half of a word leaves its first half as it is, and one in the first half leaves the second. So
words, not candidates, are dealt out, by halves: a candidate is emitted where the words that share the untouched half
lie, and meets them in a hash set there. A word is listed under both halves for its own length and for a neighbour's
one longer or shorter: four narrow rows a word.

Every distinct candidate is emitted once: of the places whose deletion gives the same string the first is taken, of the
places for a letter that before its own run.

Words follow their forms to a root by pointer doubling; a form has at least twice the count, so rounds are few.

Defined cases: a null text has no runs, a null doc_id is written as "null" in the hash; ties between near words go to
the smallest in code-point order; repeated rows count as often as they are there; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow, as_bytes, checkpoint, materialize, slices, utf8

#: Runs are made of these after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: One run in so many loses a letter.
DAMAGE = 97
#: Different words that a task counts before it hands them on.
HELD = 200_000


def damaged(run: str, h: int) -> str:
    """The run without the code point that h names, if DAMAGE divides h."""
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the damaged, lower-cased runs of at least min_length code points and min_count occurrences. Counted in
    the task first, where a document's equal runs share one hash; shorter runs cannot become words and are passed over."""
    pattern = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch, "text")
            for a, b in slices(texts):
                for doc_id, text in zip(ids[a:b], utf8(texts.slice(a, b - a).to_pylist()), strict=True):
                    begin = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b"null:")
                    for word, n in Counter(pattern.findall(text.lower().decode())).items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % DAMAGE == 0:
                            word = damaged(word, h)
                            if len(word) < min_length:
                                continue
                        total[word] += n
                if len(total) >= HELD:
                    yield counted(total)
                    total = Counter()
        if total:
            yield counted(total)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletions(word: str, begin: int, end: int) -> Iterator[str]:
    """Distinct strings with one letter less, the letter from places [begin, end)."""
    for i in range(begin, end):
        if not i or word[i] != word[i - 1]:
            yield word[:i] + word[i + 1 :]


def replacements(word: str, begin: int, end: int, alphabet: Iterable[str]) -> Iterator[str]:
    for i in range(begin, end):
        head, own, tail = word[:i], word[i], word[i + 1 :]
        for c in alphabet:
            if c != own:
                yield head + c + tail


def insertions(word: str, begin: int, end: int, alphabet: Iterable[str]) -> Iterator[str]:
    """Distinct strings with one letter more, put before places [begin, end) of the word or at its end."""
    for i in range(begin, end):
        head, tail, before = word[:i], word[i:], word[i - 1] if i else ""
        for c in alphabet:
            if c != before:
                yield head + c + tail


def near_words(words: dict[str, int], own: list[str], second: bool) -> Iterator[tuple[str, int, str, int]]:
    """(word, how many near words, the foremost of them, its count) for those of `own` with near words among `words`,
    all of which share a half; edits lie in the other half, the second one or the first."""
    alphabet = sorted({c for w in words for c in w})
    for word in own:
        half = len(word) // 2
        begin, end = (half, len(word)) if second else (0, half)
        found = [c for c in deletions(word, begin, end) if c in words]
        found += [c for c in replacements(word, begin, end, alphabet) if c in words]
        found += [c for c in insertions(word, begin, end + second, alphabet) if c in words]
        if found:
            best = min(found, key=lambda c: (-words[c], c))
            yield word, len(found), best, words[best]


def near_counts(words: DataFrame) -> DataFrame:
    """word, n_near, near (its foremost near word), near_n; words without near words are left out."""
    size, odd = F.length("word"), F.length("word") % 2 == 1
    low, high = F.floor(size / 2), F.ceil(size / 2)

    def listed(side: str, length, own: bool):
        text = F.substring("word", F.lit(1), length) if side == "p" else F.substring("word", size - length + 1, length)
        return F.struct(F.lit(side).alias("side"), text.alias("half"), F.lit(own).alias("own"))

    # own: the half that edits of this word leave; the other is what edits of a word one shorter or longer leave
    prefix = [listed("p", low, True), listed("p", F.when(odd, low + 1).otherwise(low - 1), False)]
    suffix = [listed("s", high, True), listed("s", F.when(odd, high - 1).otherwise(high + 1), False)]
    rows = words.select("word", "n", F.explode(F.array(*prefix, *suffix)).alias("at")).select("at.side", "at.half", "at.own", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("side", "half", "word", "n", "own")), strict=True))
        for (side, _), group in groupby(rows, itemgetter(0, 1)):
            members = list(group)
            if len(members) > 1:
                out += near_words({w: n for _, _, w, n, _ in members}, [w for _, _, w, _, own in members if own], side == "p")
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    found = arrow(rows.repartition("side", "half").sortWithinPartitions("side", "half"), run, "word string, n_near long, near string, near_n long")
    # -bytes would order strings the wrong way round, so ties are settled by a minimum of (-n, word)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", F.col("b.w").alias("near"), (-F.col("b.m")).alias("near_n"))


def _batch(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n_near", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: where following forms ends. Each round doubles the way covered; counts double
    along it, so there are no circles, and 64-bit counts end after six rounds."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        moved = checkpoint(at.join(step, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form (its near word of largest n, if that is `ratio` times its own n), form_n, root."""
    words = materialize(vocabulary(docs, min_length, min_count), "vocabulary")
    near = near_counts(words)
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    out = materialize(out, "near")
    ends = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
