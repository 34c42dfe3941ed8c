"""Conversation structure repair by cost layers of reachable grammar states.

A conversation's role initials must read `(s?(ua)+)?`. Rows are kept, given another role, or deleted, and empty rows can
be put in; each edit has a cost. For every turn, from the last to the first, and for every increasing cost, a bitset
holds the grammar states from which the rest of the conversation can be brought to its end at that cost at most: the
first layer that holds the start state gives the cost of the repair, and a walk along the bits, which takes the edit
with the least initial at every place, gives the least audit.

Costs from two states of one turn differ by little: a row put in or taken out leads from any state to any other that
matters. So a turn's layers are a short tuple above a base cost, and as few of them occur at all, the step from one
turn to the one before is looked up after its first use. A turn costs one look-up, however long the conversation.

A conversation is read as a stream in its order, first as narrow rows (what kind of turn) and then with its texts, so no
more than its kinds and layers, some hundred bytes per turn, are held; its texts go through SHA-256 as they come. One
shuffle by conversation serves the search for repeated rows, both readings and the hash, which by its nature reads a
conversation in order.

Defined cases: null role, text, turn or conv_id count as one space where rows are damaged, hashed and compared; rows of
one turn go by role, then by the MD5 of role and text (equal rows side by side); null turns come first. A conversation
without rows after damage has zeros, an empty audit and the hash of the empty string. Null conv_ids are one
conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrow

#: Edits in the order of their initials, and what they cost; an undeleted truncated row costs CUT more.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS, CUT = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}, 5
#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row; the bit of a state is 1 << it.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = 1 << START | 1 << ASSISTANT
#: Where the initial of a row leads from a state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that a row put in or given another role leads to: always a user or an assistant row, never a system row.
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Layers above the base that can still matter: two rows put in, and a system row deleted and not kept, are the most by
#: which one state's rest can cost more than another's.
DEPTH = 2 * COSTS[INSERT] + COSTS[INSERT] + COSTS[DELETE]

#: Kinds of turn: "-" must go, "s", "u", "a" or "x" (another initial) by role, in capitals if truncated; "." is not there.
KINDS = "-suaxSUAX."
Layers = tuple[int, ...]


def _before(states: int, lead: dict[int, int]) -> int:
    """States that an edit, which leads as given, brings into `states`."""
    return sum(1 << s for s, to in lead.items() if states >> to & 1)


def _closed(layers: list[int]) -> tuple[int, Layers]:
    """Base cost and layers, each holding the one below it and what a row put in brings to it; full ones at the top go."""
    for c in range(len(layers)):
        if c:
            layers[c] |= layers[c - 1]
        if c >= COSTS[INSERT]:
            layers[c] |= _before(layers[c - COSTS[INSERT]], GIVEN)
    base = next(i for i, x in enumerate(layers) if x)
    return base, tuple(layers[base : base + DEPTH + 1])


@lru_cache(maxsize=None)
def last() -> tuple[int, Layers]:
    """The layers after the last turn."""
    return _closed([ACCEPTING] + [0] * DEPTH)


@lru_cache(maxsize=1 << 16)
def step(layers: Layers, kind: str) -> tuple[int, Layers]:
    """(cost added to the base, layers) before a turn of this kind, from the layers after it."""
    out = [0] * (len(layers) + DEPTH)
    at = lambda c: layers[min(c, len(layers) - 1)] if c >= 0 else 0
    cut = CUT if kind.isupper() else 0
    kept = {s: NEXT[s, kind.lower()] for s in range(4) if (s, kind.lower()) in NEXT}
    for c in range(len(out)):
        out[c] = at(c - COSTS[DELETE])
        if kind != "-":
            out[c] |= _before(at(c - cut), kept) | _before(at(c - cut - COSTS[REROLE]), GIVEN)
    return _closed(out)


def _rest(layers: Layers, state: int) -> int | None:
    """What the rest costs from a state, above the base."""
    return next((c for c, states in enumerate(layers) if states >> state & 1), None)


def repair(kinds: str) -> tuple[int, str]:
    """(cost, audit) of the turns' kinds."""
    base, layers = last()
    trail = [(base, layers)]
    for kind in reversed(kinds):
        added, layers = step(layers, kind)
        base += added
        trail.append((base, layers))
    cost = base + _rest(layers, START)
    state, left, audit = START, cost, []
    while len(trail) > 1 or not (left == 0 and ACCEPTING >> state & 1):
        here_base, here = trail[-1]
        kind, (next_base, after) = (kinds[len(kinds) - len(trail) + 1], trail[-2]) if len(trail) > 1 else ("", (0, ()))
        cut = CUT if kind.isupper() else 0
        options = {INSERT: (GIVEN[state], COSTS[INSERT], here_base, here)}
        if kind:
            options[DELETE] = (state, COSTS[DELETE], next_base, after)
        if kind and kind != "-":
            options[REROLE] = (GIVEN[state], COSTS[REROLE] + cut, next_base, after)
            if (state, kind.lower()) in NEXT:
                options[KEEP] = (NEXT[state, kind.lower()], cut, next_base, after)
        for edit in sorted(options):
            to, price, then_base, then = options[edit]
            rest = _rest(then, to)
            if rest is not None and price + then_base + rest == left:
                break
        else:
            raise AssertionError("the layers do not lead to the end")
        audit.append(edit)
        state, left = to, left - price
        if edit != INSERT:
            trail.pop()
    return cost, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone` after the damage that crc32 of "conv_id:turn" names; dropped rows stay, marked."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    told = F.when(h == 1, "").when(h == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(h == 4, "user").otherwise(text("role"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), told.alias("text"), (h == 0).alias("gone"), h.alias("h"))
    twice = F.when(F.col("h") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return out.withColumn("__copy", F.explode(twice)).drop("__copy", "h")


def kind(seen: Column) -> Column:
    """The kind of a turn, one letter of KINDS; seen: whether its role and text were there before."""
    bare = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    first = F.substring("role", 1, 1)
    own = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return (
        F.when(F.col("gone"), ".").when(bare == "", "-b").when(seen, "-d")
        .when(bare.isin(".", "!", "?"), own).otherwise(F.upper(own))
    )


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, gone) -> one row per conv_id: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Rows that are gone only name their conversation."""
    order = [F.col("turn").asc_nulls_first(), "role", "md5", "nth"]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "gone", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")).alias("md5"))
    # one exchange: the window, the sort and the stream all find the rows of a conversation together
    dealt = rows.repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "md5").orderBy(F.col("turn").asc_nulls_first()))
    marked = dealt.withColumn("nth", nth).withColumn("kind", kind(F.col("nth") > 1))
    narrow = F.struct(F.lit(0).alias("reading"), F.lit(None).cast("string").alias("text"))
    wide = F.struct(F.lit(1).alias("reading"), F.col("text"))
    keep = ["conv_id", "turn", "role", "md5", "nth", "kind"]
    both = marked.withColumn("r", F.explode(F.when(F.col("gone"), F.array(narrow)).otherwise(F.array(narrow, wide)))).select(*keep, "r.reading", "r.text")
    stream = both.sortWithinPartitions("conv_id", "reading", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            for conv, reading, turn, role, text, k in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "reading", "turn", "role", "text", "kind")), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        out.append(state.result())
                    state = _Conversation(conv)
                if reading == 0:
                    state.turn(turn, role, k)
                else:
                    state.text(role, text)
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if state is not None:
            out.append(state.result())
        if out:
            yield _batch(out)

    return arrow(stream.select("conv_id", "reading", "turn", "role", "text", "kind"), run, RESULT)


class _Conversation:
    """What is held of one conversation while its rows pass: kinds of turns, counts, and the hash so far."""

    def __init__(self, conv):
        self.conv, self.kinds, self.audit, self.hash = conv, [], None, hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.low = self.high = self.before = None
        self.state, self.at, self.empty = START, 0, True

    def turn(self, turn: int | None, role: str, k: str) -> None:
        if k == ".":
            return
        self.blank += k == "-b"
        self.duplicate += k == "-d"
        self.truncated += k.isupper()
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.kinds.append(k[0])

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = repair("".join(self.kinds))

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def put_in(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.state, self.at = GIVEN[self.state], self.at + 1
            self.line("user" if self.state == USER else "assistant", "")

    def text(self, role: str, text: str) -> None:
        self.settle()
        self.put_in()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            self.state = NEXT[self.state, role[:1]]
            self.line(role, text)
        elif edit == REROLE:
            self.state = GIVEN[self.state]
            self.line("user" if self.state == USER else "assistant", text)

    def result(self) -> tuple:
        self.settle()
        self.put_in()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
