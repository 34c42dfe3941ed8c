"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source asks for its weight's share of the budget but may be repeated at most `max_epochs` times. Clamping the
sources above their cap and handing their excess to the others by weight, until none is above, ends at one water level:
target = min(cap, level * weight). The level needs no loop: with sources in order of cap / weight, the clamped ones are
a prefix, and the first prefix after which `rest of budget / rest of weight` stays under the next cap / weight is it
(clamping more sources than that only lowers the quotient, so it is the greatest that stays under).

A target is met by whole repetitions plus a seeded fraction: a source's rows are put in the order of a seeded digest,
and rows are taken while the middle of their size interval lies under fraction * source size. The running sum is made
in two steps (digest prefixes first, then within one prefix), so no task sees a whole source.

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources of size 0 get target
0 and their rows are taken 0 times; equal rows tie in the order, which changes no sum; an empty table gives no rows;
if every source is at its cap the budget is not reached. Other columns are carried along; columns named like an added
one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD_PATTERN

#: Hexadecimal digits of the digest that name a bucket of a source: 4096 buckets.
PREFIX_DIGITS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], budget_percent: int, max_epochs: int) -> DataFrame:
    """sizes(source, source_size) with weight, cap, target; one row per source throughout."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumn("budget", F.sum("source_size").over(everything) * budget_percent / F.lit(100.0))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    s = s.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(everything))
    water = F.col("level") * F.col("weight")
    return s.select("source", "source_size", "weight", "cap", F.when(F.col("level").isNull() | (water > F.col("cap")), F.col("cap").cast("double")).otherwise(water).alias("target"))


def mix(docs: DataFrame, weights: list[int], budget_percent: int = 150, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """docs plus size, source_size, target and repeats (0 .. max_epochs)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.withColumn("size", n_words()).withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    by_prefix = rows.groupBy("source", "prefix").agg(F.sum("size").alias("prefix_size"))
    aims = targets(by_prefix.groupBy("source").agg(F.sum("prefix_size").alias("source_size")), weights, budget_percent, max_epochs)
    earlier = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_prefix.withColumn("start", F.coalesce(F.sum("prefix_size").over(earlier), F.lit(0))).alias("p")
    starts = starts.join(aims.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source"))).select(F.col("p.source").alias("__source"), F.col("p.prefix").alias("__prefix"), "start", "source_size", "target")
    within = Window.partitionBy("source", "prefix").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.drop("source_size", "target", "start").withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("prefix") == F.col("__prefix")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    middle = 2 * (F.col("start") + F.col("inside")) + F.col("size")
    part = middle < 2 * (F.col("target") - F.floor(rate) * F.col("source_size"))
    repeats = (F.floor(rate) + F.when(part & (F.col("size") > 0), 1).otherwise(0)).cast("int")
    return placed.withColumn("repeats", F.least(F.when(F.col("size") > 0, repeats).otherwise(0), F.lit(max_epochs))).drop("digest", "prefix", "__source", "__prefix", "start", "inside")


def expand(mixed: DataFrame) -> DataFrame:
    """Each row as many times as it is taken."""
    return mixed.where("repeats > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).drop("__copy")


def sample(docs: DataFrame, weights: list[int], budget_percent: int = 150, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed rows with the columns of docs, each as often as it is taken. The mix is worked out on narrow rows; texts
    move once, to meet their repeats by (doc_id, digest of the text)."""
    key = F.xxhash64("text", F.lit(0)).alias("__text")
    narrow = docs.select("doc_id", "source", "text")
    mixed = mix(narrow.withColumn("__text", key), weights, budget_percent, max_epochs, seed)
    taken = mixed.where("repeats > 0").select(F.col("doc_id").alias("__id"), "__text", F.col("source").alias("__source"), F.col("repeats").alias("__repeats"))
    # rows that repeat in full share their repeats: dealt out evenly over them, what is left over to the first
    shared = taken.groupBy("__id", "__text", "__source").agg(F.sum("__repeats").alias("__total"))
    keyed = docs.withColumn("__key", F.xxhash64("text", F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")) & F.col("source").eqNullSafe(F.col("__source"))
    found = keyed.join(shared, same)
    among = Window.partitionBy("__id", "__text", "__source")
    n = F.count("*").over(among)
    nth = F.row_number().over(among.orderBy(F.lit(0)))
    times = F.floor(F.col("__total") / n) + F.when(nth <= F.col("__total") % n, 1).otherwise(0)
    out = found.withColumn("__times", times.cast("int")).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)
