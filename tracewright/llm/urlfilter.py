"""URL filter by a character language-model ratio.

Rules judge the URLs they fit; the distinct URLs they allow and block are the labelled ones. From all of them two
variable-order Markov models of characters are counted, one per verdict. A character's probability after the longest
context seen is smoothed with all shorter ones (Witten-Bell). A URL no rule fits gets the difference of the two models'
log-likelihoods, divided by its length, and is allowed from a threshold on that is calibrated on a held-out quarter of
the labelled URLs, by seeded hashes, for balanced accuracy.

Counts are rows (window of characters, count per verdict) and so are probabilities, which go from level to level by
joins. A URL's windows meet theirs; logarithms are summed in whole units of 1 / UNITS, so reruns agree.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule and is scored as it is (null as
empty); if either verdict has no labelled URL every unfitted URL is allowed; rows that repeat are judged alike; an
empty table gives no rows; other columns are carried along, those named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

ORDER = 5
#: Parts of a natural logarithm that are summed, and ranges of hashes (a power of two) in which places are counted.
UNITS, BIN_BITS = 10**11, 12
START, STOP = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- rules -------------------------------------------------------------------------------------------------------


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


# --- models ------------------------------------------------------------------------------------------------------


class CharModel:
    """The model in memory, of a list of texts, as `ratios` has it in tables: log P(c | context) for every seen context + c, and log of what a context leaves to shorter ones."""

    def __init__(self, texts: list[str], order: int, alphabet: int):
        counts: dict[str, dict[str, int]] = {}
        for text in texts:
            text = START * order + text + STOP
            for i in range(order, len(text)):
                for n in range(order + 1):
                    after = counts.setdefault(text[i - n : i], {})
                    after[text[i]] = after.get(text[i], 0) + 1
        self.order, self.floor = order, -math.log(alphabet)
        self.grams: dict[str, float] = {}
        self.rest: dict[str, float] = {}
        for context in sorted(counts, key=len):
            after = counts[context]
            total, kinds = sum(after.values()), len(after)
            self.rest[context] = math.log(kinds / (total + kinds))
            for c, n in after.items():
                shorter = math.exp(self.log(context[1:], c)) if context else math.exp(self.floor)
                self.grams[context + c] = math.log((n + kinds * shorter) / (total + kinds))

    def log(self, context: str, c: str) -> float:
        left = 0.0
        while True:
            if (found := self.grams.get(context + c)) is not None:
                return left + found
            left += self.rest.get(context, 0.0)
            if not context:
                return left + self.floor
            context = context[1:]

    def score(self, text: str) -> float:
        """Log-likelihood of the text and its end."""
        text, n = START * self.order + text + STOP, self.order
        return sum(self.log(text[i - n : i], text[i]) for i in range(n, len(text)))


def texts(urls: DataFrame) -> DataFrame:
    """urls(u, ...) plus w: every window of ORDER + 1 characters that ends with a character of the URL or with its end."""
    padded = F.concat(F.lit(START * ORDER), "u", F.lit(STOP))
    windows = F.transform(F.sequence(F.lit(1), F.size("c") - ORDER), lambda i: F.array_join(F.slice("c", i, ORDER + 1), ""))
    return urls.withColumn("c", F.split(padded, "")).withColumn("w", F.explode(windows)).drop("c")


def numbered(labelled: DataFrame, seed: int) -> DataFrame:
    """labelled(u, v) plus i, the place (from 0) among its verdict's by seeded hash and URL, and many, their number. Places
    are counted in ranges of the hash and the ranges then summed up."""
    rows = labelled.withColumn("h", F.xxhash64("u", F.lit(seed))).withColumn("bin", F.shiftright("h", 64 - BIN_BITS))
    sizes = rows.groupBy("v", "bin").agg(F.count("*").alias("n"))  # 2 * 2 ** BIN_BITS rows at most
    whole = Window.partitionBy("v")
    before = sizes.withColumn("before", F.sum("n").over(whole.orderBy("bin")) - F.col("n")).withColumn("many", F.sum("n").over(whole)).drop("n")
    place = F.row_number().over(Window.partitionBy("v", "bin").orderBy("h", "u"))
    return rows.withColumn("place", place).join(before, ["v", "bin"]).select("u", "v", (F.col("before") + F.col("place") - 1).alias("i"), "many")


def ratios(windows: DataFrame, alphabet: int) -> DataFrame:
    """windows(w, allow, block: counts in the fitted URLs) -> w, d: the difference of its log-probabilities, in units."""
    levels = [windows]  # from the longest windows to single characters
    for _ in range(ORDER):
        levels.append(levels[-1].groupBy(F.expr("substring(w, 2)").alias("w")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    known = None
    for n, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.substring("w", 1, n))  # at most one row for each character of the alphabet
        for v in ("allow", "block"):
            level = level.withColumn(f"{v}_all", F.sum(v).over(context)).withColumn(f"{v}_kinds", F.count_if(F.col(v) > 0).over(context))
        if known is None:
            level = level.withColumn("p_allow", F.lit(1.0) / alphabet).withColumn("p_block", F.lit(1.0) / alphabet)
        else:
            level = level.withColumn("shorter", F.expr("substring(w, 2)")).join(known.withColumnRenamed("w", "shorter"), "shorter")
        p = lambda v: F.when(F.col(f"{v}_all") > 0, (F.col(v) + F.col(f"{v}_kinds") * F.col(f"p_{v}")) / (F.col(f"{v}_all") + F.col(f"{v}_kinds"))).otherwise(F.col(f"p_{v}"))
        known = level.select("w", p("allow").alias("p_allow"), p("block").alias("p_block"))
    return known.select("w", F.round((F.log("p_allow") - F.log("p_block")) * UNITS).cast("long").alias("d"))


def calibrated(scored: DataFrame) -> float:
    """scored(llr, ok) -> the threshold with the best balanced accuracy; of equal ones the middle of the widest gap. Running
    counts are made in each range of scores and the ranges then summed up."""
    cuts = scored.groupBy("llr").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    cuts = materialize(cuts.repartitionByRange("llr").withColumn("part", F.spark_partition_id()), "url-scores")
    by_part, inside = Window.orderBy("part"), Window.partitionBy("part").orderBy("llr")
    parts = cuts.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("llr").alias("least"))  # one row per partition
    parts = parts.select("part", (F.sum("g").over(by_part) - F.col("g")).alias("g0"), (F.sum("b").over(by_part) - F.col("b")).alias("b0"), F.lead("least").over(by_part).alias("next"))
    rows = cuts.withColumns({"g": F.sum("good").over(inside), "b": F.sum("bad").over(inside), "following": F.lead("llr").over(inside)}).join(parts, "part")
    total = cuts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()  # one row
    if not total.good or not total.bad:
        return 0.0
    rows = rows.select("llr", F.coalesce("following", "next").alias("following"), (F.col("g") + F.col("g0")).alias("g"), (F.col("b") + F.col("b0")).alias("b")).where("following IS NOT NULL")
    accuracy = (F.lit(total.good) - F.col("g")) / F.lit(total.good) + F.col("b") / F.lit(total.bad)
    best = rows.agg(F.max(F.struct(accuracy.alias("accuracy"), (F.col("following") - F.col("llr")).alias("gap"), (-F.col("llr")).alias("low"), ((F.col("llr") + F.col("following")) / 2).alias("cut"))).alias("best")).first()  # one row
    return best.best.cut if best.best else 0.0


# --- pages -------------------------------------------------------------------------------------------------------


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", seed: int = 3) -> DataFrame:
    """pages plus host, path, rule, verdict and llr (null where a rule decides)."""
    c = F.col
    host, path = parts(c(url).cast("string"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = match(c("host"), c("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).drop("llr")
    urls = rows.select(F.coalesce(c(url).cast("string"), F.lit("")).alias("u"), c("verdict").alias("v")).distinct()
    labelled = materialize(numbered(urls.where("v IS NOT NULL"), seed), "url-labels")
    told = {r.v for r in labelled.select("v").distinct().collect()}  # two rows at most
    if told != {"allow", "block"}:
        return rows.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("llr", F.lit(None).cast("double"))
    alphabet = labelled.select(F.explode(F.array_distinct(F.split("u", ""))).alias("c")).where("c <> ''").distinct().count() + 2
    fitted = texts(labelled.where("i % 4 <> 0 OR many < 4").select("u", "v")).groupBy("w").agg(F.count_if(c("v") == "allow").alias("allow"), F.count_if(c("v") == "block").alias("block"))
    open_ = urls.where("v IS NULL").select("u", "v").unionByName(labelled.where("i % 4 = 0").select("u", "v"))
    asked = materialize(open_.withColumn("id", F.monotonically_increasing_id()), "url-asked")
    windows = texts(asked.select("id", "u")).select("id", "w")
    zero = F.lit(0).cast("long")
    counts = windows.groupBy("w").agg(zero.alias("allow"), zero.alias("block")).unionByName(fitted).groupBy("w").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    known = materialize(ratios(materialize(counts, "url-windows"), alphabet), "url-ratios")
    sums = windows.join(known, "w").groupBy("id").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    scores = materialize(asked.join(sums, "id").select("u", "v", (c("d") / UNITS / c("n")).alias("llr")), "url-llr")
    threshold = calibrated(scores.where("v IS NOT NULL").select("llr", (c("v") == "allow").alias("ok")))
    found = scores.where("v IS NULL").select(c("u").alias("__u"), "llr")
    rows = rows.join(found, c("verdict").isNull() & (F.coalesce(c(url).cast("string"), F.lit("")) == c("__u")), "left").drop("__u")
    return rows.withColumn("verdict", F.coalesce("verdict", F.when(c("llr") >= threshold, "allow").otherwise("block")))
