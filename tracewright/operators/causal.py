"""Causal graphs of traces: who wrote what a step reads, what a goal needs, what a procedure asks for and offers."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S


def last_writer(accesses: DataFrame) -> DataFrame:
    """accesses(trace_id, resource, position, reads, writes) -> plus writer: position of the latest earlier write to the
    same resource of the trace. An as-of join in one window pass: a step's own write does not count for its read."""
    before = Window.partitionBy("trace_id", "resource").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return accesses.withColumn("writer", F.last(F.when(F.col("writes"), F.col("position")), ignorenulls=True).over(before))


def flow_edges(accesses: DataFrame) -> DataFrame:
    """trace_id, src, dst, resource: one edge per read of a resource written before."""
    found = last_writer(accesses).where("reads AND writer IS NOT NULL")
    return found.select("trace_id", F.col("writer").alias("src"), F.col("position").alias("dst"), "resource").distinct()


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared edges with an end that is no node of their trace, or that go from a node to itself."""
    n = nodes.select("trace_id", "position")
    ok = edges.where("src <> dst").join(n.withColumnRenamed("position", "src"), ["trace_id", "src"], "left_semi").join(n.withColumnRenamed("position", "dst"), ["trace_id", "dst"], "left_semi")
    return edges.join(ok, ["trace_id", "src", "dst"], "left_anti")


def ancestors(spark_edges: DataFrame, roots: DataFrame, rounds: int = 16) -> DataFrame:
    """trace_id, position: the roots and all they depend on. Breadth first; a round joins only the nodes found in the
    last one, and cuts its lineage. What is still open after `rounds` goes on over edges with shortcuts, so that a chain
    of n steps takes log n rounds more; at four times as many rounds, and so on, they are laid anew through what is not
    found."""
    from tracewright.sources.tables import checkpoint

    edges = spark_edges.select("trace_id", "src", "dst").where("src <> dst")
    ways = edges
    found = frontier = checkpoint(roots.select("trace_id", "position").distinct())
    for n in itertools.count(1):
        step = frontier.withColumnRenamed("position", "dst").join(ways, ["trace_id", "dst"]).select("trace_id", F.col("src").alias("position")).distinct()
        frontier = checkpoint(step.join(found, ["trace_id", "position"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = checkpoint(found.unionByName(frontier))
        if n == rounds:
            rounds *= 4
            seen = found.withColumnRenamed("position", "src")
            still = edges.join(frontier.select("trace_id").distinct(), "trace_id", "left_semi").join(seen, ["trace_id", "src"], "left_anti")
            ways = shortcuts(still, n)


def shortcuts(edges: DataFrame, seed: int) -> DataFrame:
    """The edges, and from every node the way over 2, 4, 8, ... steps when each node follows one predecessor, picked by a
    seeded hash: at most log2(nodes of the largest trace) rows a node more. Each level is the last one joined to itself."""
    from tracewright.sources.tables import checkpoint

    edges = checkpoint(edges.select("trace_id", "src", "dst").distinct())
    longest = edges.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    jump = checkpoint(edges.groupBy("trace_id", "dst").agg(F.max_by("src", F.struct(F.xxhash64("src", F.lit(seed)), "src")).alias("src")))
    out = edges
    for _ in range(longest.bit_length()):
        on = jump.select("trace_id", F.col("dst").alias("src"), F.col("src").alias("__src"))
        jump = checkpoint(jump.join(on, ["trace_id", "src"]).select("trace_id", F.col("__src").alias("src"), "dst").where("src <> dst"))
        if jump.isEmpty():
            break
        out = out.unionByName(jump)
    return checkpoint(out.distinct())


def on_cycles(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """trace_id, position of nodes left when nodes without predecessors are peeled off again and again (Kahn): those on
    cycles and behind them. What is not settled after `rounds` is found as the cycles and all that depends on them."""
    left, settled = trimmed(edges, rounds, both=False)
    if settled:
        return ends(left)
    return ancestors(left.select("trace_id", F.col("dst").alias("src"), F.col("src").alias("dst")), cyclic(left), rounds)


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("trace_id", F.col("src").alias("position")).unionByName(edges.select("trace_id", F.col("dst").alias("position"))).distinct()


def trimmed(edges: DataFrame, rounds: int, both: bool) -> tuple[DataFrame, bool]:
    """The edges left after `rounds` of dropping those whose source has no predecessor (both: or whose target has no
    successor), and whether nothing more would go."""
    from tracewright.sources.tables import checkpoint

    left = checkpoint(edges.select("trace_id", "src", "dst").distinct())
    n = left.count()
    for _ in range(rounds):
        if n == 0:
            return left, True
        kept = left.join(left.select("trace_id", F.col("dst").alias("src")).distinct(), ["trace_id", "src"], "left_semi")
        if both:
            kept = kept.join(left.select("trace_id", F.col("src").alias("dst")).distinct(), ["trace_id", "dst"], "left_semi").select("trace_id", "src", "dst")
        left = checkpoint(kept)
        n, before = left.count(), n
        if n == before:
            return left, True
    return left, n == 0


def cyclic(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """trace_id, position of the nodes that lie on a cycle, a self-edge included. Positions order a trace, so each cycle
    holds the target of an edge against the order in which most of the trace's edges run; a trace without such edges is
    done. Of these targets every node takes the largest label (a seeded hash) that reaches it, as its colour; the nodes
    of a colour that reach its root are one strongly connected component, a cycle if they are more than one. Components
    and edges between colours go, the rest is coloured anew. No node is paired with every root."""
    from tracewright.sources.tables import checkpoint

    out = [checkpoint(edges.where("src = dst").select("trace_id", F.col("src").alias("position")).distinct())]
    left, _ = trimmed(edges.where("src <> dst"), rounds, both=True)
    for seed in itertools.count():
        starts = checkpoint(against_the_order(left))
        if starts.isEmpty():
            return functools.reduce(DataFrame.unionByName, out).distinct()
        ways = shortcuts(left, seed)
        coloured = colours(ways, starts, seed)
        at = lambda end: coloured.select("trace_id", F.col("position").alias(end), F.col("colour").alias(f"__{end}"))
        one = lambda rows: rows.join(at("src"), ["trace_id", "src"]).join(at("dst"), ["trace_id", "dst"]).where("__src = __dst").select(F.struct("trace_id", F.col("__src").alias("colour")).alias("trace_id"), "src", "dst")
        roots = coloured.where("position = colour.position").select(F.struct("trace_id", "colour").alias("trace_id"), "position")
        # whatever lies between two nodes of a colour is of that colour, so shortcuts between them stay inside
        component = ancestors(checkpoint(one(ways)), roots, rounds=64)
        large = component.groupBy("trace_id").count().where("count > 1").select("trace_id")
        out.append(checkpoint(component.join(large, "trace_id", "left_semi").select("trace_id.trace_id", "position")))
        inside = one(left)
        for end in ("src", "dst"):
            inside = inside.join(component.withColumnRenamed("position", end), ["trace_id", end], "left_anti")
        left, _ = trimmed(inside.select("trace_id.trace_id", "src", "dst"), rounds, both=True)


def against_the_order(edges: DataFrame) -> DataFrame:
    """trace_id, position: the targets of the edges that run against the direction of most edges of their trace."""
    down = edges.withColumn("down", F.col("src") > F.col("dst"))
    most = down.groupBy("trace_id").agg((F.count_if("down") * 2 > F.count("*")).alias("most"))
    return down.join(most, "trace_id").where("down <> most").select("trace_id", F.col("dst").alias("position")).distinct()


def colours(ways: DataFrame, starts: DataFrame, seed: int) -> DataFrame:
    """trace_id, position, colour: the largest (hash, position) of the starts that reach the node, itself included; nodes
    that none reaches are left out. Labels move along the ways until none changes."""
    from tracewright.sources.tables import checkpoint

    label = F.struct(F.xxhash64("position", F.lit(seed)).alias("hash"), "position")
    told = checkpoint(starts.withColumn("colour", label))
    while True:
        sent = told.withColumnRenamed("position", "src").join(ways, ["trace_id", "src"]).select("trace_id", F.col("dst").alias("position"), "colour")
        both = told.withColumn("own", F.col("colour")).unionByName(sent, allowMissingColumns=True)
        after = checkpoint(both.groupBy("trace_id", "position").agg(F.max("colour").alias("colour"), F.max("own").alias("own")))
        told = after.select("trace_id", "position", "colour")
        if after.where("own IS NULL OR colour <> own").isEmpty():
            return told


def slice_steps(nodes: DataFrame, retained: DataFrame) -> DataFrame:
    """The steps of the procedure: proven ones, and those that succeeded and are neither irrelevant nor on a failed
    branch. nodes(trace_id, position, succeeded, irrelevant, failed_branch) -> plus ordinal and uncertain_necessity."""
    r = retained.select("trace_id", "position").withColumn("proven", F.lit(True))
    n = nodes.join(r, ["trace_id", "position"], "left").withColumn("proven", F.coalesce("proven", F.lit(False)))
    kept = n.where("NOT failed_branch AND (proven OR (succeeded AND NOT irrelevant))")
    order = Window.partitionBy("trace_id").orderBy("position")
    return kept.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("uncertain_necessity", ~F.col("proven")).drop("proven")


def induced(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges with both ends among the steps."""
    s = steps.select("trace_id", "position")
    return edges.join(s.withColumnRenamed("position", "src"), ["trace_id", "src"], "left_semi").join(s.withColumnRenamed("position", "dst"), ["trace_id", "dst"], "left_semi")


def requirements(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, resource, steps: reads that no step of the procedure feeds."""
    fed = edges.select("trace_id", F.col("dst").alias("position"), "resource")
    return accesses.where("reads").join(fed, ["trace_id", "position", "resource"], "left_anti").groupBy("trace_id", "resource").agg(F.count_distinct("position").alias("steps"))


def provisions(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, resource, steps: writes that no step consumes; two steps providing one resource is an error, reported
    as steps > 1."""
    used = edges.select("trace_id", F.col("src").alias("position"), "resource")
    return accesses.where("writes").join(used, ["trace_id", "position", "resource"], "left_anti").groupBy("trace_id", "resource").agg(F.count_distinct("position").alias("steps"))


def resolve_contracts(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """calls(call_id, name, version) -> call_id, contract_id, opaque. The contract of the very version, else the highest
    version whose range [minimum, maximum) holds the called one, else opaque. contracts(contract_id, name, version,
    minimum, maximum), ordered comparable versions. Each different (name, version) is resolved once, however many calls
    make it; the answer is joined back by equality. Of several rows of one call the best answer counts."""
    k = contracts.select("contract_id", F.col("name").alias("__name"), F.col("version").alias("__version"), "minimum", "maximum")
    fits = (F.col("name") == F.col("__name")) & ((F.col("version") == F.col("__version")) | ((F.col("version") >= F.col("minimum")) & (F.col("version") < F.col("maximum"))))
    rank = F.struct((F.col("version") == F.col("__version")).alias("exact"), F.col("__version").alias("v"), F.col("contract_id").alias("id"))
    best = calls.select("name", "version").distinct().join(k, fits).groupBy("name", "version").agg(F.max(rank).alias("best"))
    found = calls.join(best, ["name", "version"], "left").groupBy("call_id").agg(F.max("best")["id"].alias("contract_id"))
    return found.withColumn("opaque", F.col("contract_id").isNull())


def goal_verifiers(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """trace_id, predicate, verifiers: steps that succeeded and prove the predicate by themselves or by the evidence's
    verifier. evidence(trace_id, predicate, verifier); nodes(trace_id, position, succeeded, predicates, methods)."""
    good = nodes.where("succeeded")
    by_predicate = good.select("trace_id", "position", F.explode("predicates").alias("predicate"))
    by_method = good.select("trace_id", "position", F.explode("methods").alias("verifier"))
    e = evidence.select("trace_id", "predicate", "verifier").distinct()
    hits = e.join(by_predicate, ["trace_id", "predicate"]).select("trace_id", "predicate", "position")
    hits = hits.unionByName(e.join(by_method, ["trace_id", "verifier"]).select("trace_id", "predicate", "position"))
    return hits.groupBy("trace_id", "predicate").agg(F.array_sort(F.collect_set("position")).alias("verifiers"))


def resource_identity(tenant, namespace, kind, value):
    return S.nul_hash(tenant, namespace, kind, value)


def contained_in_order(rows: DataFrame) -> DataFrame:
    """rows(planned, executed) arrays; executed of struct(contract, read_only) -> plus folds: planned is a subsequence of
    what was executed and every step beyond it only reads."""
    start = F.struct(F.lit(0).alias("next"), F.lit(True).alias("ok"))

    def step(s, x):
        expected = F.get(F.col("planned"), s["next"])
        hit = F.coalesce(expected == x["contract"], F.lit(False))
        return F.struct((s["next"] + hit.cast("int")).alias("next"), (s["ok"] & (hit | x["read_only"])).alias("ok"))

    return rows.withColumn("folds", F.aggregate("executed", start, step, lambda s: s["ok"] & (s["next"] == F.size("planned"))))
