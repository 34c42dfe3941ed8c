"""Composition: which versions fit together, and plans and schedules made of them.

The compatibility graph is a join. Planning and scheduling are sequential searches over at most a hundred candidates of
one request; they run as grouped functions, one group per request, and never see more than one request's rows."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import canonical


#: Parts that the targets of one kind of requirement are dealt into, so that a frequent kind is no single task.
PARTS = 16


def _sides(provisions: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, provision_id, offer), (target, requirement_id, ask): those that can fit anything."""
    known = "schema <> '' AND resource IS NOT NULL AND predicates IS NOT NULL"
    kind = F.struct("resource", "schema", F.array_sort(F.array_distinct("predicates")).alias("predicates"))
    p = provisions.where(known).select(F.col("version_id").alias("source"), "provision_id", kind.alias("offer"))
    return p, requirements.where(known).select(F.col("version_id").alias("target"), "requirement_id", kind.alias("ask"))


def _fits(p: DataFrame, r: DataFrame, rules: DataFrame | None) -> DataFrame:
    """offer, ask: kinds that fit, each pair once, however many versions are of a kind."""
    o = p.select("offer").distinct().select("offer", "offer.resource", F.col("offer.schema").alias("provided"))
    a = r.select("ask").distinct().select("ask", "ask.resource", F.col("ask.schema").alias("required"))
    if rules is None:
        pairs = o.withColumn("required", F.col("provided")).join(a, ["resource", "required"])
    else:
        known = rules.select("provided", "required").distinct().withColumn("ruled", F.lit(True))
        pairs = o.join(a, "resource").join(known, ["provided", "required"], "left").where("provided = required OR ruled")
    return pairs.where(F.size(F.array_except("ask.predicates", "offer.predicates")) == 0).select("offer", "ask")


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def compatibility(provisions: DataFrame, requirements: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """source, target, provision_ids, requirement_ids. provisions(version_id, provision_id, resource, schema, predicates);
    requirements(version_id, requirement_id, resource, schema, predicates); rules(provided, required) name schemas that
    fit though they differ. A blank schema never fits; what is guaranteed must cover what is asked.

    Kinds are matched first, so only pairs that fit are made. A pair whose versions have one kind each is made once and
    needs no grouping; only pairs of versions with several kinds are gathered."""
    p, r = _sides(provisions, requirements)
    several = lambda key: F.count("*").over(Window.partitionBy(key)) > 1
    s = p.groupBy("source", "offer").agg(F.array_sort(F.collect_set("provision_id")).alias("provision_ids")).withColumn("__many", several("source"))
    t = r.groupBy("target", "ask").agg(F.array_sort(F.collect_set("requirement_id")).alias("requirement_ids")).withColumn("__some", several("target"))
    n = _partitions(p)
    s = s.join(_fits(p, r, rules), "offer").drop("offer").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    t = t.withColumn("__part", F.pmod(F.xxhash64("target"), F.lit(PARTS)).cast("int"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """The number of partitions is given: inputs are small against what they make, so their size must not set it."""
        met = left.repartition(n, "ask", "__part").join(right.repartition(n, "ask", "__part"), ["ask", "__part"])
        return met.where("source <> target").select("source", "target", "provision_ids", "requirement_ids")

    one = pairs(s.where("NOT __many"), t.where("NOT __some"))
    more = pairs(s.where("__many"), t).unionByName(pairs(s.where("NOT __many"), t.where("__some")))
    whole = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return one.unionByName(more.groupBy("source", "target").agg(whole("provision_ids"), whole("requirement_ids")))


def target_counts(provisions: DataFrame, requirements: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """source, targets: how many targets `compatibility` gives each source that has any. Versions with the same kinds are
    counted together, so no pair of versions is made."""
    p, r = _sides(provisions, requirements)
    fits = _fits(p, r, rules)
    kinds = lambda rows, key, kind: rows.groupBy(key).agg(F.array_sort(F.collect_set(kind)).alias(f"{kind}s"))
    s, t = kinds(p, "source", "offer"), kinds(r, "target", "ask").groupBy("asks").agg(F.count("*").alias("n"))
    met = s.select("offers").distinct().select("offers", F.explode("offers").alias("offer")).join(fits, "offer").join(t.select("asks", "n", F.explode("asks").alias("ask")), "ask")
    totals = met.select("offers", "asks", "n").distinct().groupBy("offers").agg(F.sum("n").alias("targets"))
    own = p.join(r, F.col("source") == F.col("target")).join(fits, ["offer", "ask"]).select("source").distinct().withColumn("__own", F.lit(1))
    out = s.join(totals, "offers").join(own, "source", "left").withColumn("targets", F.col("targets") - F.coalesce("__own", F.lit(0)))
    return out.where("targets > 0").select("source", "targets")


def neighbours(provisions: DataFrame, requirements: DataFrame, members: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """`adjacent` over the edges of `compatibility`, without making them: a plan's members reach kinds, and kinds reach the
    versions of them. An edge from a member to itself leads to a member, so it adds nothing."""
    p, r = _sides(provisions, requirements)
    fits, c = _fits(p, r, rules), F.col
    m = members.select("plan_id", "version_id")
    gives, takes = p.select(c("source").alias("version_id"), "offer").distinct(), r.select(c("target").alias("version_id"), "ask").distinct()
    reached = lambda near, far, kind, other: m.join(near, "version_id").select("plan_id", kind).distinct().join(fits, kind).select("plan_id", other).distinct().join(far, other).select("plan_id", "version_id")
    both = reached(gives, takes, "offer", "ask").unionByName(reached(takes, gives, "ask", "offer")).distinct()
    return both.join(m, ["plan_id", "version_id"], "left_anti")


def over_limit(provisions: DataFrame, most: int = 128) -> DataFrame:
    """Resources with more providers than a graph may have: counted before the join is made."""
    return provisions.groupBy("resource").agg(F.count("*").alias("providers")).where(F.col("providers") > most)


def adjacent(edges: DataFrame, members: DataFrame) -> DataFrame:
    """plan_id, version_id one hop in either direction from a plan's members and not among them."""
    a = members.join(edges.select(F.col("source").alias("version_id"), F.col("target").alias("next")), "version_id")
    b = members.join(edges.select(F.col("target").alias("version_id"), F.col("source").alias("next")), "version_id")
    both = a.select("plan_id", F.col("next").alias("version_id")).unionByName(b.select("plan_id", F.col("next").alias("version_id"))).distinct()
    return both.join(members, ["plan_id", "version_id"], "left_anti")


def _clash(a: str, b: str) -> Column:
    """Whether two nodes may not run side by side: one is serial, both hold a mutex, or one changes what the other uses."""
    of = lambda x, *names: F.concat(*[F.coalesce(f"{x}.{name}", F.array()) for name in names])
    meets = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    changes, uses = ("writes", "exclusive"), ("reads", "writes", "exclusive")
    serial = F.coalesce(f"{a}.serial", F.lit(False)) | F.coalesce(f"{b}.serial", F.lit(False))
    return serial | meets(of(a, *changes), of(b, *uses)) | meets(of(b, *changes), of(a, *uses)) | meets(of(a, "mutexes"), of(b, "mutexes"))


def conflicts(facts: DataFrame) -> DataFrame:
    """plan_id, left, right: pairs of a plan's nodes that may not run side by side. facts(plan_id, version_id, reads,
    writes, exclusive, mutexes, serial). A plan has at most a few dozen nodes, so its nodes are joined on the plan and
    compared as they meet: both sides and the last step share one shuffle by plan."""
    l, r = facts.alias("l"), facts.alias("r")
    found = l.join(r, (F.col("l.plan_id") == F.col("r.plan_id")) & (F.col("l.version_id") < F.col("r.version_id")) & _clash("l", "r"))
    return found.select(F.col("l.plan_id").alias("plan_id"), F.col("l.version_id").alias("left"), F.col("r.version_id").alias("right")).distinct()


def conflicting(facts: DataFrame) -> DataFrame:
    """plan_id, version_id, conflicting: every node with the earlier nodes it may not run beside, by the same one shuffle."""
    l, r = facts.alias("l"), facts.alias("r")
    met = l.join(r, (F.col("l.plan_id") == F.col("r.plan_id")) & (F.col("r.version_id") < F.col("l.version_id")) & _clash("l", "r"), "left")
    return met.groupBy(F.col("l.plan_id").alias("plan_id"), F.col("l.version_id").alias("version_id")).agg(F.collect_set("r.version_id").alias("conflicting"))


# --- plans -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Planner:
    beam: int = 32
    depth: int = 8
    procedures: int = 8
    bridges: int = 4
    tool_cost: int = 4096
    expansions: int = 10_000
    novelty_penalty: int = 100
    edge_penalty: int = 100


def topological(nodes: set, edges: list[tuple]) -> list | None:
    """Kahn's order, the smallest ready id first; None on a cycle."""
    waiting = {n: {a for a, b in edges if b == n} for n in nodes}
    out: list = []
    while waiting:
        ready = sorted(n for n, before in waiting.items() if not before)
        if not ready:
            return None
        out.append(ready[0])
        del waiting[ready[0]]
        for before in waiting.values():
            before.discard(ready[0])
    return out


class Listed:
    """Edges that are listed one by one."""

    def __init__(self, edges: list[dict]):
        self.out: dict = {}
        self.near: dict = {}
        for e in edges:
            self.out.setdefault(e["source"], {}).setdefault(e["target"], []).append(e)
            self.near.setdefault(e["source"], set()).add(e["target"])
            self.near.setdefault(e["target"], set()).add(e["source"])

    def beside(self, node) -> set:
        return self.near.get(node, set())

    def inside(self, nodes: frozenset) -> list[dict]:
        return [e for a in nodes if (out := self.out.get(a)) for b in nodes if b in out for e in out[b]]


class Later:
    """Edges told by what candidates give and take: a candidate feeds all later ones (by `at`) that take what it gives.
    They are worked out for the nodes asked about, so their number, which grows with the square, costs nothing."""

    def __init__(self, candidates: list[dict]):
        self.gives, self.takes, self.at, self.givers, self.takers = {}, {}, {}, {}, {}
        for c in candidates:
            v = c["version_id"]
            self.at[v], self.gives[v], self.takes[v] = c["at"], set(c["gives"]), {}
            for t in c["takes"]:
                self.takes[v].setdefault(t["resource"], set()).add(t["requirement_id"])
            for x in self.gives[v]:
                self.givers.setdefault(x, set()).add(v)
            for x in self.takes[v]:
                self.takers.setdefault(x, set()).add(v)

    def beside(self, node) -> set:
        if node not in self.at:
            return set()
        at = self.at[node]
        after = {v for x in self.gives[node] for v in self.takers.get(x, ()) if self.at[v] > at}
        return after | {v for x in self.takes[node] for v in self.givers.get(x, ()) if self.at[v] < at}

    def inside(self, nodes: frozenset) -> list[dict]:
        found = ((a, b, self.gives[a] & self.takes[b].keys()) for a in nodes for b in nodes if self.at[a] < self.at[b])
        return [{"source": a, "target": b, "requirement_ids": set().union(*[self.takes[b][x] for x in met])} for a, b, met in found if met]


def _state(p: Planner, by_id: dict, edges: Listed | Later, goals: set, satisfied: set, nodes: frozenset) -> dict | None:
    inside = edges.inside(nodes)
    order = topological(set(nodes), [(e["source"], e["target"]) for e in inside])
    if order is None:
        return None
    chosen = [by_id[n] for n in order]
    met = satisfied.union(*[e["requirement_ids"] for e in inside])
    bridges = sum(not c["seed"] for c in chosen)
    tools = sum(c["tool_cost"] for c in chosen)
    if bridges > p.bridges or tools > p.tool_cost:
        return None
    unseen = sum(not (by_id[e["source"]]["observed"] and by_id[e["target"]]["observed"]) for e in inside)
    strength = max(0, min(c["evidence_strength"] for c in chosen) - bridges * p.novelty_penalty - unseen * p.edge_penalty)
    covered = goals & {g for c in chosen for g in c["goals"]}
    gaps = sorted([("uncovered_goal", "", "", g) for g in goals - covered] + [("unsatisfied_requirement", c["version_id"], r, "") for c in chosen for r in c["requirements"] if r not in met])
    plan = {"nodes": order, "edges": sorted(f"{e['source']}>{e['target']}" for e in inside), "goals": sorted(covered), "gaps": ["|".join(map(str, g)) for g in gaps]}
    risk, observed = sum(c["risk_cost"] for c in chosen), all(c["observed"] for c in chosen)
    digest = canonical.identity(plan)
    rank = (bool(gaps), -len(covered), -strength, not observed, -len(met), risk, tools, len(order), digest)
    return plan | {"set": nodes, "rank": rank, "complete": not gaps, "strength": strength, "risk": risk, "tools": tools, "hash": digest}


def beam_search(p: Planner, candidates: list[dict], edges: list[dict] | Later, goals: set, satisfied: set) -> tuple[dict | None, list[str]]:
    """(best plan, limits met). Seeds first; each round adds one neighbouring version to every open state."""
    edges = Listed(edges) if isinstance(edges, list) else edges
    by_id, limits, seen, spent = {c["version_id"]: c for c in candidates}, set(), set(), 0
    states = [s for c in sorted(by_id) if by_id[c]["seed"] and (s := _state(p, by_id, edges, goals, satisfied, frozenset([c])))]
    if not states:
        return None, []
    best = min(states, key=lambda s: s["rank"])
    seen |= {s["hash"] for s in states}

    def keep(found: list[dict]) -> list[dict]:
        if len(found) > p.beam:
            limits.add("beam_truncated")
        return sorted(found, key=lambda s: s["rank"])[: p.beam]

    frontier = keep(states)
    for _ in range(1, p.depth):
        following = []
        for s in frontier:
            if s["complete"] or len(s["set"]) >= p.procedures:
                continue
            if spent >= p.expansions and "expansion_budget_exhausted" in limits:
                break
            for n in sorted(set().union(*[edges.beside(x) for x in s["set"]]) - s["set"]):
                if spent >= p.expansions:
                    limits.add("expansion_budget_exhausted")
                    break
                spent += 1
                if n in by_id and (t := _state(p, by_id, edges, goals, satisfied, s["set"] | {n})) and t["hash"] not in seen:
                    seen.add(t["hash"])
                    following.append(t)
                    best = min(best, t, key=lambda x: x["rank"])
        frontier = keep(following)
        if not frontier or spent >= p.expansions:
            break
    if frontier and not best["complete"] and spent < p.expansions:
        limits.add("depth_exhausted")
    return best, sorted(limits)


def plan(candidates: DataFrame, planner: Planner = Planner()) -> DataFrame:
    """candidates(plan_id, version_id, seed, goals, wanted, requirements, satisfied, evidence_strength, observed,
    risk_cost, tool_cost, feeds: array of struct(target, requirement_ids)) -> one row per plan_id. Instead of feeds there
    may be `at`, `gives` (array of resources) and `takes` (array of struct(resource, requirement_id)), see `Later`: the
    rows of a plan then grow with its candidates and not with their pairs."""
    listed = "feeds" in candidates.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = rows.sort_values("version_id").to_dict("records")
        for c in found:
            c["goals"], c["requirements"] = list(c["goals"]), list(c["requirements"])
        ids = {c["version_id"] for c in found}
        edges = [{"source": c["version_id"], "target": f["target"], "requirement_ids": set(f["requirement_ids"])} for c in found for f in c["feeds"] if f["target"] in ids] if listed else Later(found)
        best, limits = beam_search(planner, found, edges, set(found[0]["wanted"]), set(found[0]["satisfied"]))
        if best is None:
            return pd.DataFrame([], columns=["plan_id", "nodes", "gaps", "complete", "evidence_strength", "risk_cost", "tool_cost", "limits", "plan_hash"])
        return pd.DataFrame([{"plan_id": found[0]["plan_id"], "nodes": best["nodes"], "gaps": best["gaps"], "complete": best["complete"], "evidence_strength": best["strength"], "risk_cost": best["risk"], "tool_cost": best["tools"], "limits": limits, "plan_hash": best["hash"]}])

    kind = dict(candidates.dtypes)
    schema = f"plan_id {kind['plan_id']}, nodes array<{kind['version_id']}>, gaps array<string>, complete boolean, evidence_strength long, risk_cost long, tool_cost long, limits array<string>, plan_hash string"
    # a search is long and its rows are few: the number of partitions is given, so that their size does not join them
    return candidates.repartition(_partitions(candidates), "plan_id").groupBy("plan_id").applyInPandas(run, schema)


def schedule_groups(order: list, before: dict, clash: set) -> list[list]:
    """Greedy levels: a node goes to the first group after all its predecessors' that holds no node it conflicts with."""
    groups, at = [], {}
    for n in order:
        g = max([at[b] + 1 for b in before.get(n, ()) if b in at], default=0)
        while g < len(groups) and any((min(n, m), max(n, m)) in clash for m in groups[g]):
            g += 1
        if g == len(groups):
            groups.append([])
        groups[g].append(n)
        at[n] = g
    return groups


def schedule(nodes: DataFrame) -> DataFrame:
    """nodes(plan_id, ordinal, version_id, predecessors, conflicting) -> plan_id, version_id, level. A plan becomes one
    row; plans go to Python in batches, not one call each."""
    kind = dict(nodes.dtypes)["version_id"]
    one = F.array_sort(F.collect_list(F.struct("ordinal", "version_id", "predecessors", "conflicting")))
    plans = nodes.groupBy("plan_id").agg(one.alias("n"))

    def run(batches):
        for batch in batches:
            levels = []
            for rows in batch.column("n").to_pylist():
                before = {r["version_id"]: r["predecessors"] for r in rows}
                clash = {(min(r["version_id"], c), max(r["version_id"], c)) for r in rows for c in r["conflicting"]}
                groups = schedule_groups([r["version_id"] for r in rows], before, clash)
                levels.append([{"version_id": v, "level": g} for g, members in enumerate(groups) for v in members])
            fields = batch.column("n").type.value_type
            out = pa.list_(pa.struct([fields.field("version_id"), pa.field("level", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("plan_id"), pa.array(levels, out)], names=["plan_id", "levels"])

    schema = f"plan_id {dict(nodes.dtypes)['plan_id']}, levels array<struct<version_id:{kind},level:bigint>>"
    return plans.mapInArrow(run, schema).select("plan_id", F.inline("levels"))
