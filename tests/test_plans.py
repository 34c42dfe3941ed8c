"""What the physical plans must look like: pushed filters, pruned columns, no accidental products, no Python in the core."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["gate_rejections", "evidence_outcome_state", "last_writer_asof", "lifecycle_transition", "hash_bucket_assignment", "compatibility_pairs", "conflict_matrix", "digest_diff", "bm25_topk", "facet_score"])
def test_core_stays_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInArrow" not in text and "FlatMapGroups" not in text


@pytest.mark.parametrize("name", ["facet_score", "exact_unambiguous", "compatibility_pairs", "conflict_matrix", "contract_range_resolve", "last_writer_asof", "goal_inference", "adjacency_expansion"])
def test_joins_are_equality_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["fk_violations"](spark, SF))
    assert "Not(EqualTo(o_orderstatus,P))" in text and "l_comment" not in text and "o_totalprice" not in text
    assert "o_totalprice" not in plan(catalog.QUERIES["queue_claim"](spark, SF))
    text = plan(catalog.QUERIES["facet_score"](spark, SF))
    assert "text" not in [c.split(":")[0] for line in text.splitlines() if "ReadSchema" in line for c in line.split("<", 1)[1].rstrip(">").split(",")]


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["graph_edge_count"](spark, SF))
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["queue_claim"](spark, SF))


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "version_id", "rank", "final"] and out.count() >= 0


def test_names_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_channels_give_candidates(spark):
    from tracewright.plans import retrieve

    schema = "task string, harness string, environment string, contracts array<string>, intent string"
    docs = spark.createDataFrame([(1, "a b", "en", "s1", ["t9"], "i", "e"), (2, "x y", "fr", "s2", ["t1", "t2"], "j", "e"), (3, "a b b b c", "de", "s3", ["t8"], "k", "e")], f"version_id long, {schema}, effect string")
    requests = spark.createDataFrame([(7, "a b b b b", "en", "s1", ["t1", "t2"], "i")], f"query_id long, {schema}")
    got = {(r.channel, r.version_id) for r in retrieve.candidates(docs, requests, 1).collect()}
    assert got == {("exact", 1), ("lexical", 1), ("facet", 1), ("graph", 2), ("vector", 3)}


def test_cycles_of_all_orders_are_those_of_brute_force(spark):
    edges = {}
    for o in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        edges.setdefault(o.o_custkey % 5, {}).setdefault(o.o_custkey % 97, set()).add((o.o_custkey * 7 + o.o_orderkey % 3) % 97)
    want = {}
    for trace, after in edges.items():
        for node in after:
            seen, todo = set(), [node]
            while todo:
                fresh = after.get(todo.pop(), set()) - seen
                seen |= fresh
                todo += fresh
            if node in seen:
                want[trace] = want.get(trace, 0) + 1
    assert {r.trace_id: r.nodes for r in catalog.cycle_check(spark, SF).collect()} == want


def test_serving_from_snapshot_to_disposition(spark):
    from tracewright.plans import adapters, retrieve

    docs, requests = adapters.documents(spark, SF), adapters.requests(spark, SF)
    configured = spark.createDataFrame([(name, 1) for name in retrieve.ALL], "channel string, index_id int")
    bound = configured.where("channel <> 'vector'")
    runs = spark.createDataFrame([(1, "graph", "deadline_exceeded"), (2, "vector", "unavailable"), (3, "graph", None)], "query_id long, channel string, code string")
    run = lambda docs_, judged=None, **more: {r.query_id: r for r in retrieve.serve(docs, docs_, requests, catalog.AS_OF, (configured, bound), runs, judged, **more).collect()}
    plain = run(docs)
    assert len(plain) == requests.count()
    assert (plain[1].disposition, plain[1].reason, plain[1].selected) == ("failed", "required_channel_unavailable:graph", []) and plain[2].degraded == ["vector"] and plain[3].disposition != "failed"
    several = next(r for r in plain.values() if len(r.selected) > 1)
    # a candidate that the snapshot lacks, or holds twice, fails its request
    one = several.selected[0]
    assert run(docs.where(f"version_id <> {one}"))[several.query_id].reason == "candidate_snapshot_missing"
    assert run(docs.unionByName(docs.where(f"version_id = {one}")))[several.query_id].reason == "candidate_snapshot_missing"
    # the judge's bonus counts only where the whole band was judged
    second = several.selected[1]
    judged = docs.select(F.lit(several.query_id).alias("query_id"), "version_id", F.lit(True).alias("committed"), F.expr(f"IF(version_id = {second}, 1000000000000, 0)").alias("bonus"))
    assert run(docs, judged, distance=10**15, judge_most=100)[several.query_id].selected[0] == second
    assert run(docs, judged.where(f"version_id = {second}"), distance=10**15, judge_most=100)[several.query_id].selected == several.selected
    with pytest.raises(ValueError, match="graph index_mismatch"):
        retrieve.serve(docs, docs, requests, catalog.AS_OF, (configured, bound.withColumn("index_id", F.expr("IF(channel = 'graph', 2, 1)"))), runs)
