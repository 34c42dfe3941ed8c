"""The queries themselves: native plans, and results on small tables with nulls, repeats and extra columns."""

import contextlib
import hashlib
import io
import zlib
from collections import Counter

import pytest

from tracewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_prefix_targets", "op7_water_filling"])
def test_native_queries_have_no_python(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.QUERIES[name](spark, SF).explain("formatted")
    assert not any(x in out.getvalue() for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


@pytest.fixture
def tables(spark, tmp_path):
    """documents with null ids and texts, repeated rows and columns that operators use themselves; other tables empty."""
    texts = ["alpha beta gamma delta epsilon", "", None, "alpha beta gamma delta epsilon", "tail " * 300, "tail " * 300 + "end"]
    rows = [(i, t, "en", "src", 1, 5, "x") for i, t in enumerate(texts)] + [(None, "no id", "en", None, 1, 5, "x"), (3, texts[3], "en", "src", 1, 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, keys string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_queries_return_a_row_per_document(spark, tables):
    sf, rows = tables
    ids = Counter(r[0] for r in rows)
    for name in ("op2_external_shuffle", "op5_two_stage_suffixes", "op7_water_filling", "op9_gray_index", "op10_chunk_recipes"):
        assert Counter(r.doc_id for r in queries.QUERIES[name](spark, sf).collect()) == ids, name
    got = {(r.doc_id, r.n_bytes): r for r in queries.QUERIES["op5_two_stage_suffixes"](spark, sf).collect()}
    assert got[(5, 1503)].n_removed == 1500 and got[(5, 1503)].kept_sha256 == hashlib.sha256(b"end").hexdigest()
    kept = [r for r in queries.QUERIES["op10_chunk_recipes"](spark, sf).collect() if r.group_size == 3]
    assert {r.keep_id for r in kept} == {3} and len(kept) == 3 and sum(r.kept for r in kept) == 1
    shuffled = queries.QUERIES["op2_external_shuffle"](spark, sf).collect()
    want = Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.text_crc32) for r in shuffled) == want
    pieces = queries.QUERIES["op6_bin_completion"](spark, sf).collect()
    assert Counter(r.doc_id for r in pieces) == ids
