import pytest

from tracewright.operators import manifests as M


def test_ids_follow_content(spark):
    a, b = M.Embedding("local", "hash", 16), M.Embedding("local", "hash", 32)
    assert M.manifest_id(a, "embm_") == M.manifest_id(M.Embedding("local", "hash", 16), "embm_") != M.manifest_id(b, "embm_")
    rows = M.as_row(spark, a, "embm_").unionByName(M.as_row(spark, b, "embm_").selectExpr("manifest_id", "concat(body, ' ') AS body"))
    assert [r.manifest_id for r in M.forged(rows).collect()] == [M.manifest_id(b, "embm_")]


def test_validation():
    for bad in (lambda: M.Embedding("", "m", 1), lambda: M.Embedding("p", "m", 0), lambda: M.VectorIndex("e", degree=0), lambda: M.Rubric("unpinned"), lambda: M.Rubric("m@1", ("a", "a"))):
        with pytest.raises(ValueError):
            bad()
    assert M.VectorIndex("e").pool(5) == 40 and M.VectorIndex("e").pool(100_000) == 4096


def test_answers(spark):
    good = '{"score": 3.5, "confidence": 1, "probabilities": [0.25, 0.75]}'
    rows = [(good,), (good.replace("3.5", "4.5"),), (good.replace("0.75", "0.7"),), ("x",), (None,), ('{"score": 1}',)]
    got = [(r.valid, r.score_micros) for r in M.decode_answers(spark.createDataFrame(rows, "payload string")).collect()]
    assert got == [(True, 3500000), (False, 4500000), (False, 3500000), (False, None), (False, None), (False, 1000000)]
