import math

import numpy as np
import pytest

from staywise.llm import queries, topk
from tests.llm.helpers import SF, clashing

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_query, k=5, scale=256):
    v = {i: [math.floor(scale * x) for x in e] for i, e in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out |= {(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])}
    return out


def test_embeddings(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.queries()["op1_topk"](spark, SF)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("big", [1.0, 1e6, 1e12])
def test_edges_and_ties(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 4) * big).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0 * big, 0.0, 0.0, 0.0]) for i in range(40)]  # ties in thousands of places
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0]),
             (None, [1.0] * 4), (204, [1.0, 2.0]), (206, [3.0, -2.0]), (208, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 4 = 0")).collect()]
    want = plain(rows, lambda i: i % 4 == 0)
    if big == 1e12:  # past 62 bits
        want = {(q, r, c, max(-2**62, min(2**62 - 1, s))) for q, r, c, s in want}
        assert {g[:2] for g in got} == {w[:2] for w in want}
        return
    assert set(got) == want and len(got) == len(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, df).collect() == []


def test_different_vectors_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 12)), rng.integers(-2, 3, 3).astype(float).tolist()) for _ in range(90)]
    rows += [(7, [1.0, 0.0, float(k)]) for k in range(40)] + rows[:5] + [(3, None), (None, [1.0] * 3)]  # a hot id, repeats
    other = [(900, [1.0, 1.0, 1.0]), (7, [9.0, 9.0, 9.0])]  # queries that are no candidates
    df = clashing(spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA))
    q = df.where("vec_id % 3 = 1").select("vec_id", "embedding").unionByName(spark.createDataFrame(other, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(df, q).collect())
    keyed = sorted({(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows if i is not None and e is not None})
    asked = {r for r in keyed if r[0] % 3 == 1} | {(i, tuple(int(256 * x) for x in e)) for i, e in other}
    want = []
    for a in asked:
        s = sorted((-sum(x * y for x, y in zip(a[1], c[1])), c) for c in keyed if c != a)
        want += [(a[0], r + 1, c[0], -x) for r, (x, c) in enumerate(s[:5])]
    assert got == sorted(want)
