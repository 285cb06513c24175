import math

import numpy as np

from staywise.llm import queries, vectordup
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<double>, label int"
SF = "/root/testdata/sf0.01"


def plain(rows, threshold=0.9):
    """links, by brute force, of (id, vector or None)"""
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = []
    for k, (i, a) in enumerate(use):
        for j, b in use[k + 1:]:
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    return links


def compare(rows, got, least=1.0):
    links = plain(rows)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(r["n_links"] for r in got)
    assert len(got) == len(rows) and all(r["n_links"] <= n[r["vec_id"]] for r in got)
    assert found >= least * 2 * len(links)
    if found == 2 * len(links):
        comp = components([i for i in n if i is not None], [x for x in links])
        assert all(r["component_id"] == comp.get(r["vec_id"]) and r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return found / max(1, 2 * len(links))


def test_embeddings(spark):
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(rows, queries.queries()["op4_vectordup"](spark, SF).collect(), 0.99)


def cloud(n, groups, near, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dim))
    v = base[rng.integers(0, groups, n)] + near * rng.standard_normal((n, dim))
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_recall_at_the_threshold(spark):
    """Pairs spread around cosine 0.9, the hardest place, in several tables."""
    rows = cloud(1500, 300, 0.33)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    signs, tables = vectordup.plan(1500, 0.9, 0.99)
    assert tables > 1
    recall = compare(rows, vectordup.near_duplicates(df).collect(), 0.95)
    assert recall >= 0.95


def test_hot_bucket_is_tiled(spark):
    rows = cloud(400, 1, 0.1)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    whole = sorted(map(tuple, vectordup.near_duplicates(df).collect()))
    tiled = sorted(map(tuple, vectordup.near_duplicates(df, tile_rows=64, group_rows=200).collect()))
    assert whole == tiled
    compare(rows, vectordup.near_duplicates(df, tile_rows=64).collect())


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [math.inf, 1.0]), (10, []), (11, [-1.0, 0.0]), (12, [1.0, 0.4843]), (13, [1.0, 0.4844])]
    got = vectordup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] == [1, 1, 1, 4, 5, 6, 7, 8, 9, 10, 11, 1, 1]
    assert by[1]["n_links"] == 4 and by[3]["n_links"] == 4 and by[12]["n_links"] == 5 and by[13]["n_links"] == 1 and by[None]["component_id"] is None
    assert vectordup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    dim, bits = 64, 128
    v = rng.standard_normal((400, dim))
    v[200:] = 0.9 * v[:200] + 0.4 * v[200:]
    kind = vectordup.record(dim, bits, 1, "<f8")
    r = vectordup.encode(np.arange(400), np.ones(400, int), v, kind, bits, 1, 4, 3)
    i, j = np.arange(200), np.arange(200, 400)
    true = vectordup.cosines(r, i, j)
    up = vectordup.upper(r, i, j, bits)
    f = r["factor"][i]
    spread = vectordup.SIGMAS * (np.sqrt((1 - f * f) / (bits - 1)) + r["step"][j] / 2) / f
    assert (up >= true).all()
    assert abs((up - spread - true).mean()) < 0.02


def test_recall_of_planted_links_with_six_signs(spark):
    """24,000 vectors (six signs a table) with planted partners at cosines 0.88
    to 0.99: nothing below the threshold links, and the links at it are found."""
    assert vectordup.plan(24_000, 0.9, 0.99)[0] == 6
    rng = np.random.default_rng(0)
    x = rng.normal(size=(24_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.99, 6000)
    side = rng.normal(size=(6000, 48))
    side -= (side * x[:6000]).sum(axis=1, keepdims=True) * x[:6000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[12_000:18_000] = cosine[:, None] * x[:6000] + np.sqrt(1 - cosine**2)[:, None] * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: r for r in vectordup.near_duplicates(df, threshold=0.9).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.zeros(24_000, int)
    for at in range(0, 24_000, 2000):
        links[at:at + 2000] = (unit[at:at + 2000] @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(24_000)])
    assert links.sum() > 9000 and (found <= links).all()
    assert found.sum() >= 0.99 * links.sum()
    close = (cosine >= 0.9) & (cosine < 0.92)
    assert found[:6000][close].sum() >= 0.98 * links[:6000][close].sum()
