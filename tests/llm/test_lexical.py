import math
import random
import re

import pytest

from staywise.llm import lexical, queries
from tests.llm.helpers import SF, clashing, docs_frame, documents

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda x: x.group().lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """{item: [(doc_id, score)]} of every document scored."""
    texts = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    out = {}
    for item, text in dict.fromkeys(items):
        asked, scores = words(text), []
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in ws for _, ws in texts) + 1))) for t in set(asked)}
        for doc, ws in texts:
            score = 0
            for t in asked:
                if tf := ws.count(t):
                    score += w[t] * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(ws) * n_docs) // total)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out.setdefault(item, []).extend((r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k]))
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {k: sorted(v) for k, v in out.items()}


def test_whole_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:40]
    got = queries.queries()["op11_lexical"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    want = {k: v for k, v in plain(docs, items).items() if v}
    got = ranked(got)
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("width, cells, block", [(1 << 16, 1 << 21, 512), (7, 64, 2), (1, 8, 1)])
def test_narrow_sketches_lose_nothing(spark, width, cells, block):
    """Every collision only loosens bounds: even one coordinate gives the exact ranking."""
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ñandú", "ÉTÉ", "42"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 8)))) for i in range(12)]
    got = lexical.search(docs_frame(spark, docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"),
                         width=width, cells=cells, query_block=block)
    assert ranked(got) == {k: v for k, v in plain(docs, items).items() if v}


def test_bounds_never_fall_below_scores():
    import numpy as np
    rng = random.Random(3)
    coordinates = lexical.Coordinates(11)
    queries_ = [lexical.Query(j, j, {f"w{rng.randint(0, 30)}".encode(): rng.randint(1, 3) for _ in range(5)},
                              {f"w{i}".encode(): rng.randint(0, 9000) for i in range(31)}) for j in range(6)]
    block = lexical.Block(queries_, coordinates)
    tf = [lexical.Counter(f"w{rng.randint(0, 30)}".encode() for _ in range(25)) for _ in range(50)]
    m = [rng.randint(25, 400) for _ in tf]
    row = np.repeat(np.arange(50), [len(c) for c in tf])
    at = np.array([coordinates[t] for c in tf for t in c])
    imp = np.array([lexical.impact(n, m[i]) for i, c in enumerate(tf) for n in c.values()])
    bounds = block.bounds(row, at, imp, 50)
    exact = np.array([[q.score(c, x) for q in queries_] for c, x in zip(tf, m)])
    assert (bounds >= exact).all() and (bounds > exact).any()


def test_odd_rows(spark):
    long = "lorem " * 50_000 + "needle"
    docs = [(5, "Needle hay"), (3, "needle hay"), (None, "NEEDLE hay"), (7, None), (8, ""), (9, " \t.,-"), (4, long), (3, "needle hay"),
            (11, "ÑANDÚ"), (12, "ñandú"), (13, "needle\x00hay\x7fneedle")]
    items = [(1, "needle"), (1, "needle"), (2, None), (3, ""), (4, "unknown words"), (5, "Ñandú ñandú"), (None, "hay"), (1, "hay"), (6, "...")]
    items_df = clashing(spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "q").withColumnRenamed("text", "t"))
    got = ranked(lexical.search(clashing(docs_frame(spark, docs)), items_df, k=4, item_col="q", item_text_col="t"))
    want = {k: sorted(v) for k, v in plain(docs, [(i, t) for i, t in items if t], k=4).items() if v}
    assert got.pop(None) == want.pop(None) and got == want
    assert [d for _, d, _ in got[5]] == [12]  # only A-Z are lower-cased


def test_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_ITEMS", 3)
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(60)]
    items = [(i, f"a{i} b{i % 3}") for i in range(7)]
    got = lexical.search(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert ranked(got) == plain(docs, items, k=5)


def test_empty(spark):
    none, items = docs_frame(spark, []), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(docs_frame(spark, [(1, "x")]), items.limit(0)).collect() == []
