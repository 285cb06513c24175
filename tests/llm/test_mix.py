import re
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from staywise.llm import mix, queries
from tests.llm.helpers import SF, clashing, docs_frame, documents


def plain_targets(size, share=1.5):
    """size by source; the excess over twice the size is reshared until none is above."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * size[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def check(rows, got, tolerance):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = plain_targets(size)
    taken = defaultdict(int)
    by_id = {d: s for d, _, s in rows}
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in size:
        assert abs(taken[s] - goal[s]) <= tolerance + 0.01 * goal[s], (s, taken[s], goal[s])


def test_documents(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark).collect()]
    got = queries.queries()["op3_mix"](spark, SF).collect()
    assert len(got) == len(rows)
    check(rows, got, 64)
    assert sorted(got) == sorted(queries.queries()["op3_mix"](spark, SF).collect())


def test_edge_rows(spark):
    rows = [(1, None, None, "b"), (2, "", None, "a"), (3, "w " * 900, None, None), (4, "x " * 5000, None, "a"), (4, "x " * 5000, None, "a"),
            (None, "v " * 300, None, "c"), (6, "one", None, "zé"), (7, "q " * 20000, None, "d"), (8, None, None, "empty")]
    got = mix.taken(clashing(docs_frame(spark, rows).drop("n_chars"))).collect()
    assert len(got) == len(rows)
    rows = [(d, t, s) for d, t, _, s in rows]
    check([r for r in rows], got, 64)
    assert mix.taken(docs_frame(spark, [])).collect() == []


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 65, 1000, 4097):
        i = np.arange(n)
        for key in (0, 12345):
            p = mix.permuted(i, np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == i.tolist()
    big = mix.permuted(np.arange(5000), np.full(5000, 5000), np.full(5000, 9))
    assert abs(np.corrcoef(big, np.arange(5000))[0, 1]) < 0.1


def test_mixed_documents_hold_the_taken_words(spark, tmp_path):
    df = clashing(documents(spark)).drop("row", "size", "rank")
    got = mix.mixed_documents(df, str(tmp_path / "rows"))
    assert got.columns == df.columns
    words = defaultdict(int)
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        words[r["doc_id"]] += len(w)
        assert all(line in text[r["doc_id"]] for line in r["text"].split("\n"))
    want = {r["doc_id"]: r["taken"] for r in mix.taken(df).collect()}
    assert {d: words[d] for d in want} == want


def test_words_between():
    t = "  a b\tc\n d  ".encode()
    assert mix.words_between(t, [(0, 4)]) == "  a b\tc\n d  "
    assert mix.words_between(t, [(0, 2), (3, 1)]) == "a b\nd"


def test_slots_are_made_in_many_tasks(spark):
    """16 million slots of three sources, one with almost all of them."""
    goal = spark.createDataFrame([("a", 0, 64 * 7_500_000, 2.0 * 64 * 7_500_000), ("b", 1, 64 * 1000, 64.0 * 1000), ("c", 2, 64 * 600_000, 64.0 * 600_000)],
                                 "source string, rank long, source_size long, target double")
    slots = mix.slots_of(goal, 64, 8192, 1)
    sizes = [r["count"] for r in slots.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 15_601_000 and len(sizes) >= 50 and max(sizes) < 2 * mix.TASK_SLOTS
    per = {r["rank"]: (r["n"], r["lo"], r["hi"]) for r in slots.groupBy("rank").agg(
        F.count_distinct("slot").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()}
    assert per == {0: (15_000_000, 0, 14_999_999), 1: (1000, 0, 999), 2: (600_000, 0, 599_999)}
