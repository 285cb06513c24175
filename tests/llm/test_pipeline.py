"""The pipeline stage by stage against plain versions, and run() as a whole."""

import corpus_pipeline
from staywise.llm import langid, pii
from staywise.llm.queries import remainder
from tests.llm import test_mix, test_pack, test_pii, test_simhash
from tests.llm.helpers import SF, clashing, docs_frame, documents


def test_stages(spark, tmp_path):
    docs = documents(spark)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "source_mix", "packing"]
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        kept.append(docs.collect())
    start, spoken, single, masked, mixed, packed = kept

    model = langid.fit(documents(spark).where(remainder() != 2))
    want = {r["doc_id"] for r in start if not model.rejects((r["text"] or "").encode())}
    assert {r["doc_id"] for r in spoken} == want and len(want) > 0.98 * len(start)

    _, comp = test_simhash.plain([(r["doc_id"], r["text"]) for r in spoken])
    assert sorted(r["doc_id"] for r in single) == sorted({c for c in comp.values()})
    whole = {r["doc_id"]: r for r in start}
    assert all(r == whole[r["doc_id"]] for r in single)

    for r in masked:
        before = whole[r["doc_id"]]["text"]
        assert r["text"] == pii.mask(before, pii.find(before)[1]) and not base_left(r["text"])
    assert len(masked) == len(single)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in masked]
    size = {d: len(t.split()) for d, t, _ in rows}
    goal = test_mix.plain_targets({s: sum(size[d] for d, _, x in rows if x == s) for s in {x for _, _, x in rows}})
    took = dict.fromkeys(goal, 0)
    words = dict.fromkeys(size, 0)
    for r in mixed:
        took[r["source"]] += len(r["text"].split())
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(abs(took[s] - goal[s]) <= 64 + 0.01 * goal[s] for s in goal)
    assert all(words[d] <= 2 * size[d] for d in size)

    used, least = test_pack.check([(r["doc_id"], r["text"]) for r in mixed], packed)
    assert used <= 1.02 * least + 1


def base_left(text):
    return test_pii.plain(text)


def test_run(spark):
    first, second = (sorted(corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and len(first) > 150


def test_stages_on_odd_rows_and_extra_columns(spark, tmp_path):
    rows = [(1, "the and of that the and of", "en", "a"), (1, "the and of that the and of", "en", "a"), (2, None, "en", None), (3, "", None, "b"),
            (None, "der die und das mail a@b.co nicht", "de", None), (4, "the And of that the and of", None, "a"), (5, "12 34", "en", "b"),
            (6, "der die und " * 3000, "de", "c"), (7, "und die der ein " * 20, None, None)]
    for name, data in (("odd", rows), ("empty", [])):
        docs = clashing(docs_frame(spark, data))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / name / str(k)))
            before, docs = docs.columns, spark.read.parquet(str(tmp_path / name / str(k)))
            assert k == 4 or docs.columns == before
            if data and k == 1:
                assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 6, 7]
            if data and k == 2:
                assert [r["text"] for r in docs.collect() if r["doc_id"] is None] == ["der die und das mail <EMAIL> nicht"]
        assert (docs.count() > 0) == bool(data)
