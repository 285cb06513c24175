"""Month filters and the feature table that they guard."""

import pytest
from pyspark.sql import functions as F

from staywise.sources.membership import LOAD, FeatureTable, MonthFilters


def ids(spark, lo, hi, months=2):
    return spark.range(lo, hi).select(F.concat(F.lit("2024-0"), F.col("id") % months + 1).alias("notice_month"), F.col("id").alias("termination_id"))


MONTHS = ["2024-01", "2024-02"]


def test_no_id_is_missed_and_false_hits_are_rare(spark, tmp_path):
    f = MonthFilters(spark, str(tmp_path / "f"), least_blocks=16)
    assert f.maybe(ids(spark, 0, 10), MONTHS) is None and f.parts() == set()
    for lo, hi in ((0, 500), (500, 5_000), (5_000, 40_000), (0, 500)):
        f.add(ids(spark, lo, hi))
    state = f._state()
    for r in state.values():  # larger filters beside the full ones, none over its load
        assert list(r["blocks"]) == sorted(r["blocks"]) and len(r["blocks"]) >= 3
        assert all(n <= LOAD * b for n, b in zip(r["n"], r["blocks"]))
    assert f.maybe(ids(spark, 0, 40_000), MONTHS).count() == 40_000
    others = f.maybe(ids(spark, 1_000_000, 1_100_000), MONTHS).count()
    assert others < 1_000  # a hundredth, over all filters of a month
    # ids of another month are not asked for in this one
    swapped = ids(spark, 0, 2_000).withColumn("notice_month", F.when(F.col("notice_month") == "2024-01", "2024-02").otherwise("2024-01"))
    assert f.maybe(swapped, MONTHS).count() < 60
    rows = f._rows(state)
    assert rows.count() == rows.select("part", "blocks", "block").distinct().count()


def test_an_add_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    f = MonthFilters(spark, str(tmp_path / "f"))
    f.add(ids(spark, 0, 100))
    real = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, s=None, *x: (_ for _ in ()).throw(OSError("lost"))
                        if "sequence" in str(s) else real(self, rows, s, *x))
    with pytest.raises(OSError):
        f.add(ids(spark, 100, 300))
    monkeypatch.undo()
    assert {m: list(r["n"]) for m, r in f._state().items()} == {"2024-01": [50], "2024-02": [50]}
    assert f.maybe(ids(spark, 0, 300), MONTHS).count() < 110


def test_rows_are_written_once(spark, tmp_path):
    t = FeatureTable(spark, str(tmp_path / "t"))
    rows = ids(spark, 0, 1_000).withColumn("x", F.col("termination_id") * 2)
    assert t.append(rows) == {"rows": 1_000, "hits": 0, "stored": 0, "written": 1_000}
    again = t.append(rows.unionByName(rows))
    assert (again["rows"], again["stored"], again["written"]) == (1_000, 1_000, 0)
    some = ids(spark, 995, 1_005).withColumn("x", F.lit(0))
    got = t.append(some)  # a few hits: literal ids
    assert (got["stored"], got["written"]) == (5, 5)
    nulls = spark.createDataFrame([("2024-01", None, 1), ("none", None, 1), ("none", 7, 1)], "notice_month string, termination_id long, x long")
    assert t.append(nulls)["written"] == 3 and t.append(nulls)["written"] == 0
    assert t.append(rows.limit(0))["written"] == 0
    assert t.rows().count() == 1_008


def test_filters_before_rows_and_tables_without_filters(spark, tmp_path, monkeypatch):
    t = FeatureTable(spark, str(tmp_path / "t"))
    rows = ids(spark, 0, 100)
    t.filters.add(rows)  # as if the write had failed after it
    got = t.append(rows)
    assert (got["hits"], got["stored"], got["written"]) == (100, 0, 100)
    # a table begun without filters gets them from its rows
    old = FeatureTable(spark, str(tmp_path / "old"))
    rows.write.partitionBy("notice_month").parquet(old.path)
    got = old.append(ids(spark, 50, 150))
    assert (got["stored"], got["written"]) == (50, 50)
    # without hits no stored row is read
    monkeypatch.setattr(FeatureTable, "ids", lambda self, parts: pytest.fail("stored ids were read"))
    monkeypatch.setattr(MonthFilters, "maybe", lambda self, i, parts: i.limit(0))
    assert old.append(ids(spark, 200, 210))["written"] == 10


def test_a_batch_is_computed_and_counted_once(spark, tmp_path, monkeypatch):
    """a batch of new ids was checkpointed and its months counted three times."""
    from staywise.sources import membership as MS
    monkeypatch.setattr(MS, "materialize", lambda df: pytest.fail("checkpointed"))
    t, counts = FeatureTable(spark, str(tmp_path / "t")), []
    add = t.filters.add
    monkeypatch.setattr(t.filters, "add", lambda ids, n=None: (counts.append(n), add(ids, n)))
    rows = [(k, "2024-01" if k % 3 else None, 2 * k) for k in [*range(30), 4]]
    df = spark.createDataFrame(rows, "termination_id long, notice_month string, v long")
    assert t.append(df.where("notice_month IS NOT NULL")) == {"rows": 20, "hits": 0, "stored": 0, "written": 20}
    assert counts == [{"2024-01": 20}]
    assert sorted(r["termination_id"] for r in t.rows().collect()) == [k for k in range(30) if k % 3]
