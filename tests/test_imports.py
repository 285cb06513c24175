"""Import of form files: counts, repeats, replays and the feature step."""

import pytest

from staywise.sources.imports import TerminationTable

HEAD = "Client Name,Date of Receiving Termination/Replacement/Resignation Notice,Last Date of General Communication With The Client,Have we lost the Client?\n"


def write(path, *rows):
    path.write_text(HEAD + "".join(r + "\n" for r in rows))
    return str(path)


def test_counts_repeats_and_second_import(spark, tmp_path):
    t = TerminationTable(spark, str(tmp_path / "table"))
    assert t.rows() is None and t.features() is None and t.compute_features() == 0
    first = write(tmp_path / "a.csv", "Acme,2024-02-01,2024-01-22,Yes", "Acme,2024-02-01,2024-01-22,Yes", "  ,2024-01-01,,No", ",2024-01-01,,No", "Beta,2024-03-01,,No")
    assert t.import_csv(first) == {"total_rows": 5, "dropped_rows": 2, "appended_rows": 3}
    assert t.import_csv(first) == {"total_rows": 5, "dropped_rows": 2, "appended_rows": 0}
    assert t.compute_features() == 3 and t.compute_features() == 0
    # one known row, one more copy of a known one (a third), one new
    second = write(tmp_path / "b.csv", "Beta,2024-03-01,,No", "Acme,2024-02-01,2024-01-22,Yes", "Acme,2024-02-01,2024-01-22,Yes", "Acme,2024-02-01,2024-01-22,Yes", "Gamma,,,")
    assert t.import_csv(second) == {"total_rows": 5, "dropped_rows": 0, "appended_rows": 2}
    rows = t.rows().collect()
    assert sorted(r["client_name"] for r in rows) == ["Acme"] * 3 + ["Beta", "Gamma"] and len({r["id"] for r in rows}) == 5
    assert {r["client_name"]: r["client_lost"] for r in rows} == {"Acme": 1, "Beta": 0, "Gamma": 0}
    assert t.features().count() == 3 and t.compute_features() == 2
    got = {(r["termination_id"], r["days_since_communication"]) for r in t.features().collect()}
    assert {i for i, _ in got} == {r["id"] for r in rows} and sorted(d for _, d in got) == [10, 10, 10, 999, 999]
    assert [(r["total_rows"], r["dropped_rows"], r["appended_rows"]) for r in t.imports().orderBy("sequence").collect()] == [(5, 2, 3), (5, 2, 0), (5, 0, 2)]


def test_a_run_that_breaks_off_is_made_up(spark, tmp_path, monkeypatch):
    t = TerminationTable(spark, str(tmp_path / "table"))
    a = write(tmp_path / "a.csv", "Acme,2024-02-01,,Yes")
    real = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, d, s=None, *x: (_ for _ in ()).throw(OSError("lost")) if d else real(self, d, s, *x))
    with pytest.raises(OSError):
        t.import_csv(a)  # the rows are written, the manifest is not
    monkeypatch.undo()
    assert t.rows() is None and t.import_csv(a)["appended_rows"] == 1 and t.rows().count() == 1
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, d, s=None, *x: (_ for _ in ()).throw(OSError("lost")) if d else real(self, d, s, *x))
    with pytest.raises(OSError):
        t.compute_features()
    monkeypatch.undo()
    assert t.features() is None and t.compute_features() == 1 and t.features().count() == 1


def test_empty_file_and_no_name_column(spark, tmp_path):
    t = TerminationTable(spark, str(tmp_path / "table"))
    assert t.import_csv(write(tmp_path / "none.csv")) == {"total_rows": 0, "dropped_rows": 0, "appended_rows": 0}
    (tmp_path / "c.csv").write_text("Score,Unmapped\n5,x\n")
    assert t.import_csv(str(tmp_path / "c.csv")) == {"total_rows": 1, "dropped_rows": 0, "appended_rows": 1}
    assert t.compute_features() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.import_csv(str(tmp_path / "missing.csv"))


def test_the_form_rows_of_three_imports_are_computed_once(spark, monkeypatch):
    """each count and each file joined all terminations anew."""
    import hashlib

    from pyspark.sql import functions as F

    from staywise.plans import q_store as Q
    from staywise.sources.ingest import TERMINATION_COLUMNS
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        n.add(1)
        return x
    t = spark.range(1, 13, 1, 3).select("id", *[F.lit("2024-02-01").alias(c) for c in (Q.FORM_EXPORT | Q.MORE_HEADERS) if c != "client_name"],
                                        seen(F.lit("Acme")).alias("client_name"))
    monkeypatch.setattr(Q.A, "terminations", lambda spark, sf: t)
    table = Q._imported(spark, "")
    got = table.imports().orderBy("sequence").collect()
    assert [(r["total_rows"], r["dropped_rows"], r["appended_rows"]) for r in got] == [(6, 0, 6), (8, 0, 2), (12, 0, 4)]
    assert n.value == 12
    text = table.rows().select("id", "content", "score", F.to_json(F.struct(*TERMINATION_COLUMNS)).alias("j")).collect()
    assert all(r["content"] == hashlib.sha256(r["j"].encode()).hexdigest() and r["id"] == r["content"] + "-1" for r in text)
    got = table.rows_with_features(["score"]).collect()
    assert sorted(int(r["score"]) for r in got) == list(range(1, 13)) and {r["days_since_communication"] for r in got} == {0}
