"""Codes that never move."""

import pytest
from pyspark.sql import functions as F

from staywise.operators import features as FT
from staywise.operators.dictionary import Dictionary
from staywise.operators.encode import label_encode
from staywise.sources import adapters as A
from tests.conftest import SF_SMALL


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b int")


def codes(d):
    return {(r["column"], r["value"]): r["code"] for r in d.table().collect()}


def test_two_fits_keep_all_codes(spark, tmp_path):
    d = Dictionary(spark, str(tmp_path / "d"))
    assert codes(d) == {}
    assert d.extend(frame(spark, [("m", 3), ("c", None), (None, 3), ("m", 20)]), {"a": "Unknown", "b": None}) == 5
    first = codes(d)
    assert first == {("a", "Unknown"): 0, ("a", "c"): 1, ("a", "m"): 2, ("b", "20"): 0, ("b", "3"): 1}
    assert d.extend(frame(spark, [("m", 3), ("c", 20)]), {"a": "Unknown", "b": None}) == 0
    assert d.extend(frame(spark, [("a", 3), ("z", 1), ("c", 20)]), {"a": "Unknown", "b": None}) == 3
    later = codes(d)
    assert {k: later[k] for k in first} == first and {later["a", "a"], later["a", "z"]} == {3, 4} and later["b", "1"] == 2
    got = label_encode(frame(spark, [("z", 1), (None, 1), ("new", 1)]), "a", d.vocabulary("a"), "code", "Unknown", unseen="Unknown").collect()
    assert [r["code"] for r in sorted(got, key=lambda r: r["a"] or "")] == [0, 0, 4]


def test_a_run_that_breaks_off_assigns_nothing(spark, tmp_path, monkeypatch):
    d = Dictionary(spark, str(tmp_path / "d"))
    d.extend(frame(spark, [("m", 1)]), {"a": None})
    later = frame(spark, [("b", 1)])
    real = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, s=None, *x: (_ for _ in ()).throw(OSError("lost")) if rows else real(self, rows, s, *x))
    with pytest.raises(OSError):
        d.extend(later, {"a": None})
    monkeypatch.undo()
    assert codes(d) == {("a", "m"): 0}
    assert d.extend(frame(spark, [("c", 1)]), {"a": None}) == 1 and codes(d) == {("a", "m"): 0, ("a", "c"): 1}


def test_training_matrix_by_stored_codes(spark, tmp_path):
    d = Dictionary(spark, str(tmp_path / "d"))
    data = FT.training_data(A.terminations(spark, SF_SMALL))
    some = data.where("geo_location > 'J'")
    d.extend(some, {"geo_location": "Unknown"})
    before = {r["id"]: r["geo_encoded"] for r in FT.training_matrix(some, d.table()).collect()}
    d.extend(data, {"geo_location": "Unknown"})  # values that sort before the known ones
    after = {r["id"]: r["geo_encoded"] for r in FT.training_matrix(data, d.table()).collect()}
    assert before and {k: after[k] for k in before} == before and None not in after.values()
    assert data.select(F.coalesce("geo_location", F.lit("Unknown"))).distinct().count() == len(set(after.values()))
