"""Substring search by three-letter postings against the plain search."""

import random

from pyspark.sql import functions as F

from staywise.operators import summary as S
from staywise.sources.search_index import SearchIndex, grams_of

COLS = "client_id long, client_name string, industry_type string, risk_level string, key string"


def rows_for(n=400):
    r = random.Random(5)
    words = ["Acme", "Bauhaus", "Öl & Gas", "100%_sure", "naïve", "ΣΟΦΟΣ", "tower", "ab", "", None, "😀😀x", "aaaaaa"]
    out = []
    for i in range(n):
        pick = [w for w in (r.choice(words), r.choice(words)) if w is not None]
        out.append((i if i % 13 else None, " ".join(pick) + f" {i:04d}" if i % 7 else None, r.choice(words), r.choice(["low", "high"]), "k"))
    return out


def found(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_equals_the_plain_search_for_every_term(spark, tmp_path):
    df = spark.createDataFrame(rows_for(), COLS).cache()
    index = SearchIndex(spark, str(tmp_path / "i"), share=0.5)
    assert found(index.search(df, "acme")) == found(S.search(df, "acme"))  # nothing indexed: a scan
    assert index.refresh(df.where("client_id % 2 = 0")) + index.refresh(df) == df.where("client_id is not null").count()
    assert index.refresh(df) == 0
    planned = 0
    for term in ["acme", "ACME ", "haus", "öl &", "%_s", "100%", "σοφος", "ΐ", "ab", "a", "", "0012", "aaaa", "😀😀x", "zzz", "naïve 0", "e 03"]:
        planned += index.plan(term) is not None
        level = "high" if len(term) % 2 else "all"
        assert found(index.search(df, term, level)) == found(S.search(df, term, level)), term
    assert planned >= 10


def test_changed_texts_common_grams_and_replays(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("client_id"), F.when(F.col("id") % 3 == 0, F.lit("common name")).otherwise(F.concat(F.lit("n-"), F.col("id") + 10000)).alias("client_name"),
                                  F.lit(None).cast("string").alias("industry_type"), F.lit("low").alias("risk_level"))
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.refresh(df)
    assert index.plan("common") is None and index.plan("10001") is not None and index.plan("nowhere") == {}
    assert index.search(df, "common").count() == 1000 and index.search(df, "n-10001").count() == 1
    changed = df.withColumn("client_name", F.when(F.col("client_id") == 1, F.lit("Renamed")).otherwise(F.col("client_name")))
    assert index.refresh(changed) == 1
    assert index.search(changed, "n-10001").count() == 0 and index.search(changed, "RENAMED").first()["client_id"] == 1
    # postings written twice, as by a refresh that broke off, change nothing
    spark.read.parquet(f"{index.root}/postings").write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(f"{index.root}/postings")
    assert index.search(changed, "n-10001").count() == 0 and index.search(changed, "n-10002").count() == 1


def test_postings_are_pruned_by_gram(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), share=1.0)
    df = spark.createDataFrame([(1, "abcdef", "x", "low", "k")], COLS)
    index.refresh(df)
    plan = index.search(df, "bcd")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,bcd)" in plan or "In(gram" in plan  # reaches the scan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert grams_of("aaaa") == ["aaa"] and grams_of("ab") == []


def test_empty_table(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"))
    df = spark.createDataFrame([], COLS)
    assert index.refresh(df) == 0 and index.search(df, "acme").count() == 0
