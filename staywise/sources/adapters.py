"""Logical tables of the churn domain derived from the driver's test tables.

The mapping is fixed by FIXTURES.md part 2.  Every adapter is a lazy plan over
the parquet scans: per-key aggregates are computed with partial (map-side)
aggregation before any join, joins are left unhinted so Catalyst/AQE choose
broadcast only for sides whose measured size is under the threshold, and
only the used columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.dates import ts_literal
from staywise.sources.tables import table

# Reference instants of the fixtures.
AS_OF_ACCOUNTS = "2001-08-02 00:00:00"      # clients, team_members, terminations
AS_OF_PREDICTIONS = "2024-01-31 00:00:00"   # predictions, feedback, attendance


def _order_span(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("o_custkey")
            .agg(F.min("o_orderdate").alias("first_order"),
                 F.max("o_orderdate").alias("last_order")))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                  "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = _order_span(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate"))
    j = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
          .join(o, o.o_custkey == c.c_custkey, "left"))
    active_cut = ts_literal("2000-08-01 00:00:00")
    lost_cut = ts_literal("2000-06-01 00:00:00")
    bal = F.col("c_acctbal")
    return j.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry_type"),
        F.col("n_name").alias("client_location"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("first_order")).alias("start_date"),
        F.col("first_order").alias("created_at"),
        F.col("last_order").alias("updated_at"),
        F.when(bal >= 7000, "excellent").when(bal >= 4000, "Good").when(bal >= 1000, "fair")
         .when(bal >= 0, "poor").alias("health"),
        F.when(F.col("last_order") >= active_cut, "active").otherwise("Inactive").alias("status"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("last_order") >= active_cut).alias("is_active"),
        F.when(F.col("last_order") < lost_cut, F.col("last_order")).alias("attrition_date"),
    )


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    a = orders.select(F.col("o_orderkey").alias("a_key"), F.col("o_orderdate").alias("a_date"))
    b = orders.select(F.col("o_orderkey").alias("b_key"), F.col("o_orderdate").alias("b_date"),
                      F.col("o_custkey").alias("b_cust"))
    j = (s.join(a, a.a_key == s.s_suppkey * 7, "left")
          .join(b, b.b_key == s.s_suppkey * 11 + 1, "left"))
    k = F.col("s_suppkey")
    bal = F.col("s_acctbal")
    return j.select(
        k.alias("id"),
        F.concat(F.lit("First"), k.cast("string")).alias("first_name"),
        F.when(k % 9 != 0, F.col("s_name")).alias("last_name"),
        F.when(k % 6 == 0, "team_member").when(k % 6 == 1, "team_lead").when(k % 6 == 2, "manager")
         .when(k % 6 == 3, "senior").when(k % 6 == 4, "junior").alias("role"),
        F.when(bal < 0, F.lit(None).cast("string")).when(bal < 2500, "inactive")
         .otherwise("Active").alias("status"),
        F.col("a_date").alias("start_date"),
        F.col("a_date").alias("created_at"),
        F.col("b_date").alias("updated_at"),
        F.when(k % 10 != 0, F.col("b_cust")).alias("client_id"),
    )


def terminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                               "o_orderpriority", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first = (table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
             .groupBy(F.col("o_custkey").alias("f_custkey"))
             .agg(F.min("o_orderdate").alias("first_order")))
    lines = (table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
             .groupBy("l_orderkey")
             .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
                  F.max("l_returnflag").alias("max_flag"), F.max("l_quantity").alias("seats")))
    j = (o.join(c, c.c_custkey == o.o_custkey, "inner")
          .join(n, n.n_nationkey == c.c_nationkey, "inner")
          .join(first, first.f_custkey == o.o_custkey, "inner")
          .join(lines, lines.l_orderkey == o.o_orderkey, "left"))
    prio = F.col("o_orderpriority")
    price = F.col("o_totalprice")
    key = F.col("o_orderkey")
    flag = F.col("max_flag")
    return j.select(
        key.alias("id"),
        F.col("c_name").alias("client_name"),
        F.col("o_orderdate").alias("notice_date"),
        F.col("last_ship").alias("last_comm_date"),
        F.col("first_ship").alias("last_checkin_date"),
        F.col("first_order").alias("client_start_date"),
        F.col("first_ship").alias("tm_start_date"),
        F.col("last_ship").alias("tm_last_date"),
        F.when(prio == "1-URGENT", "Immediate").when(prio == "2-HIGH", "1-2 weeks")
         .when(prio == "3-MEDIUM", "2-4 weeks").when(prio == "4-NOT SPECIFIED", F.lit(None))
         .otherwise("no rush").alias("replacement_timeframe"),
        F.when(prio == "1-URGENT", "Weekly").when(prio == "2-HIGH", "Bi-Monthly")
         .when(prio == "3-MEDIUM", "Monthly").when(prio == "4-NOT SPECIFIED", "Daily")
         .alias("check_in_cadence"),
        F.when(price < 100000, "poor").when(price < 200000, "Fair").when(price < 300000, "good")
         .when(price < 400000, "excellent").alias("health_text"),
        F.when(flag == "A", "Yes").when(flag == "N", "No").when(flag == "R", "TBA")
         .alias("will_have_replacement"),
        F.when(key % 7 == 0, "Yes").when(key % 7 < 4, "No").alias("pip_implemented"),
        F.when(key % 5 == 0, "x").otherwise("no").alias("relief_offered"),
        F.col("seats").alias("seat_count"),
        flag.alias("termination_reason"),
        F.col("n_name").alias("geo_location"),
        F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No")
         .alias("client_lost"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("prediction_date"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("churn_probability"),
        F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
         .filter(F.col("event_type").isin("error", "purchase")))
    return e.select(
        F.col("user_id").alias("client_id"),
        F.to_date("ts").alias("prediction_date"),
        F.col("ts").alias("feedback_date"),
        (F.col("event_type") == "error").alias("actually_churned"),
    )


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
         .filter(F.col("event_type").isin("view", "click")))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("team_member_id"),
        F.col("ts").alias("date"),
        (F.col("value") / F.lit(50.0)).alias("hours_worked"),
        (F.col("value") < 20).alias("is_late"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("p"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
    )


ADAPTERS = {
    "clients": clients, "team_members": team_members, "terminations": terminations,
    "predictions": predictions, "feedback": feedback, "attendance": attendance, "scored": scored,
}
