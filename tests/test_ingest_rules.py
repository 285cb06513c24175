"""Form CSV import (A1/A2, trap T15) and importance-gated factors (I4)."""

from pyspark.sql import functions as F

from staywise.operators import rules as R
from staywise.sources import ingest as I


def test_import_headers_and_booleans(spark, tmp_path):
    csv = tmp_path / "form.csv"
    csv.write_text(
        "Client Name,Team Member  Start Date ,Timeframe for Replacement,Time Frame for Replacement,"
        "Have we lost the Client?,Was a Performance Improvement Plan Implemented?,Unmapped Column\n"
        "Acme,2024-01-02,\"  \",2-4 weeks,Yes,x,zzz\n"
        "  ,2024-01-03,Immediate,,No,no,zzz\n"
        "Beta,1/2/2024,Immediate,,No,TRUE,zzz\n")
    df = I.import_terminations(spark, str(csv))
    assert "team_member_start_date" in df.columns and "Unmapped Column" not in df.columns
    rows = {r.client_name: r for r in df.collect()}
    assert set(rows) == {"Acme", "Beta"}          # blank client name dropped
    assert rows["Acme"].replacement_timeframe == "2-4 weeks"   # two source headers merged
    assert rows["Acme"].client_lost == 1 and rows["Beta"].client_lost == 0
    assert rows["Acme"].pip_implemented == 1 and rows["Beta"].pip_implemented == 1


def test_gated_factors_five_clients(spark):
    rows = [("poor", 45, 30, 2, 1, 180), ("fair", 14, 7, 5, 0, 365), ("good", 7, 7, 8, 0, 730),
            ("excellent", 3, 3, 12, 0, 1095), ("poor", 60, 45, 1, 1, 90)]
    health = {"poor": 1, "fair": 2, "good": 3, "excellent": 4}
    df = spark.createDataFrame([(i, health[h], c, k, s, n, t) for i, (h, c, k, s, n, t) in enumerate(rows)],
                               "id long, health_score int, days_since_communication int, days_since_checkin int, "
                               "current_seat_count int, no_replacement int, client_tenure_at_termination int")
    imp = spark.createDataFrame([("current_seat_count", 0.39), ("no_replacement", 0.257), ("days_since_checkin", 0.1),
                                 ("days_since_communication", 0.09), ("client_tenure_at_termination", 0.067),
                                 ("health_score", 0.0)], "feature string, importance double")
    out = {r.id: [f.factor for f in r.top_risk_factors] for r in R.gated_factors(df, imp, 5).collect()}
    assert out[0] == ["current_seat_count", "no_replacement", "days_since_checkin", "days_since_communication"]
    assert out[3] == []
    assert out[4] == ["current_seat_count", "no_replacement", "days_since_checkin", "days_since_communication",
                      "client_tenure_at_termination"]
    first = R.gated_factors(df, imp, 5).filter(F.col("id") == 0).first().top_risk_factors[0]
    assert first.importance == 39.0 and first.description == "Low seat count (2) indicates potential downsizing"
