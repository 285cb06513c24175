"""Column builders.  Everything here returns a ``pyspark.sql.Column`` made of
built-in expressions, so it stays inside whole-stage codegen."""

from staywise.functions.dates import (days_between, parse_date, tenure_months, month_or,
                                      quarter_or, weekday_or, to_ts)
from staywise.functions.values import (clip, to_number, parse_boolean, map_value,
                                       first_contains, yes_flag, full_name, safe_ratio)
from staywise.functions.risk import (risk_level, risk_cut, risk_score, tenure_bucket,
                                     predicted_days, fbeta, STRICT_BANDS, WIDE_BANDS)

__all__ = [
    "days_between", "parse_date", "tenure_months", "month_or", "quarter_or", "weekday_or",
    "to_ts", "clip", "to_number", "parse_boolean", "map_value", "first_contains", "yes_flag",
    "full_name", "safe_ratio", "risk_level", "risk_cut", "risk_score", "tenure_bucket",
    "predicted_days", "fbeta", "STRICT_BANDS", "WIDE_BANDS",
]
