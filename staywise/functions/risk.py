"""Risk bands, scores and metric formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two band sets of the scoring code (medium, high, critical
# lower bounds, inclusive ladder) and the right-closed bin edges of ``cut``.
STRICT_BANDS = (0.40, 0.65, 0.85)
WIDE_BANDS = (0.25, 0.50, 0.75)
LEVELS = ("low", "medium", "high", "critical")
STRICT_EDGES = (0.0, 0.40, 0.65, 0.85, 1.0)
WIDE_EDGES = (0.0, 0.25, 0.50, 0.75, 1.0)
# Tenure bucket edges (right-closed), bucket i for (e[i], e[i+1]].
TENURE_EDGES = (-1, 3, 6, 12, 24, 999)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_level(p, bands=STRICT_BANDS) -> Column:
    """Inclusive ladder: >= bands[2] critical, >= bands[1] high, >= bands[0]
    medium, else low; null probability -> null."""
    p = _c(p)
    lo, mid, hi = bands
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p >= hi, "critical").when(p >= mid, "high").when(p >= lo, "medium")
            .otherwise("low"))


def risk_cut(p, edges=STRICT_EDGES, labels=LEVELS) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; values outside (0 included) -> null."""
    p = _c(p)
    out = None
    for i, lab in enumerate(labels):
        cond = (p > edges[i]) & (p <= edges[i + 1])
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def risk_score(p) -> Column:
    """Truncate(p * 100) as int."""
    return (_c(p) * 100).cast("int")


def tenure_bucket(months, edges=TENURE_EDGES) -> Column:
    m = _c(months)
    out = None
    for i in range(len(edges) - 1):
        cond = (m > edges[i]) & (m <= edges[i + 1])
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def predicted_days(p) -> Column:
    """Days to attrition: p > 0.3 -> int(max(7, 180 * (1 - p))), else null."""
    p = _c(p)
    return F.when(p > 0.3, F.greatest(F.lit(7.0), F.lit(180.0) * (1 - p)).cast("int"))


def fbeta(precision, recall, beta: float = 0.5, eps: float = 0.0) -> Column:
    """(1+b^2) P R / (b^2 P + R); 0 when the denominator is 0 (and eps = 0)."""
    p, r = _c(precision), _c(recall)
    b2 = beta * beta
    den = b2 * p + r + F.lit(eps)
    return F.when(den == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / den)
