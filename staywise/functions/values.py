"""Value coercion, maps and small text helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as "true" by the boolean parser.
TRUE_WORDS = ("yes", "true", "1", "y", "x")
# Numeric text (checked before casting, so words never take the cast's error path).
NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo, hi, default=None) -> Column:
    """Fill first, then clip: ``greatest(null, 0)`` would silently be 0."""
    v = _c(x) if default is None else F.coalesce(_c(x), F.lit(default))
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def to_number(x) -> Column:
    """Text -> double, bad text -> null (plain cast raises under ANSI)."""
    s = _c(x).cast("string")
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def parse_boolean(x) -> Column:
    """null -> 0; numeric text -> nonzero; else lower/trimmed text in TRUE_WORDS."""
    s = _c(x).cast("string")
    num = F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))
    word = F.lower(F.trim(s)).isin(*TRUE_WORDS)
    return (F.when(s.isNull(), F.lit(0))
            .when(num.isNotNull(), (num != 0).cast("int"))
            .otherwise(word.cast("int")))


def map_value(x, mapping: Mapping, default=None, lower: bool = False) -> Column:
    """Lookup in a small literal map via a ``when`` chain (codegen friendly)."""
    key = F.lower(_c(x)) if lower else _c(x)
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def first_contains(x, ordered: Iterable[tuple[str, object]], default, lower: bool = True) -> Column:
    """First key (in the given order) contained in the text wins."""
    s = F.coalesce(_c(x).cast("string"), F.lit(""))
    s = F.lower(s) if lower else s
    out = None
    for k, v in ordered:
        cond = s.contains(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


def yes_flag(x) -> Column:
    """Exactly 'Yes' -> 1, anything else (null included) -> 0."""
    return F.coalesce((_c(x) == "Yes").cast("int"), F.lit(0))


def full_name(first, last) -> Column:
    """Null parts become '' and are joined by one blank (not concat_ws)."""
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 (NULLIF semantics)."""
    return F.try_divide(_c(num).cast("double"), _c(den))


def feature_map(cols) -> Column:
    """Feature columns as a map<string,double> (the JSONB document of a
    prediction row)."""
    pairs = []
    for c in cols:
        pairs += [F.lit(c), F.col(c).cast("double")]
    return F.create_map(*pairs)


def map_get(m, key: str, default) -> Column:
    """``features.get(key, default)``."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(default))
