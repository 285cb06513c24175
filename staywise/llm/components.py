"""Connected components of a link table by alternating large-star / small-star
rounds: joins and ``min`` aggregations only, never more rows than links, and a
reliable checkpoint after each round.  Stops when a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import cut


def _pull(pairs: DataFrame) -> DataFrame:
    """(src, dst) -> every dst with the least member of {src} + neighbours."""
    low = pairs.groupBy("src").agg(F.min("dst").alias("m")).select(
        F.col("src").alias("u"), F.least("src", "m").alias("m"))
    return pairs.join(low, pairs["src"] == low["u"]).select("src", "dst", "m")


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    large = _pull(both).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    large = large.where("src <> dst").distinct()
    # every link now points down: src > dst
    p = _pull(large)
    small = (p.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
             .unionByName(p.select("src", F.col("m").alias("dst"))))
    return small.where("src <> dst").distinct()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links``: two long columns (any order, repeats and self-links allowed,
    rows with a null end ignored).  Returns (node, component) for every node of
    a link; component is the least node that it reaches.  An empty table gives
    an empty result."""
    a, b = links.columns[:2]
    e = links.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, seen = cut(e), None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, e = state, cut(_round(e))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
