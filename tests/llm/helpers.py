"""Fixture rows and plain versions shared by the tests."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SF = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    """(doc_id, text[, lang, source]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def clashing(df):
    """Extra columns under names that the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("fp", "component_id", "bucket", "work", "row", "size", "rank", "part_", "a", "node", "row_", "n_", "block",
                 "sequence_id", "piece", "score", "rejected", "taken", "round", "n_bytes", "host", "side", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def components(nodes, links):
    """Least reachable member of each node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
