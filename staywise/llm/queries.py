"""One registered query per operator: production parameters, whole tables.
Each derives its columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm import align, htmltext, langid, lexical, mix, pack, pii, simhash, substrings, tokencount, topk, vectordup, warc
from staywise.llm.common import prepare
from staywise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_topk", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector with all others."""
    e = table(spark, sf_dir, "embeddings")
    return topk.top_k(e, e.where(F.pmod("vec_id", F.lit(50)) == 0), k=5, scale=256)


@query("op2_substrings")
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes repeated in strings of 50 from documents with a smaller id."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_mix")
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix of all sources."""
    return mix.taken(table(spark, sf_dir, "documents"))


@query("op4_vectordup", """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, r.c AS component_id, r.c = v.vec_id AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = v.vec_id""")
def op4_vectordup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.9 or more."""
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op5_pack")
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids."""
    return pack.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op7_tokencount")
def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the limit is 2048."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_htmltext")
def op9_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4: documents at 2 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


@query("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns only from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder() != 2))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op11_lexical", r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
t AS (SELECT d, any_value(doc_id) AS doc_id, any_value(len(words)) AS n, term, count(*) AS tf
      FROM (SELECT d, doc_id, words, unnest(words) AS term FROM w) GROUP BY d, term),
total AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(len(words)) AS BIGINT) AS L_ FROM w WHERE len(words) > 0),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N_) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, total GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, text, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
it AS (SELECT item_id, text, term, count(*) AS reps FROM iw GROUP BY ALL),
s AS (SELECT it.item_id, it.text, t.d, any_value(t.doc_id) AS doc_id,
        CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_) // L_)))) AS BIGINT) AS score
      FROM it JOIN t ON t.term = it.term JOIN wt ON wt.term = it.term, total GROUP BY it.item_id, it.text, t.d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10""")
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_align")
def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of a byte-level and a sentencepiece tokenizer."""
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER), 1)
    for k in range(32)], '') AS payload_digest,
  CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest IS NULL OR page_id = largest THEN NULL ELSE largest END AS refers_to
FROM d""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
