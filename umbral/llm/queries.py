"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm import bestfit, codes, exact, language, near, packing, pieces, quality, spelling, suffixes, tokenfile, topk, toxicity
from umbral.llm.common import configure, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_exact_dedup(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def held_out(modulus: int, rest: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


@query
def op2_sentencepiece(spark, folder):
    """Number and crc32 of every document's ids, and whether they decode to its text."""
    vocabulary = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    return pieces.encoded_digest(table(spark, folder, "documents"), vocabulary)


@query
def op3_near_dedup(spark, folder):
    return near.near_groups(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query
def op4_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op5_language(spark, folder):
    """Language of every page; the text model is counted on all documents."""
    return language.identify_pages(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query
def op6_suffix_dedup(spark, folder):
    return suffixes.suffix_digest(table(spark, folder, "documents"))


@query
def op7_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out(5, 0))


@query
def op8_pack(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op9_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out(3, 1))


@query
def op10_token_file(spark, folder):
    return tokenfile.token_file_digest(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op11_spelling_forms(spark, folder):
    return spelling.spelling_forms(table(spark, folder, "documents"))


@query
def op12_best_fit_pack(spark, folder):
    return bestfit.best_fit_pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op13_vector_codes(spark, folder):
    return codes.code_digest(table(spark, folder, "embeddings"))


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """All distances of all rounds; for vectors of one length, which four divides."""
    books = """
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS e FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256
)"""
    for t in range(rounds + 1):
        books += f""", a{t} AS MATERIALIZED (
  SELECT vec_id, label, parts.p, x,
    min(CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, e)]) AS HUGEINT) * 256 + entry) AS m
  FROM parts JOIN b{t} USING (p) GROUP BY vec_id, label, parts.p, x
)"""
        if t < rounds:
            books += f""", m{t} AS (
  SELECT p, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS e
  FROM (
    SELECT p, CAST(m % 256 AS BIGINT) AS entry, i, CAST(sum(x[i]) AS DOUBLE) AS total, count(*) AS n
    FROM a{t}, generate_series(1, len(x)) g(i) GROUP BY ALL
  ) GROUP BY p, entry
), b{t + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m{t}.e, b{t}.e) AS e FROM b{t} LEFT JOIN m{t} USING (p, entry))"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, generate_series(0, 3) g(p)
), {books}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(e[i], ',' ORDER BY p, entry, i)) FROM b{rounds}, generate_series(1, len(e)) g(i)) AS codebooks_sha256
FROM coded
"""


ORACLES["op13_vector_codes"] = _codes_sql()
