"""The pipeline and the registered queries."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from test_llm_exact import brute as exact_groups
from test_llm_near import brute as near_groups
from test_llm_suffixes import brute as repeats
from umbral.llm.queries import ORACLES, QUERIES, held_out

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_folds(spark):
    rows = spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", held_out(3, 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_spelling_forms"}))  # which has a row for each word
def test_one_row_per_document(spark, name):
    df = QUERIES[name](spark, FOLDER)
    key = "id" if "id" in df.columns else "doc_id"
    assert df.select(F.count_distinct(key)).first()[0] == spark.read.parquet(f"{FOLDER}/{'pages' if key == 'id' else 'documents'}.parquet").count()


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["language"](spark, docs, FOLDER)
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert clean.columns == docs.columns and len(rows) == docs.count()
    unique = stage["exact_dedup"](spark, clean, FOLDER)
    want = sorted(i for i, _, _, kept, _ in exact_groups(rows) if kept)
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == want
    rows = [(i, t) for i, t in rows if i in set(want)]
    apart = stage["near_dedup"](spark, unique, FOLDER)
    want = sorted(i for i, _, _, kept in near_groups(rows) if kept)
    assert apart.columns == docs.columns and sorted(r["doc_id"] for r in apart.collect()) == want
    rows = [(i, t) for i, t in rows if i in set(want)]
    cut = stage["suffix_dedup"](spark, apart, FOLDER)
    assert cut.columns == docs.columns
    sizes = {i: n - gone for i, n, gone, _, _ in repeats(rows)}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got.keys() == sizes.keys() and all(0 <= sizes[i] - len(t.encode()) <= 6 for i, t in got.items())
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(want)


def test_crc_of_ids():
    from umbral.llm.tokens import crc_of

    assert crc_of(np.array([1, 65535], "<u2")) == zlib.crc32(np.array([1, 65535], "<u4").tobytes())
