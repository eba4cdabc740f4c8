"""Registered corpus queries against their SQL, and the pipeline against a plain version."""

import collections
import glob
import hashlib
import os
import sys

import duckdb
import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from check import rows_of  # noqa: E402
from epispan.llm import bpe, lines, mixing, quality  # noqa: E402
from epispan.llm.queries import QUERIES, SQL  # noqa: E402
from plain import components_of, kept_texts  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in sorted(glob.glob(f"{SF_DIR}/*.parquet")):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, cursor.fetchall())


def test_language_is_right_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op4_language"](spark, SF_DIR).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_pipeline_equals_plain_version(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    docs = [d for d in docs if quality.measure(d[1] or "").kept]
    texts = kept_texts({i: t for i, t, _ in docs}, lines.MIN_KEY_CHARS)
    docs = [(i, texts[i], s) for i, _, s in docs if texts[i] is not None]
    component = components_of({i: t for i, t, _ in docs}, corpus_pipeline.NEAR_SIMILARITY)
    docs = [d for d in docs if component[d[0]] == d[0]]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    copies = {i: taken // size for i, size, _, _, taken in duck.execute(mixing.ORACLE).fetchall() if size}
    codec = bpe.Codec(*bpe.default_vocabulary())
    want = collections.Counter()
    for i, text, _ in docs:
        ids = np.frombuffer(codec.encode([text])[0], "<u4").tobytes()
        want[i, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] = copies[i]
    got = collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == +want


def test_pipeline_stages_keep_columns_and_bear_empty_tables(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 0


def test_pipeline_stages_bear_edge_cases(spark, corpus):
    docs = corpus
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == corpus.columns
    assert docs.count() > 0
