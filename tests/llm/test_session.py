"""Corpus operators leave the session as other parts of the library need it."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import corpus_pipeline
from epispan.llm.components import components
from epispan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WATCHED = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.compression.codec")


def logistic_rows(spark) -> int:
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    return LogisticRegression(maxIter=3).fit(data).transform(data).where("probability is not null").count()


def test_logistic_fit_after_components(spark):
    links = spark.createDataFrame([(3, 1), (3, 2), (9, 8)], "a bigint, b bigint")
    assert {(r.id, r.component) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert logistic_rows(spark) == 200


def test_logistic_fit_after_near_duplicates_and_pipeline(spark):
    before = [spark.conf.get(name) for name in WATCHED]
    QUERIES["op9_near_duplicates"](spark, SF_DIR).count()
    QUERIES["op5_lm_scores"](spark, SF_DIR).count()
    corpus_pipeline.run(spark, SF_DIR).count()
    assert logistic_rows(spark) == 200
    assert [spark.conf.get(name) for name in WATCHED] == before
