"""What the corpus operators share: session settings, table access and the word rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.session import configure

#: The white space that ends a word, and the native pattern of a word.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

Batches = Iterator[pa.RecordBatch]


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings; the corpus operators leave no others behind."""
    return configure(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(frame: DataFrame, work: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return frame.mapInArrow(work, schema)


def emptied(out: Iterator, *caches) -> Iterator:
    """What a task yields; at its end its caches are emptied, since Spark keeps the worker for the stages to come."""
    try:
        yield from out
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts of a batch as UTF-8, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)],
        schema=schema,
    )


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix64(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers (a bijection)."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
