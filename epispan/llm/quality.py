"""Quality rules: how much of a text lies in repeated n-grams and repeated lines.

Words become numbers per text. A window of n words has a rolling hash (a difference of prefix sums of a 64-bit polynomial,
in numpy), so each n-gram length costs one sort. A word is repeated at length n if a window around it equals an *earlier*
window; its characters count once. Verdict: reject if the repeated characters exceed the limit of any length, or the
characters of lines equal to an earlier line exceed theirs. The base counts (3-word windows, symbols) are exact.

Defined results: a null text has no words and fails the base rule; rows are never joined or merged.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import WHITE, Batches, mix64, record, texts

#: Most percent of the word characters that may lie in repeated windows of n words, and in repeated lines.
WINDOW_LIMITS = {5: 30, 7: 25, 10: 20}
LINE_LIMIT = 30
BASE_WINDOW = 3
MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
ROLL_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
PACK_BITS = 21

SCHEMA_DDL = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, "
    + ", ".join(f"dup_{n}gram_chars bigint" for n in WINDOW_LIMITS)
    + ", base_failed boolean, kept boolean"
)
SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("dup_line_chars", pa.int64())]
    + [(f"dup_{n}gram_chars", pa.int64()) for n in WINDOW_LIMITS]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                steps = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
                self.up, self.down = steps(ROLL_BASE), steps(pow(ROLL_BASE, -1, 2**64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Quality(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    dup_line_chars: int
    dup_gram_chars: tuple[int, ...]
    base_failed: bool
    kept: bool


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a number, equal words alike, and the code points of each word."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in seen), np.int64, len(seen))
    return ids, chars[ids] if len(ids) else ids


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of n numbers."""
    up, down = POWERS.get(len(ids))
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum(mix64(ids + 1) * up, dtype=np.uint64)]
        return (prefix[n:] - prefix[:-n]) * down[: len(ids) - n + 1]


def exact_windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for every window of n numbers, equal only for equal windows."""
    count = len(ids) - n + 1
    if n * PACK_BITS <= 63 and ids.max(initial=0) < 1 << PACK_BITS:
        packed = np.zeros(count, np.int64)
        for k in range(n):
            packed = (packed << PACK_BITS) | ids[k : k + count]
        return packed
    return np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True)[1].ravel()


def covered(windows: np.ndarray, n: int, n_words: int, first_too: bool) -> np.ndarray:
    """Words inside a window that equals an earlier one (or, with ``first_too``, any other one)."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    if first_too:
        hit[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, np.int64)
    edge[: len(hit)] += hit
    edge[n : n + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    lines, chars, seen = 0, 0, set()
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            chars += len(line) - sum(map(line.count, WHITE))
        elif line.strip(WHITE):
            seen.add(line)
    return lines, chars


def measure(text: str) -> Quality:
    words = text.encode().split()  # bytes.split() cuts at ASCII white space only
    n_words = len(words)
    ids, chars = numbered(words)
    total = int(chars.sum())
    n_dup_lines, dup_line_chars = repeated_lines(text)
    n_repeat = int(covered(exact_windows(ids, BASE_WINDOW), BASE_WINDOW, n_words, True).sum()) if n_words >= BASE_WINDOW else 0
    grams = tuple(
        int(chars[covered(window_hashes(ids, n), n, n_words, False)].sum()) if n_words >= n else 0 for n in WINDOW_LIMITS
    )
    failed = n_words < MIN_WORDS or 100 * n_repeat > BASE_REPEAT_PERCENT * n_words
    repetitive = 100 * dup_line_chars > LINE_LIMIT * total or any(
        100 * c > limit * total for c, limit in zip(grams, WINDOW_LIMITS.values(), strict=True)
    )
    return Quality(
        n_words, total, len(SYMBOLS.findall(text)), n_dup_lines, n_repeat, dup_line_chars, grams, failed, not failed and not repetitive
    )


def measure_quality(docs: DataFrame) -> DataFrame:
    """Counts, coverage and verdict per row of ``docs``."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            rows = [measure(t) for t in texts(batch)]
            plain = [[getattr(r, c) for r in rows] for c in Quality._fields[:6]]
            grams = [[r.dup_gram_chars[k] for r in rows] for k in range(len(WINDOW_LIMITS))]
            yield record(SCHEMA, batch.column("doc_id"), *plain, *grams, [r.base_failed for r in rows], [r.kept for r in rows])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, SCHEMA_DDL)


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text passes; the verdict is a column next to them, so ids play no part."""

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        return pd.Series([measure(t or "").kept for t in text], dtype=bool)

    return docs.where(passes(docs["text"]))


def _window_sql(n: int) -> str:
    """Word characters inside n-word windows that equal an earlier window of the text."""
    following = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(n))
    return f"""
grams{n} AS (SELECT doc_id, i, [{following}] AS gram, lead(i, {n - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS last_i FROM words),
later{n} AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS nth FROM grams{n} WHERE last_i IS NOT NULL)
  WHERE nth > 1),
inside{n} AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM later{n}),
covered{n} AS (
  SELECT doc_id, sum(length(w))::BIGINT AS dup_{n}gram_chars FROM words JOIN inside{n} USING (doc_id, i) GROUP BY doc_id)"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i
  FROM docs),
sums AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs),
again AS (
  SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth
  FROM lines),
line_sums AS (
  SELECT doc_id, count(*) FILTER (WHERE nth > 1 AND chars > 0) AS n_dup_lines,
         coalesce(sum(chars) FILTER (WHERE nth > 1), 0)::BIGINT AS dup_line_chars
  FROM again GROUP BY doc_id),
threes AS (
  SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o] AS gram, lead(i, 2) OVER o AS last_i
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM threes WHERE last_i IS NOT NULL)
  WHERE times > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {BASE_WINDOW})) AS p FROM twice) GROUP BY doc_id),
{",".join(_window_sql(n) for n in WINDOW_LIMITS)},
counted AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, dup_line_chars,
         {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in WINDOW_LIMITS)}
  FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN line_sums USING (doc_id) LEFT JOIN repeats USING (doc_id)
       {" ".join(f"LEFT JOIN covered{n} USING (doc_id)" for n in WINDOW_LIMITS)}),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
         100 * dup_line_chars > {LINE_LIMIT} * word_chars
         {" ".join(f"OR 100 * dup_{n}gram_chars > {limit} * word_chars" for n, limit in WINDOW_LIMITS.items())} AS repetitive
  FROM counted)
SELECT * EXCLUDE (repetitive), NOT base_failed AND NOT repetitive AS kept FROM judged
"""
