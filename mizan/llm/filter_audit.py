"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

What a document fails is five bits. A table of 32 rows and 120 columns says at which step of an order a document with those
bits goes; tasks index it, count by part, order, step and label with bincount, and the partial arrays are summed.

Four bits follow from the text. The fifth (a copy of a text with a smaller doc_id) does without a gathering of copies: the
least doc_id of each text, by digest, is a partial minimum, and a document is no copy if it is found among those by digest
and doc_id, a join whose keys no group of copies makes hot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, saved
from .words import PIECE, distinct, pieces

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Failure conditions: A under MIN_WORDS words, B under MIN_DISTINCT per cent distinct words, C over MAX_CAPITALS per cent
#: capitals, D any of SYMBOLS, E a copy.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOL = re.compile(rb"[" + re.escape(SYMBOLS) + rb"]")
_NO_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_INNER = bytes(range(0x80, 0xC0))  # bytes that start no code point
STEPS, STAYS = len(FILTERS), len(FILTERS)
#: Parts whose arrays a task holds at once.
PARTS = 256
MEASURES = ("total", "failing", "unique_fails", "removed", "good_lost", "toxic_lost")


def _first_failures() -> np.ndarray:
    """[bits, order] -> step (from 0) at which a document that fails these filters goes, or STAYS."""
    at = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])  # [order, filter]
    fails = np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1  # [bits, filter]
    return np.where(fails[:, None, :], at[None], STAYS).min(axis=2)


FIRST = _first_failures()


def text_failures(text: bytes) -> int:
    """Bits of A to D."""
    if len(text) <= PIECE:
        words = text.split()
        n, different = len(words), len(set(words))
    else:
        n = sum(len(p.split()) for p in pieces(text, _GAP))
        different = sum(map(len, distinct(text, _GAP, bytes.split)))
    capitals, points = len(text.translate(None, _NO_CAPITAL)), len(text.translate(None, _INNER))
    return (n < MIN_WORDS) | (100 * different < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | bool(_SYMBOL.search(text)) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = (t.as_buffer().to_pybytes() for t in b.column(2))
        both = [(text_failures(t), hashlib.sha256(t).digest()) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in both], pa.int32()), pa.array([x for _, x in both], pa.binary())], ["doc_id", "part", "bits", "digest"])


def failures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, bits): what each row fails. Null texts and parts are empty. A null id is smaller than none and has none
    smaller; rows that repeat id and text are no copies of each other."""
    arrow_limits(documents.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = documents.select(F.col(id_col).alias("doc_id"), empty(part_col).alias("part"), empty(text_col).cast("binary").alias("text"))
    rows = saved(src.mapInArrow(_judged, f"doc_id {dict(src.dtypes)['doc_id']}, part string, bits int, digest binary"), "filter-failures")
    known = rows.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = known.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("bits")).otherwise(F.col("bits").bitwiseOR(1 << FILTERS.index("E"))).alias("bits"))
    return marked.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "part", "bits"))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, filter_order, step, measures...) of a task's documents."""
    orders, cells = np.arange(len(ORDERS)), len(ORDERS) * (STEPS + 1) * 4
    letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # [order, step] -> filter
    gone: dict[str, np.ndarray] = {}  # [order, step, label]
    masks: dict[str, np.ndarray] = {}  # [bits]
    fails = np.arange(32)[:, None] >> np.arange(STEPS) & 1

    def told() -> Iterator[pa.RecordBatch]:
        for part, table in gone.items():
            n = table.reshape(len(ORDERS), STEPS + 1, 4)[:, :STEPS]
            failing, only = masks[part] @ fails, masks[part][1 << np.arange(STEPS)]
            columns = (np.full(letter.shape, masks[part].sum()), failing[letter], only[letter], n.sum(axis=2), n[..., 1] + n[..., 3], n[..., 2] + n[..., 3])
            keys = [pa.array([part] * letter.size), pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.astype(np.int64).ravel()) for c in columns)], ["part", "filter_order", "step", *MEASURES])
        gone.clear(), masks.clear()

    for b in batches:
        parts = b.column(0).dictionary_encode()
        code, bits, label = (np.asarray(x) for x in (parts.indices, b.column(1), b.column(2)))
        for k, part in enumerate(parts.dictionary.to_pylist()):
            if part not in gone and len(gone) >= PARTS:
                yield from told()
            own = code == k
            at = (orders * (STEPS + 1) + FIRST[bits[own]]) * 4 + label[own][:, None]
            gone[part] = gone.get(part, 0) + np.bincount(at.ravel(), minlength=cells)
            masks[part] = masks.get(part, 0) + np.bincount(bits[own], minlength=32)
    yield from told()


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row of documents counts once, however many rows labels has for its doc_id; any of those may say 1. No documents, no rows.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((is_one("quality") + 2 * is_one("toxic")).alias("label"))
    rows = failures(documents).join(known, "doc_id", "left").select("part", "bits", F.coalesce("label", F.lit(0)).alias("label"))
    tallied = rows.mapInArrow(_tallied, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
    sums = tallied.groupBy("part", "filter_order", "step").agg(*(F.sum(m).alias(m) for m in MEASURES))
    so_far: Column = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    its_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return sums.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(its_filter).alias("shapley"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
g AS (
  SELECT m.*, filter_order, list_min([i for i in [1, 2, 3, 4, 5, 6] if i = 6 OR contains(fails, filter_order[i])]) AS goes FROM m CROSS JOIN o),
s AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS own,
    coalesce(sum(n) FILTER (goes > step), 0) AS kept, coalesce(sum(n) FILTER (goes = step), 0) AS removed,
    coalesce(sum(n) FILTER (goes < step AND contains(fails, filter_order[step])), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (goes = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (goes = step), 0) AS toxic_lost
  FROM g CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""
