"""Source divergence audit: how the words of a source differ from those of each other source of its language, and of the language.

A language's kept terms (in enough of its documents) are an integer dictionary: sorted by UTF-8, a term's place is its id.
The dictionary is cut into chunks of ids, of a bounded number of cells (terms times sources). In a chunk, ids come by searchsorted
over the sorted terms, counts of all sources by bincount as one dense matrix, and so the shares, differences and best terms,
ties by id. Chunks give sums for pairs and at most TOP terms of a source, which are merged.

Texts are counted in their tasks first, so the shuffles carry distinct terms of a task, never words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, saved
from .words import PIECE, distinct, pieces

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: A term is kept that is in MIN_DOCS documents; SCALE is the unit of a share and PRIOR what is added to each count.
MIN_DOCS, SCALE, PRIOR, TOP = 30, 10**9, 5, 50
#: Terms that a task counts before it hands them on, and cells of a chunk's matrix, about.
COUNTED, CELLS = 300_000, 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n occurrences, d documents) of a task, and a row with a null term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            for some in _runs([None, *n]):
                columns = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                terms = pa.array([t and t.decode("utf-8", "replace") for t in some], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, terms, *(pa.array([c[t] for t in some], pa.int64()) for c in (n, d))], ["lang", "source", "term", "n", "d"])
        groups.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            low = text.as_buffer().to_pybytes().lower()  # of bytes: A to Z alone
            n, d = groups.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            if len(low) <= PIECE:
                terms = TERM.findall(low)
                n.update(terms)
                d.update(set(terms))
            else:
                for p in pieces(low, _GAP):
                    n.update(TERM.findall(p))
                for some in distinct(low, _GAP, TERM.findall):
                    d.update(some)
            size += len(n)
            if size >= COUNTED:
                yield from told()
                size = 0
    yield from told()


def _runs(items: list, size: int = 1 << 16) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), exact: a long division, three decimal digits of SCALE at a time."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value) of a chunk, a source after another. Pairs come once, in order."""
    group = pa.Table.from_batches(list(batches))  # at most CELLS, about, by the number of chunks
    lang, is_head = group.column("lang")[0], pc.is_null(group.column("term"))
    head, cells = group.filter(is_head), group.filter(pc.invert(is_head))
    coded = lambda t, c: np.array([x.encode() for x in t.column(c).to_pylist()], object)
    names, total = coded(head, "source"), np.asarray(head.column("n"))
    order = np.argsort(names)
    names, total, v = names[order], total[order], head.column("v")[0].as_py()
    terms = coded(cells, "term")
    kept = np.unique(terms)  # this chunk of the dictionary
    width = len(kept)
    at = np.searchsorted(names, coded(cells, "source")) * width + np.searchsorted(kept, terms)
    # a row for each cell and counts under 2^53, so the weights are exact
    count = np.bincount(at.astype(np.int64), np.asarray(cells.column("n")), len(names) * width).astype(np.int64).reshape(len(names), width)
    p = shares(count + PRIOR, np.maximum(1, total + PRIOR * v)[:, None])
    q = shares(count.sum(axis=0) + PRIOR, max(1, total.sum() + PRIOR * v))
    for i, name in enumerate(names):
        apart = np.abs(p[i + 1 :] - p[i]).sum(axis=1)
        more = np.flatnonzero((count[i] > 0) & (p[i] > q))
        best = more[np.lexsort((more, q[more] - p[i][more]))[:TOP]]
        items, values = np.concatenate([names[i + 1 :], kept[best]]), np.concatenate([apart, (p[i] - q)[best]])
        parts = ["pair"] * len(apart) + ["term"] * len(best)
        same = [pa.array([x] * len(parts), pa.string()) for x in (lang.as_py(), name.decode())]
        columns = [*same, pa.array(parts, pa.string()), pa.array([x.decode() for x in items], pa.string()), pa.array(values, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _numbered(kept: DataFrame) -> DataFrame:
    """(lang, term, id): ids from 0 in order. Ranges of terms are numbered apart, each from the end of the one before."""
    ranges = saved(kept.repartitionByRange("lang", "term").withColumn("range", F.spark_partition_id()), "divergence-ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("lang", "term")) - 1
    return ranges.withColumn("place", place).join(starts, "range").select("lang", "term", (F.col("start") + F.col("place")).alias("id"))


def diverge(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank). Nulls in text, lang and source are empty strings; each row is a document.

    A group without terms has pairs; a language without kept terms has pairs of value 0; a lone source has no pairs."""
    arrow_limits(documents.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = documents.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counted = src.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    every = saved(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "divergence-counts")
    kept = every.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= min_docs).select("lang", "term")
    groups = every.where(F.col("term").isNull()).select("lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    dictionary = saved(_numbered(kept).select("lang", "term", F.expr(f"id div {max(1, CELLS // max(1, most))}").alias("chunk")), "divergence-dictionary")
    cells = saved(every.join(dictionary, ["lang", "term"]).select("lang", "chunk", "source", "term", "n"), "divergence-cells")
    # totals of each group, and of chunks all groups of their language; chunk -1 stands for languages without kept terms
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = dictionary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v"])
    places = dictionary.select("lang", "chunk").distinct()
    bare = groups.select("lang").distinct().join(sizes, "lang", "left_anti").select("lang", F.lit(-1).alias("chunk"))
    heads = places.unionByName(bare).join(totals, "lang").select("lang", "chunk", "source", F.lit(None).cast("string").alias("term"), "n", "v")
    fed = cells.withColumn("v", F.lit(0).cast("long")).unionByName(heads)
    found = saved(fed.groupBy("lang", "chunk").applyInArrow(_vectors, "lang string, source string, part string, item string, value long"), "divergence-chunks")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    pairs = summed.select("lang", ways.alias("x"), "value").select("lang", F.col("x.a").alias("source"), F.lit("pair").alias("part"), F.col("x.b").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(terms)


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.v) AS p
  FROM g JOIN s USING (lang, source) JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (max(w.total) + 5 * max(v.v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM s GROUP BY lang) w USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
