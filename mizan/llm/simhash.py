"""SimHash near-duplicates by covering locality-sensitive hashing.

A table is a mask of fingerprint bits; its key is the masked fingerprint. Give each bit one of the 15 non-zero vectors of
four bits, and let table v (again non-zero, of four bits) keep the bits whose vectors have odd parity with v. The vectors
of three differing bits span at most three dimensions, so some v is even with all three: that table keeps none of them,
and every pair within radius 3 meets in some table.

A bucket over BUCKET distinct fingerprints is dealt into 15 tables again, over the bits that its mask left free; what
its members differ in lies among those. After three levels at most seven bits are free, so buckets are small by
construction, and no pair is lost. Buckets give a forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, saved
from .components import connected

RADIUS, SHINGLE, SEED = 3, 3, 42
TABLES = 2 ** (RADIUS + 1) - 1
#: The most distinct fingerprints that are compared in one bucket; larger buckets are dealt out again.
BUCKET = 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text, unsigned; 0 without words. Only A to Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[i : i + 4096], stops[i : i + 4096], strict=True)], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes())


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp long) of each row; null text has no words, so fingerprint 0."""
    arrow_limits(df.sparkSession)
    text = F.col(text_col).cast("string")
    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, text_key long, fp long")


def masks(free: list[int]) -> list[int]:
    """Bit masks of the tables over these bits."""
    return [sum(1 << bit for i, bit in enumerate(free) if ((i % TABLES + 1) & v).bit_count() & 1) for v in range(1, TABLES + 1)]


def levels(depth: int = 3) -> list[list[list[int]]]:
    """For each level and each table of the level before (one at first): masks of the tables that it is dealt into."""
    out, before = [], [0]
    for _ in range(depth):
        out.append([[m | more for more in masks([b for b in range(64) if not m >> b & 1])] for m in before])
        before = [m for group in out[-1] for m in group]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From arrays of fingerprints: each member with the least member of its part of the bucket."""
    for batch in batches:
        column = batch.column(0)
        values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(column.offsets.to_numpy())
        ends = np.cumsum(sizes)
        a, b = [], []
        two = ends[sizes == 2]
        x, y = values[two - 2], values[two - 1]
        near = np.bitwise_count(x ^ y) <= RADIUS
        a.append(x[near])
        b.append(y[near])
        for n, end in zip(sizes[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            own = np.sort(values[end - n : end])
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS
            label = np.arange(n)
            while True:
                new = np.where(near, label[None, :], n).min(axis=1)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = label != np.arange(n)
            a.append(own[moved])
            b.append(own[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])


def near_links(prints: DataFrame, fp: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints that connect exactly what lies within the radius."""
    spark = prints.sparkSession
    todo = prints.select(F.lit(0).alias("t"), F.col(fp).alias("fp"))
    found = None
    plan = levels()
    for depth, groups in enumerate(plan):
        every = F.array(*(F.array(*(F.lit(_signed(m)) for m in g)) for g in groups))
        dealt = todo.select("t", "fp", F.posexplode(F.get(every, "t"))).select(
            (F.col("t") * TABLES + F.col("pos")).alias("t"), F.col("fp").bitwiseAND(F.col("col")).alias("k"), "fp"
        )
        large = None
        if depth + 1 < len(plan):
            large = saved(dealt.groupBy("t", "k").count().where(F.col("count") > bucket).select("t", "k"), "buckets")
            if large.isEmpty():
                large = None
        small = dealt if large is None else dealt.join(large, ["t", "k"], "left_anti")
        links = small.groupBy("t", "k").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1).select("own").mapInArrow(_forest, "a long, b long")
        found = links if found is None else found.union(links)
        if large is None:
            break
        todo = saved(dealt.join(large, ["t", "k"], "left_semi").select("t", "fp"), "crowded")
    return found


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, fp, component_id, stays) of each row: component_id is the least doc_id reachable by links of at most
    3 bits; stays marks the one document of a component that a deduplication keeps, that of the least id.

    Equal fingerprints are one node, so copies are never expanded. Null ids keep their row and come last; a component of
    null ids alone has a null component_id. Rows repeated with id and text have the same marks.
    """
    prints = saved(fingerprints(df, id_col, text_col), "fingerprints")
    this = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(this).alias("keeper")), "nodes")
    by_print = connected(near_links(nodes))  # over fingerprints; a root there need not hold the least doc_id
    roots = by_print.join(nodes, by_print["node"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("least"), F.min("keeper").alias("kept"))
    moved = by_print.join(roots, "root").select(F.col("node").alias("fp"), F.lit(True).alias("moved"), "least", "kept")
    own = nodes.join(moved, "fp", "left")
    pick = lambda a, b: F.when(F.col("moved"), F.col(a)).otherwise(F.col(b))
    every = saved(own.select("fp", pick("least", "first").alias("component_id"), pick("kept", "keeper").alias("keeper")), "components")
    # a join of two tables as they are, so that a fingerprint of very many documents can be split
    return prints.join(every, "fp").select("doc_id", "text_key", "fp", "component_id", this.eqNullSafe(F.col("keeper")).alias("stays"))


def op3(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents, "doc_id", "text")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
