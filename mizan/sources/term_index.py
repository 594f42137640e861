"""A posting table of the trigrams of case texts, so that a search reads the cases that may match and no others.

Layout under the index's folder: cases/bucket=… (the cases, by a hash of their key, each with a ``place`` of its own), postings/part=…
(gram, bucket, block, offsets, n), sorted by gram, grams/part=… (gram, n: cases that hold it), by a hash of the gram. Places are
numbers that rise along a file, so a run of cases has one row for each of its grams: the block of 32,768 places, and the cases'
offsets in it. A posting is two bytes, and rows that are shuffled and sorted are those of runs, not of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve
from ..shared import arrow_limits

GRAM = 3
#: Grams of a term whose lists are intersected, the rarest first.
LISTS = 3
#: With a rarest gram in more than this share of the cases a term prunes nothing worth the lists: all cases are read.
SHARE = 0.2
#: Postings that a task holds before it writes the rows of a run.
RUN = 1 << 20
#: Bits of a place within its block: offsets are 16-bit numbers. And those of a character in the code of a gram.
BLOCK, CHARACTER = 15, 21
_POSTINGS = "gram string, bucket int, block long, offsets array<short>, n int"


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def gram_codes(text: str) -> np.ndarray:
    """The grams of a text as numbers, each once."""
    own = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    found = own[:-2] << 2 * CHARACTER | own[1:-1] << CHARACTER | own[2:]
    found.sort()
    return found[np.diff(found, prepend=-1) > 0]


def gram_of(code: int) -> str:
    return "".join(chr(code >> k & (1 << CHARACTER) - 1) for k in (2 * CHARACTER, CHARACTER, 0))


def _run(bucket: int, block: int, offsets: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each gram of a run of cases; offsets and codes: of its cases."""
    every, places = np.concatenate(codes), np.repeat(np.array(offsets, np.int16), [len(c) for c in codes])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    borders = np.append(first, len(every)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(places[order]))
    same = lambda x, kind: pa.array(np.full(len(first), x, kind))
    return pa.RecordBatch.from_arrays([pa.array(map(gram_of, every[first].tolist()), pa.string()), same(bucket, np.int32), same(block, np.int64), lists, pa.array(np.diff(borders))], ["gram", "bucket", "block", "offsets", "n"])


def postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of cases (bucket, place, text), run by run: a run ends with its block or bucket, or with RUN postings."""
    at, held, offsets, codes = None, 0, [], []
    for b in batches:
        for bucket, place, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (at != (bucket, place >> BLOCK) or held >= RUN):
                yield _run(*at, offsets, codes)
                held, offsets, codes = 0, [], []
            at, own = (bucket, place >> BLOCK), gram_codes(text or "")
            if len(own):
                held += len(own)
                offsets.append(place & (1 << BLOCK) - 1)
                codes.append(own)
    if held:
        yield _run(*at, offsets, codes)


class TermIndex:
    def __init__(self, spark: SparkSession, base: str, parts: int = 64):
        self.spark, self.base, self.parts = spark, base.rstrip("/"), parts

    def _part(self, column: str):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.parts)).cast("int")

    def write(self, cases: DataFrame) -> None:
        """Index cases (catalog_key, normalized_text, …); what was there is replaced."""
        arrow_limits(self.spark)
        own = cases.withColumn("bucket", F.pmod(F.xxhash64(F.col("catalog_key").cast("string")), F.lit(self.parts)).cast("int"))
        placed = own.hint("rebalance", "bucket").sortWithinPartitions("bucket").withColumn("place", F.monotonically_increasing_id())
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/cases")
        read = self.spark.read.parquet(f"{self.base}/cases").select(F.col("bucket").cast("int").alias("bucket"), "place", "normalized_text")
        postings = read.mapInArrow(postings_of, _POSTINGS).withColumn("part", self._part("gram"))
        postings.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.base}/postings")
        counts = self.spark.read.parquet(f"{self.base}/postings").groupBy("part", "gram").agg(F.sum("n").alias("n"))
        counts.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.base}/grams")

    def _read(self, table: str, column: str, parts: set[int]) -> DataFrame:
        """The rows of some parts only: other folders are not opened."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}")
        there = {s.getPath().getName() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
        paths = [f"{self.base}/{table}/{column}={p}" for p in sorted(parts) if f"{column}={p}" in there]
        whole = self.spark.read.option("basePath", f"{self.base}/{table}")
        return whole.parquet(*paths) if paths else whole.parquet(f"{self.base}/{table}").limit(0)

    def _lists(self, terms: list[str]) -> list[list[str]] | None:
        """For each term that may stand somewhere its rarest grams; null if some term prunes too little."""
        if any(len(t) < GRAM for t in terms):
            return None
        every = sorted(set().union(*map(grams, terms)))  # of MAX_TERMS terms at most
        asked = self.spark.createDataFrame([(g,) for g in every], "gram string").withColumn("part", self._part("gram"))
        parts = {r[0] for r in asked.select("part").distinct().collect()}
        known = self._read("grams", "part", parts).where(F.col("gram").isin(every))
        n = {r["gram"]: r["n"] for r in known.collect()}
        total = self.spark.read.parquet(f"{self.base}/cases").count()  # from the files' footers
        out = []
        for t in terms:
            rarest = sorted(grams(t), key=lambda g: (n.get(g, 0), g))[:LISTS]
            if n.get(rarest[0], 0) > SHARE * total:
                return None
            if rarest[0] in n:
                out.append(rarest)
        return out

    def candidates(self, terms: list[str]) -> DataFrame:
        """All cases that may hold one of the terms (plain forms), and few others."""
        lists = self._lists(terms)
        if lists is None:
            return self.spark.read.parquet(f"{self.base}/cases").drop("place", "bucket")
        wanted = [(i, g) for i, own in enumerate(lists) for g in own]
        asked = self.spark.createDataFrame(wanted, "term int, gram string").withColumn("part", self._part("gram"))
        parts = {r[0] for r in asked.select("part").distinct().collect()}
        postings = self._read("postings", "part", parts).where(F.col("gram").isin(sorted({g for _, g in wanted})))
        sizes = F.create_map(*(F.lit(x) for i, own in enumerate(lists) for x in (i, len(own)))) if lists else F.create_map().cast("map<int,int>")
        place = F.shiftleft("block", BLOCK) + F.col("offset")
        both = postings.join(F.broadcast(asked.select("term", "gram")), "gram").select("term", "bucket", "block", F.explode("offsets").alias("offset"))
        both = both.groupBy("term", "bucket", place.alias("place")).agg(F.count("*").alias("n"))
        places = both.where(F.col("n") == sizes[F.col("term")]).select("bucket", "place").distinct()
        buckets = {r[0] for r in places.select("bucket").distinct().collect()}  # at most self.parts
        return self._read("cases", "bucket", buckets).join(places.select("place"), "place", "left_semi").drop("place", "bucket")

    def search(self, terms: list[str], preferred: tuple[str, ...] = (), limit: int = 20, recall_cap: int | None = None) -> DataFrame:
        """What retrieve.search gives over all cases."""
        plain = retrieve.retrieval_terms(terms)[: retrieve.MAX_TERMS]
        found = self.candidates(plain) if plain else self.spark.read.parquet(f"{self.base}/cases").drop("place", "bucket")
        return retrieve.search(found, terms, preferred, limit, recall_cap)
