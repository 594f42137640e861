"""Files as rows: documents with their fingerprints, stale files, backups to drop, and page texts of PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES, MAX_PAGES, PDF_MAGIC = 50 * 1024 * 1024, 1500, "255044462D"  # %PDF-


def documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pattern: str = "*.pdf") -> DataFrame:
    """(path, size_bytes, modified, sha256, is_pdf, content). The size bound is checked on metadata, before contents load."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= max_bytes)
    magic = F.hex(F.substring("content", 1, 5)) == PDF_MAGIC
    return small.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), magic.alias("is_pdf"), "content")


def pdf_faults(is_pdf: Column, encrypted: Column, page_count: Column, max_pages: int = MAX_PAGES) -> Column:
    """Why a file can't be taken, in order of check."""
    checks = ((~is_pdf, "no pdf"), (F.coalesce(encrypted, F.lit(False)), "encrypted"), (page_count < 1, "no pages"), (page_count > max_pages, "too many pages"))
    return F.array_compact(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks)))


def page_texts(files: DataFrame, engines: list[Callable[[bytes], list[str]]]) -> DataFrame:
    """(doc_id, page_no, engine_rank, text): what each engine reads from each page; an engine that fails gives none.

    An engine takes a file's bytes and returns its pages' texts. None is built in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, content in zip(pdf["sha256"], pdf["content"], strict=True):
                for rank, engine in enumerate(engines):
                    try:
                        pages = engine(content)
                    except Exception:  # one engine may fail where another reads on
                        continue
                    rows += [(sha, i, rank, text or "") for i, text in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "engine_rank", "text"])

    return files.select("sha256", "content").mapInPandas(run, "doc_id string, page_no int, engine_rank int, text string")


def stale(files: DataFrame, now: Column, max_age_hours: int, modified: str = "modified") -> DataFrame:
    """Files older than so many hours, one at least."""
    return files.where(F.col(modified) < now - F.make_dt_interval(hours=F.lit(max(1, max_age_hours))))


def surplus_backups(files: DataFrame, keep: int, path: str = "path") -> DataFrame:
    """Backups beyond the newest ``keep`` (one at least); their names carry the time, so names order them."""
    newest = F.row_number().over(Window.orderBy(F.col(path).desc()))  # a folder's backups: a few rows
    return files.withColumn("__rn", newest).where(F.col("__rn") > max(1, keep)).drop("__rn")


def backup_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".parquet"))
