"""Coverage of courses and the gate before a generation is promoted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(accepted: DataFrame, courses: DataFrame, minimum: int) -> DataFrame:
    """accepted (slug, …) rows, courses (slug) -> (slug, n, status): ready, thin or missing."""
    counted = accepted.groupBy("slug").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n >= max(1, minimum), "ready").when(n > 0, "thin").otherwise("missing")
    return courses.join(counted, "slug", "left").select("slug", n.cast("long").alias("n"), status.alias("status"))


def catalog_stats(cases: DataFrame) -> DataFrame:
    return cases.groupBy("generation_id").agg(F.count("*").alias("cases"), F.countDistinct("collection_id").alias("collections"), F.countDistinct("source_id").alias("sources"))


def build_counters(documents: DataFrame) -> DataFrame:
    """documents (failed, n_cases) -> seen, indexed, failed and cases."""
    return documents.agg(
        F.count("*").alias("seen"), F.count_if(~F.col("failed")).alias("indexed"), F.count_if("failed").alias("failed"), F.coalesce(F.sum(F.when(~F.col("failed"), F.col("n_cases"))), F.lit(0)).alias("cases")
    )


def gate(stats: DataFrame, covered: DataFrame, counters: DataFrame, min_cases: int = 20, percent: int = 100, max_failures: float = 0.35) -> DataFrame:
    """One row: passed, reasons in order joined by '; ', and the figures. covered: rows of ``coverage``."""
    courses = covered.agg(
        F.count("*").alias("total_subjects"), F.count_if(F.col("status") == "ready").alias("covered_subjects"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("slug")))).alias("missing_subjects"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "thin", F.col("slug")))).alias("thin_subjects"),
    )
    one = stats.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("cases")).crossJoin(courses).crossJoin(counters.select("seen", "failed"))  # a row each
    ratio = F.when(F.col("seen") > 0, F.col("failed") / F.col("seen")).otherwise(1.0)
    required = F.ceil(F.col("total_subjects") * max(1, min(100, percent)) / 100)
    figures = one.withColumn("failure_ratio", ratio).withColumn("required_subjects", required.cast("long"))
    text = lambda c: F.col(c).cast("string")
    reasons = (
        (F.col("cases") < max(1, min_cases), F.concat(F.lit("cases "), text("cases"), F.lit(f" < required {min_cases}"))),
        (F.col("seen") <= 0, F.lit("no official documents were discovered")),
        (F.col("failure_ratio") > max_failures, F.concat(F.lit("document failure ratio "), F.format_string("%.2f%%", F.col("failure_ratio") * 100), F.lit(f" exceeds {max_failures:.2%}"))),
        (F.col("covered_subjects") < F.col("required_subjects"), F.format_string("course coverage %d/%d < required %d/%d", "covered_subjects", "total_subjects", "required_subjects", "total_subjects")),
    )
    failed = F.array_compact(F.array(*(F.when(bad, why) for bad, why in reasons)))
    return figures.withColumn("passed", F.size(failed) == 0).withColumn("reason", F.when(F.size(failed) > 0, F.array_join(failed, "; ")))


def required_subjects(total: int, percent: int) -> int:
    return math.ceil(total * max(1, min(100, percent)) / 100)


def latest(states: DataFrame, at: str, tie: str) -> DataFrame:
    """The row of the latest state, by time and then by the tie: a partial maximum, no sort. No states, no row."""
    one = states.agg(F.max_by(F.struct("*"), F.struct(at, tie)).alias("g"))
    return one.where("g is not null").select("g.*")


def pointed(rows: DataFrame, pointer: DataFrame, key: str) -> DataFrame:
    """Rows of what a pointer (one row with the key) names; none where it names nothing."""
    return rows.join(pointer.select(key), key, "left_semi")
