"""python -m mizan stats|coverage|refresh STORE …: the store's state, a generation's coverage, a new generation.

Exit codes: 0 done, 1 courses are missing or the gate failed, 2 no usable generation.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, load
from .functions.text import detect_court
from .operators import quality, retrieve, segment
from .sources import profiles
from .sources.store import CatalogStore, Generation


def accepted_by_course(cases: DataFrame, courses: list[retrieve.Course], limit: int) -> DataFrame:
    """(slug): a row for each candidate of each course, at most ``limit`` of a course."""
    none = cases.sparkSession.createDataFrame([], "case_number string, court_name string")
    if not courses:
        return none.select(F.lit("").alias("slug"))
    return retrieve.candidates_by_course(cases, courses, none, limit).select("slug")


def build(spark: SparkSession, store: CatalogStore, pages: DataFrame, courses: list[retrieve.Course], settings: Settings) -> tuple[bool, str]:
    """pages (doc_id, page_no, text, url, source_id, pdf_sha256) -> a generation that is promoted if it passes the gate."""
    g = store.begin(settings.parser_version)
    with store.alive(g):
        return _build(spark, store, g, pages, courses, settings)


def _build(spark: SparkSession, store: CatalogStore, g: Generation, pages: DataFrame, courses: list[retrieve.Course], settings: Settings) -> tuple[bool, str]:
    try:
        headed = segment.with_headers(pages).drop("header")
        # sizes are guessed from the pages' files, which tell little of the texts' sizes: no side of these joins is a broadcast
        facts = pages.select("doc_id", "url", "source_id", "pdf_sha256").dropDuplicates(["doc_id"]).hint("merge")
        cases = segment.admitted(segment.case_ranges(headed).join(facts, "doc_id"))
        cases = cases.select(F.col("doc_id").alias("collection_id"), "source_id", "url", "pdf_sha256", "page_start", "page_end", F.col("number").alias("case_number"), "catalog_key", "text", "normalized_text").withColumns(
            {"court_name": detect_court(F.col("text")), "indexed_at": F.current_timestamp()}
        )
        store.write_cases(g, cases)
        own = store.cases(g.generation_id)
        if own is None:
            store.finish(g, "failed", "no cases")
            return False, "no cases"
        counted = own.groupBy("collection_id").agg(F.count("*").alias("n_cases"))
        records = facts.join(counted, F.col("doc_id") == F.col("collection_id"), "left").select(F.col("doc_id").cast("string").alias("document_id"), "source_id", "url", "pdf_sha256", F.when(F.col("n_cases").isNull(), "failed").otherwise("indexed").alias("status"), F.coalesce("n_cases", F.lit(0)).alias("case_count"))
        store.write_documents(g, records)
        documents = store.documents(g.generation_id).select((F.col("status") == "failed").alias("failed"), F.col("case_count").alias("n_cases"))
        slugs = spark.createDataFrame([(c.slug,) for c in courses], "slug string")
        covered = quality.coverage(accepted_by_course(own, courses, settings.min_candidates_per_subject), slugs, settings.min_candidates_per_subject)
        r = quality.gate(quality.catalog_stats(own), covered, quality.build_counters(documents), settings.min_cases_for_activation, settings.required_subject_coverage_percent, settings.max_document_failure_ratio).first()
    except Exception as e:
        store.finish(g, "failed", str(e))
        raise
    counters = {"documents_seen": r["seen"], "documents_failed": r["failed"], "cases_indexed": r["cases"], "covered_subjects": r["covered_subjects"], "total_subjects": r["total_subjects"]}
    if not r["passed"]:
        store.finish(g, "failed", r["reason"], **counters)
        store.cleanup(settings.keep_inactive_generations)
        return False, r["reason"]
    store.promote(store.finish(g, "building", **counters))
    store.cleanup(settings.keep_inactive_generations)
    return True, ""


def coverage_code(spark: SparkSession, store: CatalogStore, courses: list[retrieve.Course], settings: Settings) -> int:
    """Say how many candidates each course has in what is read; 1 if a course has none, 2 if nothing is read."""
    if (active := store.active(settings.parser_version)) is None:
        return 2
    accepted = accepted_by_course(store.cases(active.generation_id), courses, max(5, settings.min_candidates_per_subject))
    rows = quality.coverage(accepted, spark.createDataFrame([(c.slug,) for c in courses], "slug string"), settings.min_candidates_per_subject).orderBy("slug").collect()
    for r in rows:
        print(r["status"], r["n"], r["slug"], sep="\t")
    return int(any(r["status"] == "missing" for r in rows))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mizan", description=__doc__)
    p.add_argument("command", choices=("stats", "coverage", "refresh"))
    p.add_argument("store")
    p.add_argument("--pages", help="table of page texts (refresh)")
    p.add_argument("--courses", help="YAML files of courses (coverage, refresh)")
    args = p.parse_args(argv)
    settings, spark = load(), SparkSession.builder.getOrCreate()
    store = CatalogStore(spark, args.store)
    courses = [profiles.course(r, x["slug"]) for r in [profiles.profile_records(profiles.read_yaml(spark, args.courses))] for x in r] if args.courses else []
    if args.command == "refresh":
        ok, why = build(spark, store, spark.read.parquet(args.pages), courses, settings)
        print("promoted" if ok else f"not promoted: {why}")
        return 0 if ok else 1
    active = store.active(settings.parser_version)
    if active is None:
        print("no usable generation")
        return 2
    cases = store.cases(active.generation_id)
    if args.command == "stats":
        for r in quality.catalog_stats(cases).collect():
            print(*(f"{k}={v}" for k, v in r.asDict().items()))
        return 0
    return coverage_code(spark, store, courses, settings)


if __name__ == "__main__":
    raise SystemExit(main())
