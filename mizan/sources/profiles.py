"""Configuration as YAML: courses, source registry, course-to-source map, manifest, scoring policy.

Files are small and read on the driver, through Spark's file system so that they may lie in any store it reads; each gives
plain records and, where queries join it, a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import https_allowed, part
from ..operators.retrieve import WEIGHTS, Course

MODES = ("direct", "methodological")
LISTS = ("priority_topics", "secondary_topics", "suitable_case_patterns", "avoid_case_patterns", "search_keywords", "commentary_focus")


def read_yaml(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """(file path, content) of the files that path matches, by name."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
    return sorted((r["f"], yaml.safe_load(r["value"]) or {}) for r in rows)


def profile_records(files: list[tuple[str, dict]]) -> list[dict]:
    """Validated course records. A mode that is none, a slug that is not the file's name, a slug twice: ValueError."""
    seen: dict[str, dict] = {}
    for path, data in files:
        slug = str(data.get("slug") or "")
        stem = path.rpartition("/")[2].rpartition(".")[0]
        mode = str(data.get("relevance_mode") or "direct")
        if mode not in MODES:
            raise ValueError(f"{stem}: unknown relevance mode {mode}")
        if slug != stem:
            raise ValueError(f"{stem}: its slug is {slug}")
        if slug in seen:
            raise ValueError(f"{slug} appears twice")
        seen[slug] = {k: str(data.get(k) or "") for k in ("slug", "name_ar", "verification_status", "source_notes")} | {"relevance_mode": mode} | {k: [str(x) for x in data.get(k) or []] for k in LISTS}
    return list(seen.values())


def profiles(spark: SparkSession, path: str) -> DataFrame:
    schema = "slug string, name_ar string, verification_status string, source_notes string, relevance_mode string, " + ", ".join(f"{k} array<string>" for k in LISTS)
    return spark.createDataFrame(profile_records(read_yaml(spark, path)), schema)


def course(records: list[dict], slug: str, preferred: dict[str, tuple[str, ...]] | None = None) -> Course:
    """The course of a slug; KeyError if there is none."""
    r = {x["slug"]: x for x in records}[slug]
    return Course(slug, r["relevance_mode"], tuple(r["search_keywords"]), tuple(r["priority_topics"]), tuple(r["secondary_topics"]), tuple(r["avoid_case_patterns"]), (preferred or {}).get(slug, ()))


def source_map(data: dict) -> dict[str, tuple[str, ...]]:
    return {str(slug): tuple(map(str, ids or ())) for slug, ids in (data.get("subjects") or {}).items()}


def registry(spark: SparkSession, data: dict) -> DataFrame:
    """(domain, source_id, role, tier, direct_pdf): a row for each domain, in lower case."""
    rows = {str(d).lower(): (str(d).lower(), str(s.get("id")), str(s.get("role", "unknown")), s.get("tier"), bool(s.get("supports_direct_pdf", False))) for s in data.get("sources") or [] for d in s.get("domains") or []}
    return spark.createDataFrame(list(rows.values()), "domain string, source_id string, role string, tier int, direct_pdf boolean")


def classify(urls: DataFrame, domains: DataFrame, url: str = "url", require_https: bool = True) -> DataFrame:
    """urls with domain, source_id, role, tier, is_official, is_discovery_only and original_pdf. Unknown domains: discovery only."""
    host = F.coalesce(part(F.col(url), "HOST"), F.lit(""))
    known = domains.select(F.col("domain").alias("__domain"), "source_id", "role", "tier", "direct_pdf")
    out = urls.withColumn("domain", host).join(known, F.col("domain") == F.col("__domain"), "left").withColumn("role", F.coalesce("role", F.lit("unknown")))
    official = F.col("role") == "official"
    original: Column = https_allowed(F.col(url), require_https) & official & F.coalesce("direct_pdf", F.lit(False))
    return out.withColumn("is_official", official).withColumn("is_discovery_only", ~official).withColumn("original_pdf", original).drop("__domain", "direct_pdf")


@dataclass(frozen=True)
class Source:
    id: str
    source_id: str
    source_name: str
    kind: str
    enabled: bool = True
    url_template: str | None = None
    first: int | None = None
    last: int | None = None
    landing_pages: tuple[str, ...] | DataFrame = ()
    max_depth: int = 1
    max_pages: int = 100
    page_prefixes: tuple[str, ...] = ()
    document_prefixes: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def manifest(data: dict) -> tuple[list[Source], dict[str, float]]:
    """Sources and limits, limits kept within sense."""
    out = []
    for s in data.get("sources") or []:
        every = tuple(s.get("allowed_path_prefixes") or ())
        volumes = s.get("volumes") or {}
        out.append(Source(
            str(s["id"]), str(s["source_id"]), str(s.get("source_name") or s["source_id"]), str(s["kind"]), bool(s.get("enabled", True)), s.get("url_template"), volumes.get("start"), volumes.get("end"),
            tuple(s.get("landing_pages") or ()), max(0, int(s.get("max_depth", 1))), max(1, int(s.get("max_pages", 100))),
            tuple(s.get("page_path_prefixes") or every), tuple(s.get("document_path_prefixes") or every), tuple(s.get("exclude_path_fragments") or ()),
        ))
    limits = {
        "min_case_text_chars": max(100, int(data.get("min_case_text_chars", 350))),
        "max_case_text_chars": max(1000, int(data.get("max_case_text_chars", 18000))),
        "request_delay_seconds": max(0.0, float(data.get("request_delay_seconds", 0.35))),
    }
    return out, limits


def series(sources: DataFrame) -> DataFrame:
    """sources (id, url_template, first, last) -> (document_id, url): a document for each number of the range."""
    numbered = sources.where("url_template is not null and first is not null and last is not null and first <= last")
    n = numbered.withColumn("n", F.explode(F.sequence("first", "last")))
    return n.select(F.concat_ws("", "id", F.lit(":v"), "n").alias("document_id"), F.replace("url_template", F.lit("{volume}"), F.col("n").cast("string")).alias("url"))


def scoring(data: dict) -> tuple[dict[str, int], int, bool]:
    """(weights, least margin, margin required)."""
    own, select = data.get("weights") or {}, data.get("selection") or {}
    return {k: int(own.get(k, v)) for k, v in WEIGHTS.items()}, int(select.get("min_auto_accept_margin", 5)), bool(select.get("require_score_margin_for_auto_accept", True))
