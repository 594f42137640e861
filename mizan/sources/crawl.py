"""Bounded crawl over a table of fetched pages: breadth first, a join for each depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import joined, links, part, path_allowed, unescaped
from ..shared import allow_checkpoints
from .profiles import Source, classify, series


# Kinds of sources.
KINDS = ("numbered_pdf_series", "landing_page_crawl")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): absolute link targets, each once for a page."""
    found = pages.select(F.col(url).alias("url"), F.explode(links(unescaped(F.col(html)))).alias("link"))
    return found.select("url", joined("url", "link").alias("link")).where("link is not null").distinct()


def _allowed(url, prefixes: tuple[str, ...], excluded: tuple[str, ...]):
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return path_allowed(url, texts(prefixes), texts(excluded))


def crawl(pages: DataFrame, domains: DataFrame, source: Source) -> DataFrame:
    """pages (url, html) -> (document_id, url) of the source's documents that its landing pages lead to.

    Pages and documents have their own allow-lists; only https addresses of the source count. max_depth bounds how far,
    max_pages how many pages are read: the shallowest, by address within a depth. Landing pages are named, or rows (url).
    """
    spark = pages.sparkSession
    allow_checkpoints(spark)
    every = page_links(pages).checkpoint()  # pages are read once, whatever the depth
    landing = source.landing_pages
    frontier = landing.select("url").distinct() if isinstance(landing, DataFrame) else spark.createDataFrame([(u,) for u in landing], "url string").distinct()
    seen, documents, n_read = None, None, 0
    for _ in range(source.max_depth + 1):
        own = classify(frontier, domains).where((F.col("source_id") == source.source_id) & part(F.col("url"), "SCHEME").eqNullSafe(F.lit("https")))
        is_pdf = F.lower(part(F.col("url"), "PATH")).endswith(".pdf")
        found = own.where(is_pdf & F.col("original_pdf") & _allowed(F.col("url"), source.document_prefixes, source.excluded)).select("url").checkpoint()
        documents = found if documents is None else documents.union(found)
        room = source.max_pages - n_read
        page = own.where(~is_pdf & _allowed(F.col("url"), source.page_prefixes, source.excluded)).select("url").distinct()
        if seen is not None:
            page = page.join(seen, "url", "left_anti")
        page = page.checkpoint()
        n = page.count()
        if n > room:
            page, n = page.orderBy("url").limit(max(0, room)).checkpoint(), max(0, room)
        if not n:
            break
        n_read += n
        seen = page if seen is None else seen.union(page)
        frontier = every.join(page, "url", "left_semi").select(F.col("link").alias("url")).distinct()
    last = classify(frontier, domains).where((F.col("source_id") == source.source_id) & F.col("original_pdf") & F.lower(part(F.col("url"), "PATH")).endswith(".pdf"))
    documents = documents.union(last.where(_allowed(F.col("url"), source.document_prefixes, source.excluded)).select("url")).distinct()
    return documents.select(F.concat(F.lit(f"{source.id}:crawl:"), F.substring(F.sha2("url", 256), 1, 16)).alias("document_id"), "url")


def documents(pages: DataFrame, domains: DataFrame, sources: list[Source]) -> DataFrame:
    """(document_id, url) of all enabled sources, each by its kind: the numbers of its series, or what its landing pages lead to.
    Another kind: ValueError."""
    spark = pages.sparkSession
    enabled = [s for s in sources if s.enabled]
    if unknown := [s.kind for s in enabled if s.kind not in KINDS]:
        raise ValueError(f"unknown kind of source: {unknown[0]}")
    numbered = [(s.id, s.url_template, s.first, s.last) for s in enabled if s.kind == "numbered_pdf_series"]
    out = series(spark.createDataFrame(numbered, "id string, url_template string, first int, last int"))
    for s in enabled:
        if s.kind == "landing_page_crawl":
            out = out.union(crawl(pages, domains, s))
    return out
