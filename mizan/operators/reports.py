"""What is written for people: the parts of a rendered comment, and the owner's reports on users, history and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import quality

# Labels of a comment's metadata, its headings by family of courses, and the lines of its sources.
METADATA = {
    "case_number": "رقم القضية", "court_name": "المحكمة", "judgment_year": "سنة القضية", "decision_number": "رقم قرار الاستئناف", "decision_date": "تاريخ القرار", "appeal_court_name": "محكمة الاستئناف",
}
PRINCIPLES, ADMINISTRATIVE = ("usul_al_fiqh",), ("administrative_law", "administrative_judiciary", "administrative_contracts")
HEADINGS = {
    "principles": (
        "أولاً: تلخيص وقائع القضية وربطها بالمفاهيم الأصولية", "ثانياً: تحديد المسألة القانونية الأصولية في الحكم وصلتها بالمقرر",
        "ثالثاً: تحليل تسبيب المحكمة في ضوء المبادئ الأصولية", "رابعاً: التعليق على الحكم وتبرير الرأي",
    ),
    "administrative": (
        "أولاً: تلخيص وقائع القضية وربطها بالمفاهيم القانونية الإدارية", "ثانياً: تحديد المسألة القانونية وصلتها بالمقرر",
        "ثالثاً: تحليل تسبيب المحكمة في ضوء المبادئ والنصوص الإدارية", "رابعاً: التعليق على الحكم وتبرير الرأي",
    ),
    "other": ("أولاً: تلخيص وقائع القضية وربطها بالمقرر", "ثانياً: تحديد المسألة القانونية وصلتها بالمقرر", "ثالثاً: تحليل تسبيب المحكمة", "رابعاً: التعليق على الحكم وتبرير الرأي"),
}
BODIES = ("facts_and_course_link", "legal_issue", "court_reasoning", "comment_and_opinion")
OFFICIAL = "المصدر الرسمي: "
NO_NUMBER, NO_COURT = "بلا رقم", "محكمة غير متوفرة"
#: Cases of the history that a report shows, and users.
HISTORY, USERS = 20, 50


def _given(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def metadata_rows(**values: Column) -> Column:
    """array<struct<label, value>> of the values that are given, in their fixed order."""
    rows = [F.when(_given(values[k]).isNotNull(), F.struct(F.lit(label).alias("label"), values[k].cast("string").alias("value"))) for k, label in METADATA.items() if k in values]
    return F.array_compact(F.array(*rows))


def headings(slug: Column) -> Column:
    """The four headings of a comment, by its course."""
    lits = lambda family: F.array(*map(F.lit, HEADINGS[family]))
    return F.when(slug.isin(*PRINCIPLES), lits("principles")).when(slug.isin(*ADMINISTRATIVE), lits("administrative")).otherwise(lits("other"))


def reference_list(references: Column, source_name: Column, source_url: Column) -> Column:
    """References trimmed, each once in their order, without empty ones; at the end the verified source, if it is not among them."""
    name, url = _given(source_name), _given(source_url)
    verified = F.when(name.isNotNull() & url.isNotNull(), F.concat(name, F.lit("، " + OFFICIAL), url)).when(url.isNotNull(), F.concat(F.lit(OFFICIAL), url)).otherwise(name)
    cleaned = F.filter(F.transform(F.coalesce(references, F.array().cast("array<string>")), strip), lambda r: r != "")
    return F.array_distinct(F.concat(cleaned, F.array_compact(F.array(verified))))


def rendered(drafts: DataFrame) -> DataFrame:
    """drafts (…, title, the four BODIES, references, subject_name, subject_slug, source_name, source_url and the columns of METADATA)
    with ``title``, ``metadata``, ``sections`` (heading, body) and ``reference_list``: what a document of a comment holds."""
    body = F.array(*(F.coalesce(F.col(b), F.lit("")) for b in BODIES))
    sections = F.zip_with(headings(F.col("subject_slug")), body, lambda h, b: F.struct(h.alias("heading"), b.alias("body")))
    rest = [c for c in drafts.columns if c not in (*BODIES, *METADATA, "references", "source_name", "source_url", "title")]
    return drafts.select(
        *rest, strip(F.col("title")).alias("title"), metadata_rows(**{k: F.col(k) for k in METADATA if k in drafts.columns}).alias("metadata"), sections.alias("sections"),
        reference_list(F.col("references"), F.col("source_name"), F.col("source_url")).alias("reference_list"),
    )


def history_report(history: DataFrame, most: int = HISTORY, tie: str = "id") -> DataFrame:
    """(pos, line): the latest cases used, the last first."""
    order = [F.col("used_at").desc_nulls_last(), F.col(tie).desc()]
    latest = history.orderBy(*order).limit(most)
    pos = F.row_number().over(Window.orderBy(*order))  # of at most ``most`` rows
    known = lambda c, other: F.coalesce(_given(F.col(c)), F.lit(other))
    line = F.concat(pos, F.lit(") "), known("case_number", NO_NUMBER), F.lit(" — "), known("court_name", NO_COURT), F.lit("\nالمادة: "), F.col("subject_slug"), F.lit(" | التقييم: "), F.coalesce(F.col("suitability_score"), F.lit(0)).cast("string"), F.lit("/100\nالتاريخ: "), F.col("used_at").cast("string"))
    return latest.select(pos.alias("pos"), line.alias("line"))


def users_report(members: DataFrame, owner: int, most: int = USERS) -> DataFrame:
    """(pos, line): the owner first, then the members by number, the owner not among them; without any a line that says so."""
    spark = members.sparkSession
    own = members.where(F.col("user_id") != owner).select("user_id").distinct().orderBy("user_id").limit(most)
    lines = own.select(F.row_number().over(Window.orderBy("user_id")).alias("pos"), F.concat(F.lit("• "), F.col("user_id").cast("string")).alias("line"))  # at most ``most`` rows
    head = spark.createDataFrame([(0, f"👑 المالك: {owner}")], "pos int, line string")
    none = spark.createDataFrame([(1, "لا يوجد مستخدمون إضافيون.")], "pos int, line string").join(lines.limit(1).select(F.lit(1).alias("pos")), "pos", "left_anti")
    return head.unionByName(lines).unionByName(none)


def catalog_report(states: DataFrame, cases: DataFrame, active_id: str | None, parser_version: int) -> DataFrame:
    """One row (readable, generation_id, cases, collections, sources, covered, newer_id, newer_status, newer_cases, newer_error): the
    generation that is read, if this parser made it and it is ready; and the latest build of this parser beside it.

    states (generation_id, parser_version, status, started_at, covered_subjects, last_error), cases (generation_id, collection_id, source_id)."""
    own = states.where((F.col("parser_version") == parser_version) & (F.col("generation_id") == F.lit(active_id)) & (F.col("status") == "ready"))
    latest = quality.latest(states.where(F.col("parser_version") == parser_version), "started_at", "generation_id").select(F.struct("generation_id", "status", "last_error").alias("g"))
    stats = cases.groupBy("generation_id").agg(F.count("*").alias("cases"), F.countDistinct("collection_id").alias("collections"), F.countDistinct("source_id").alias("sources"))
    read = own.agg(F.max("generation_id").alias("generation_id"), F.max("covered_subjects").alias("covered"))  # a row, of nulls if none is read
    both = read.join(latest, F.lit(True), "left")  # a row each
    active = stats.select(F.col("generation_id").alias("__a"), "cases", "collections", "sources")
    newer = stats.select(F.col("generation_id").alias("__n"), F.col("cases").alias("newer_cases"))
    told = both.join(active, F.col("generation_id") == F.col("__a"), "left").join(newer, F.col("g.generation_id") == F.col("__n"), "left")
    other = F.col("g.generation_id").isNotNull() & ~F.col("g.generation_id").eqNullSafe(F.col("generation_id"))
    return told.select(
        F.col("generation_id").isNotNull().alias("readable"), "generation_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cases", "collections", "sources")), "covered",
        F.when(other, F.col("g.generation_id")).alias("newer_id"), F.when(other, F.col("g.status")).alias("newer_status"), F.when(other, F.coalesce("newer_cases", F.lit(0))).alias("newer_cases"), F.when(other, F.col("g.last_error")).alias("newer_error"),
    )
