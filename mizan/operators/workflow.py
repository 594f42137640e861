"""Steps around retrieval and verification: page merges, fingerprints, metadata, prompts, usage windows, sessions, records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import judgment_metadata, normalize_case_number, primary_header
from ..functions.text import strip
from .identity import insertable

METADATA = ("case_number", "court_name", "judgment_year", "decision_number", "decision_date", "appeal_court_name")
MIN_TEXT, PROMPT_EXCLUSIONS, NOTHING = 500, 30, "- لا يوجد"
# Failure codes and what the user is told, by stage.
FAILURES = {
    "commentary_timeout": "⏳ توقف بث كتابة التعليق مدة أطول من الحد الآمن. لم تُفقد القضية ويمكن إعادة المحاولة عليها مباشرة.",
    "commentary_stream": "🧩 انتهى بث كتابة التعليق قبل وصول نتيجة مكتملة. القضية الموثقة محفوظة ويمكن إعادة المحاولة دون بحث جديد.",
    "commentary_validation": "🛡️ المسودة لم تجتز التحقق القانوني النهائي حتى بعد محاولة التصحيح، ولذلك لم يرسل النظام ملفاً غير موثوق.",
    "commentary_output": "🧾 لم تصل مخرجات التعليق بالصيغة المنظمة المطلوبة. القضية محفوظة ويمكن إعادة المحاولة دون إعادة البحث.",
    "artifact_missing": "📁 ملف الحكم الموثق لم يعد موجوداً وقت الإرسال؛ لم تُسجل القضية كمستخدمة.",
}
OTHER_FAILURE = "❌ تعذر إكمال إنشاء أو إرسال الملفات حالياً. القضية الموثقة ما زالت محفوظة لإعادة المحاولة."


def merge_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) of two engines by place; either may have fewer pages."""
    left, right = (x.select("doc_id", "page_no", F.col("text").alias(n)) for x, n in ((a, "text_a"), (b, "text_b")))
    return left.join(right, ["doc_id", "page_no"], "full_outer")


def extractable(documents: DataFrame, least: int = MIN_TEXT) -> DataFrame:
    """Documents (…, text) with enough text to work on."""
    return documents.where(F.length(strip(F.coalesce("text", F.lit("")))) >= least)


def page_links(candidates: DataFrame) -> DataFrame:
    """candidates (pdf_page_start, pdf_page_end, final_score, estimated_score, mode) with has_page_range, is_auto and the score
    that counts."""
    both = F.col("pdf_page_start").isNotNull() & F.col("pdf_page_end").isNotNull()
    return candidates.withColumns({"has_page_range": both, "is_auto": F.coalesce(F.col("mode") == "auto", F.lit(False)), "score": F.coalesce("final_score", "estimated_score")})


def range_faults(candidates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """candidates (url, catalog_pdf_sha256, pdf_page_end) against artifacts (url, sha256, page_count): stale or out-of-range
    ones with ``fault``; null where the stored range still holds."""
    now = artifacts.select("url", F.col("sha256").alias("__sha"), F.col("page_count").alias("__pages"))
    fault = F.when(F.col("__sha").isNull(), "not fetched").when(F.lower("__sha") != F.lower("catalog_pdf_sha256"), "fingerprint changed").when(F.col("pdf_page_end") > F.col("__pages"), "range exceeds file")
    return candidates.join(now, "url", "left").withColumn("fault", fault).drop("__sha", "__pages")


def validate_extracts(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text, expected) of extracts -> (doc_id, fault, number, sha256): an extract begins with the header of
    the expected case and has no other one's header on a later page. sha256 is of its pages' texts, as they were read again."""
    read = pages.withColumn("number", primary_header("text")["case_number"]).withColumn("wanted", normalize_case_number("expected"))
    own = F.array_sort(F.collect_list(F.struct("page_no", "number", "text")))
    facts = read.groupBy("doc_id").agg(F.min_by("number", "page_no").alias("number"), F.max("wanted").alias("wanted"), own.alias("pages"))
    other = F.get(F.filter("pages", lambda h: h["number"] != F.col("number")), F.lit(0))["page_no"]
    fault = F.when(F.col("number").isNull(), "no header first").when(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("number")), "starts with another case")
    digest = F.sha2(F.array_join(F.transform("pages", lambda h: F.coalesce(h["text"], F.lit(""))), "\f"), 256)
    return facts.select("doc_id", fault.when(other.isNotNull(), F.concat(F.lit("another case on page "), other.cast("string"))).alias("fault"), "number", digest.alias("sha256"))


def document_metadata(pages: DataFrame, header_required: bool) -> DataFrame:
    """(doc_id, metadata): from the first page if a header is required, else from the first two."""
    used = pages.where(F.col("page_no") <= (1 if header_required else 2))
    texts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = used.groupBy("doc_id").agg(F.array_join(F.transform(texts, lambda p: p["text"]), "\n").alias("text"))
    out = joined.withColumn("header", primary_header("text")["case_number"]).withColumn("metadata", judgment_metadata("text"))
    return (out.where("header is not null") if header_required else out).select("doc_id", "metadata")


def verified_over_candidate(candidates: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Candidate fields replaced by verified ones where those are not empty."""
    known = candidates.schema[metadata].dataType.names
    return candidates.withColumns({c: F.coalesce(F.nullif(F.col(f"{metadata}.{c}"), F.lit("")), F.col(c)) for c in METADATA if c in known and c in candidates.columns})


def usage_window(history: DataFrame, limit: int, cap: int, slug: str | None = None) -> DataFrame:
    """The latest uses, of one course or of all: at least one row, at most the cap."""
    own = history if slug is None else history.where(F.col("subject_slug") == slug)
    return own.orderBy(F.col("used_at").desc(), "pdf_sha256").limit(max(1, min(limit, cap)))


def page_of(df: DataFrame, order: list[str], page: int, size: int = 8) -> DataFrame:
    """One page of a list; pages beyond the ends are the first and the last."""
    last = max(0, (df.count() - 1) // size)
    return df.orderBy(*order).offset(size * max(0, min(page, last))).limit(size)


def bullets(items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(NOTHING))


def exclusion_lines(excluded: Column) -> Column:
    """Lines of the first excluded cases: array<struct<case_number, court_name, source_url>>."""
    known = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    line = lambda x: F.concat(F.lit("- رقم القضية: "), known(x["case_number"], "غير متوفر"), F.lit(" | المحكمة: "), known(x["court_name"], "غير متوفرة"), F.lit(" | الرابط: "), known(x["source_url"], "غير متوفر"))
    some = F.array_join(F.transform(F.slice(excluded, 1, PROMPT_EXCLUSIONS), line), "\n")
    return F.when(F.size(excluded) > 0, some).otherwise(F.lit("لا توجد قضايا مستبعدة حتى الآن."))


def research_prompt(requests: DataFrame, heading: str = "") -> DataFrame:
    """requests (slug, name, topics, keywords, avoid, excluded, and if they have them suitable and focus) with ``prompt``: its parts,
    each under its title."""
    part = lambda title, body: F.concat(F.lit(f"{title}:\n"), body)
    more = lambda c, title: [part(title, bullets(F.col(c)))] if c in requests.columns else []
    parts = (
        F.lit(heading) if heading else F.lit(None).cast("string"), part("المادة", F.col("name")), part("الموضوعات", bullets(F.col("topics"))),
        *more("suitable", "أنماط القضايا المناسبة"), part("كلمات البحث", bullets(F.col("keywords"))), part("ما يُتجنب", bullets(F.col("avoid"))), *more("focus", "محاور التعليق"),
        part("قضايا مستبعدة", exclusion_lines(F.col("excluded"))),
    )
    return requests.withColumn("prompt", F.concat_ws("\n\n", *parts))


def failure_message(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.lit(OTHER_FAILURE))


def progress_text(phase: Column, elapsed: Column, interval: float = 3.0) -> Column:
    """What a user sees while a stage runs: the stage, the seconds so far, and how often this is told."""
    said = f"🔄 يتم تحديث الحالة كل {max(1, round(interval))} ثوانٍ"
    return F.concat(phase, F.lit("\n\n⏱️ الوقت المنقضي: "), F.greatest(F.lit(0), elapsed).cast("string"), F.lit(" ثانية\n" + said))


def others(tokens: Column, chosen: Column) -> Column:
    """Tokens that a choice releases."""
    return F.array_except(tokens, F.array(chosen))


def record_sent(sent: DataFrame, history: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new history rows, audit rows, tokens to release) after delivery; sending twice records once."""
    new = insertable(sent, history, order)
    audit = new.select(F.lit("case_sent").alias("event_type"), "subject_slug", "case_number", F.concat(F.lit("sha="), "pdf_sha256").alias("details"))
    return new, audit, sent.select("token").distinct()


def append_audit(audit: DataFrame, path: str) -> None:
    """Audit rows go to the end of their table, with the time."""
    audit.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def select_token(sessions: DataFrame, choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sessions (user_id, token, expires_at), choice (user_id, token, at): (the chosen sessions that had not run out, tokens of the
    users' other sessions, which are released)."""
    own = choice.select("user_id", F.col("token").alias("__chosen"), "at")
    both = sessions.join(own, "user_id")
    chosen = both.where((F.col("token") == F.col("__chosen")) & (F.col("expires_at") > F.col("at"))).select(*sessions.columns)
    return chosen, both.where(F.col("token") != F.col("__chosen")).select("user_id", "token")


def rounds(search: Callable[[DataFrame, int], DataFrame], excluded: DataFrame, wanted: int, most: int) -> DataFrame:
    """Candidates of search(excluded, round) (key, verified), round after round, each without what was tried before, until enough
    are verified. excluded: (key). Each round's result is one answer of a search: a few rows."""
    found = None
    for i in range(most):
        own = search(excluded, i).checkpoint()
        found = own if found is None else found.union(own)
        excluded = excluded.union(own.select("key"))
        if found.where("verified").count() >= wanted:
            break
    return found


def users_page(users: DataFrame, page: int, size: int = 8, most: int = 100) -> DataFrame:
    """One page of the first users by the time they joined."""
    return page_of(users.orderBy("created_at", "user_id").limit(most), ["created_at", "user_id"], page, size)


def not_yet(verified: DataFrame, wanted: int, group: str = "slug") -> DataFrame:
    """Courses that still lack verified cases after a round, with how many; a next round excludes what was tried."""
    return verified.groupBy(group).agg(F.count_if("verified").alias("n")).where(F.col("n") < wanted).select(group, (F.lit(wanted) - F.col("n")).alias("lacking"))
