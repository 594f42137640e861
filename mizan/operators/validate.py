"""Validators of generated text and structured answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headers import labelled_numbers, normalize_case_number
from ..functions.text import article_numbers, normalize_metadata, per_row, strip

# What no finished text may say.
FORBIDDEN = ("##", "**", "```", "ChatGPT", "DeepSeek", "ذكاء اصطناعي", "Artificial Intelligence", "Telegram", "البوت", "كمساعد", "تم إنشاء", "بناء على طلب المستخدم")
SECTIONS = ("title", "facts_and_course_link", "legal_issue", "court_reasoning", "comment_and_opinion")
CANDIDATE = "title string, case_number string, court_name string, source_name string, source_url string, pdf_url string, pdf_page_start int, pdf_page_end int, catalog_key string, catalog_pdf_sha256 string, catalog_range_verified boolean, legal_issue string, suitability_reason string, estimated_score int, subject_relevance int, legal_issue_clarity int, reasoning_quality int, academic_commentary_value int"


def forbidden_markers(text: Column) -> Column:
    """Markers that stand in a text, in the order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(m.lower())), F.lit(m)) for m in FORBIDDEN)))


def has_markdown(text: Column) -> Column:
    marks = F.contains(text, F.lit("#")) | F.contains(text, F.lit("```")) | F.contains(text, F.lit("**"))
    return marks | (F.contains(text, F.lit("*")) & F.regexp_like(text, F.lit(r"(?U)(^|\s)\*(?=\S)")))


def mentions_ai(text: Column) -> Column:
    """The word AI in any case, by the letters first: looking for a word's begin at each character costs more than all else."""
    return F.regexp_like(text, F.lit(r"(?U)[Aa][Ii\u0130\u0131]\b(?<=\b..)"))


def violations(drafts: DataFrame) -> DataFrame:
    """drafts (SECTIONS, references, judgment_text, expected_case_number) with ``violations`` in the order of the checks."""
    joined = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in SECTIONS), "references")
    read = drafts.withColumn("__all", joined).withColumn("__expected", normalize_case_number("expected_case_number")).withColumn("__labels", labelled_numbers(joined))
    t = F.col("__all")
    empty = F.exists(F.array(*(F.coalesce(strip(F.col(c)), F.lit("")) for c in SECTIONS)), lambda x: x == "")
    foreign = F.filter("__labels", lambda x: ~x.eqNullSafe(F.col("__expected")))
    lacking = F.array_sort(F.array_except(article_numbers(t), article_numbers(F.col("judgment_text"))))
    checks = (
        F.when(empty, F.lit("empty section")),
        F.when(F.size(forbidden_markers(t)) > 0, F.concat(F.lit("forbidden: "), F.get(forbidden_markers(t), F.lit(0)))),
        F.when(has_markdown(t), F.lit("markdown")),
        F.when(mentions_ai(t), F.lit("ai reference")),
        F.when(F.col("expected_case_number").isNotNull() & (F.size(foreign) > 0), F.concat(F.lit("foreign case: "), F.array_join(foreign, ", "))),
        F.when(F.col("judgment_text").isNotNull() & (F.size(lacking) > 0), F.concat(F.lit("unsupported articles: "), F.array_join(lacking, ", "))),
    )
    return read.withColumn("violations", F.array_compact(F.array(*checks))).drop("__all", "__expected", "__labels")


def missing_metadata(text: Column, expected: Column) -> Column:
    """Labels of a map whose values do not stand in the text; null and empty values are not looked for."""
    plain = normalize_metadata(text)
    lost = F.filter(F.map_entries(expected), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~F.contains(plain, normalize_metadata(e["value"])))
    return F.transform(lost, lambda e: e["key"])


def candidate_faults(c: Column) -> Column:
    """Fields of a candidate struct against the constraints: names of the faulty ones."""
    f = lambda name: c[name]
    length = lambda name, low, high: ~F.coalesce(F.length(f(name)).between(low, high), F.lit(False))
    bounded = lambda name, high: f(name).isNotNull() & ~f(name).between(0, high)
    pages = f("pdf_page_start").isNotNull() & f("pdf_page_end").isNotNull()
    url = lambda name: f(name).rlike(r"^https?://[^/\s]+")
    checks = {
        "title": length("title", 3, 500), "source_name": length("source_name", 2, 200), "source_url": ~F.coalesce(url("source_url"), F.lit(False)),
        "pdf_url": f("pdf_url").isNotNull() & ~url("pdf_url"), "legal_issue": length("legal_issue", 3, 2000), "suitability_reason": length("suitability_reason", 3, 3000),
        "estimated_score": ~F.coalesce(f("estimated_score").between(0, 100), F.lit(False)), "subject_relevance": bounded("subject_relevance", 40), "legal_issue_clarity": bounded("legal_issue_clarity", 20),
        "reasoning_quality": bounded("reasoning_quality", 15), "academic_commentary_value": bounded("academic_commentary_value", 15),
        "catalog_pdf_sha256": f("catalog_pdf_sha256").isNotNull() & (F.length(f("catalog_pdf_sha256")) != 64),
        "pages": (f("pdf_page_start").isNull() != f("pdf_page_end").isNull()) | F.coalesce((f("pdf_page_start") < 1) | (f("pdf_page_end") < f("pdf_page_start")), F.lit(False)),
        "provenance": F.coalesce(f("catalog_range_verified"), F.lit(False)) & ~(F.coalesce(f("catalog_key") != "", F.lit(False)) & f("catalog_pdf_sha256").isNotNull() & pages),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))


def complete_objects(text: str) -> Iterator[dict]:
    """Objects at the top of the array under "candidates" that are whole, also where the text breaks off later."""
    at = text.find('"candidates"')
    at = text.find("[", at + len('"candidates"')) if at >= 0 else -1
    reader = json.JSONDecoder()
    while at >= 0:
        at += 1
        while at < len(text) and text[at] not in '{]"':
            at += 1
        if at >= len(text) or text[at] == "]":
            return
        try:
            value, end = reader.raw_decode(text, at)
        except ValueError:
            # no whole value begins here: go on behind the next balanced object, if there is one
            end = _balanced(text, at)
            if end < 0:
                return
            value = None
        if isinstance(value, dict):
            yield value
        at = end - 1


def _balanced(text: str, at: int) -> int:
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        i += 1
    return -1


salvaged = per_row(T.ArrayType(T.StringType()))(lambda text: [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in complete_objects(text)])


def parse_candidates(answers: DataFrame, limit: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, salvaged, pos, c): valid candidates of each answer, the first ``limit``; broken answers give their whole objects.

    Only broken answers pass through the vectorized reader; a row's items are checked where they are, without a shuffle.
    """
    answer = F.col(text_col)
    whole = F.try_parse_json(answer)
    listed = F.from_json(F.to_json(F.try_variant_get(whole, "$.candidates", "variant")), "array<string>")
    none = F.array().cast("array<string>")
    read = answers.select(F.col(id_col).alias("id"), whole.isNull().alias("salvaged"), F.coalesce(listed, none).alias("listed"), salvaged(F.when(whole.isNull(), answer)).alias("whole_objects"))
    items = F.when(F.col("salvaged"), F.coalesce("whole_objects", none)).otherwise(F.col("listed"))
    objects = F.transform(items, lambda x, i: F.struct(i.alias("pos"), F.when(x.startswith("{"), F.from_json(x, CANDIDATE)).alias("c")))
    valid = F.filter(objects, lambda o: o["c"].isNotNull() & (F.size(candidate_faults(o["c"])) == 0))
    return read.select("id", "salvaged", F.inline(F.slice(valid, 1, limit)))


def output_text(response: Column) -> Column:
    """Text of a response (JSON): given directly, or the joined text parts of its messages; null if none."""
    kind = "output_text string, output array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    r = F.from_json(response, kind)
    parts = F.flatten(F.transform(F.filter(r["output"], lambda m: m["type"] == "message"), lambda m: F.coalesce(m["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    said = F.transform(F.filter(parts, lambda p: p["type"].isin("output_text", "text") & (F.trim(p["text"]) != "")), lambda p: p["text"])
    direct = F.when(F.trim(r["output_text"]) != "", r["output_text"])
    return F.coalesce(direct, F.nullif(F.array_join(said, ""), F.lit("")))


def web_calls(response: Column) -> Column:
    """array<variant> of a response's (JSON) calls of the web search, whole and in their order."""
    items = F.try_variant_get(F.try_parse_json(response), "$.output", "array<variant>")
    return F.coalesce(F.filter(items, lambda x: F.try_variant_get(x, "$.type", "string") == "web_search_call"), F.array().cast("array<variant>"))


def empty_response(response: Column) -> Column:
    """Why a response (JSON) has no text: its status, the types of its output, the reason it is incomplete, and its error; null
    where it has text."""
    v = F.try_parse_json(response)
    of = lambda path, other: F.coalesce(F.nullif(F.try_variant_get(v, path, "string"), F.lit("")), F.lit(other))
    items = F.filter(F.coalesce(F.try_variant_get(v, "$.output", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    kinds = F.transform(items, lambda x: F.concat(F.lit("'"), F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("None")), F.lit("'")))
    listed = F.concat(F.lit("["), F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise(F.lit("'none'")), F.lit("]"))
    told = F.concat(
        F.lit("The response did not contain output text (status="), of("$.status", "unknown"), F.lit(", output_types="), listed, F.lit(", incomplete_reason="), of("$.incomplete_details.reason", "none"),
        F.lit(", error="), of("$.error.code", "none"), F.lit(")"),
    )
    return F.when(output_text(response).isNull(), told)
