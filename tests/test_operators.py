import json
import random

import pytest
from pyspark.sql import functions as F

from mizan.operators import identity, quality, retrieve, segment, validate
from mizan.operators.retrieve import Course

from .test_functions import LEGACY, MODERN

PAGES = "doc_id string, page_no int, text string, number string"


def starts_of(pages):
    out, before = [], None
    for i, (t, n) in enumerate(pages, 1):
        if len(t) >= 100 and n is not None and n != before:
            out.append(i)
            before = n
    return out


def ranges_of(pages):
    starts, out = starts_of(pages), []
    for k, s in enumerate(starts):
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(pages)
        while end > s and len(pages[end - 1][0].strip()) < 120:
            end -= 1
        out.append((s, end, pages[s - 1][1], "\n".join(p[0] for p in pages[s - 1 : end])))
    return out


def test_segmentation_against_loop(spark):
    rnd = random.Random(7)
    docs = {f"d{i}": [(rnd.choice(["x" * 50, "y" * 110, "z" * 200, " " * 130]), rnd.choice([None, "a", "b", "c"])) for _ in range(rnd.randint(1, 12))] for i in range(60)}
    pages = spark.createDataFrame([(d, i, *p) for d, own in docs.items() for i, p in enumerate(own, 1)], PAGES).repartition(5)
    got = {}
    for r in segment.case_starts(pages).orderBy("doc_id", "page_no").collect():
        got.setdefault(r["doc_id"], []).append(r["page_no"])
    assert got == {d: s for d, own in docs.items() if (s := starts_of(own))}
    ranges = {(r["doc_id"], r["page_start"], r["page_end"], r["number"], r["text"]) for r in segment.case_ranges(pages).collect()}
    assert ranges == {(d, *x) for d, own in docs.items() for x in ranges_of(own)}


def test_refine_never_ends_before_start(spark):
    """With the chosen header behind the hint and no later one, the range is that page, not an inverted one."""
    long = "المدعي " * 60
    pages = spark.createDataFrame([("d", i, long, "77" if i == 8 else None) for i in range(1, 12)], PAGES)
    hints = spark.createDataFrame([("d", 3, 5, None), ("d", 7, 11, "77"), ("d", 40, 41, None)], "doc_id string, hint_start int, hint_end int, expected string")
    got = {(r["hint_start"], r["page_start"], r["page_end"], r["number"]) for r in segment.refine_ranges(hints, pages).collect()}
    assert got == {(3, 8, 8, "77"), (7, 8, 11, "77")}


def test_refine_falls_back_when_expected_is_absent(spark):
    long = "المدعي " * 60
    pages = spark.createDataFrame([("d", i, long, {5: "34181612", 9: "99"}.get(i)) for i in range(1, 12)], PAGES)
    hints = spark.createDataFrame([("d", 1, 39, "436")], "doc_id string, hint_start int, hint_end int, expected string")
    r = segment.refine_ranges(hints, pages).first()
    assert (r["page_start"], r["page_end"], r["number"]) == (5, 8, "34181612")


def test_locate_and_decorative_tail(spark):
    long, short = "المدعي " * 60, "صفحة"
    pages = spark.createDataFrame([("d", 1, long, None), ("d", 2, long, "7"), ("d", 3, long, None), ("d", 4, short, None), ("d", 5, long, "8")], PAGES)
    wanted = spark.createDataFrame([("d", "7"), ("d", "9")], "doc_id string, expected string")
    assert [(r["expected"], r["page_start"], r["page_end"]) for r in segment.locate(wanted, pages).collect()] == [("7", 2, 3)]


def test_verify_single_case(spark):
    rows = [("one", 1, LEGACY, "1990/1434"), ("two", 1, LEGACY, "1990/1434"), ("two", 2, MODERN, "1990/1434"), ("tail", 1, "x", "1990/1434"), ("tail", 2, LEGACY, "1990/1434"), ("tokens", 1, "see 12345 there", "12345"), ("none", 1, "nothing", "12345")]
    got = {r["doc_id"]: r["verified"] for r in segment.verify_single_case(spark.createDataFrame(rows, "doc_id string, page_no int, text string, expected string")).collect()}
    assert got == {"one": True, "two": False, "tail": False, "tokens": True, "none": False}


def test_best_page_and_bounds(spark):
    rows = [("d", 1, 0, "�� garbled " * 20), ("d", 1, 1, "رقم القضية 1234 المحكمة الصك"), ("d", 2, 0, "same"), ("d", 2, 1, "same"), ("d", 3, 1, "only"), ("d", 4, 0, None)]
    got = {r["page_no"]: (r["engine_rank"], r["text"]) for r in segment.best_pages(spark.createDataFrame(rows, "doc_id string, page_no int, engine_rank int, text string")).collect()}
    assert got[1][0] == 1 and got[2] == (0, "same") and got[3] == (1, "only") and got[4][1] == ""
    pages = spark.createDataFrame([("d", 1, "abcd", None), ("d", 2, " ", None), ("d", 3, "efgh", None), ("d", 4, "zz", None)], PAGES)
    assert segment.bounded_text(pages, 6).first()["text"] == "abcd\n\nef"
    with pytest.raises(ValueError):
        segment.page_range(pages, 3, 2)
    assert segment.page_range(pages, 2, 4).count() == 3 and segment.page_range(pages, 2, 5).count() == 0


def test_relevance_modes(spark):
    private = Course("constitutional", keywords=("حقوق دستورية",), priority=("رقابة دستورية",), avoid=("نزاع خاص",))
    rows = spark.createDataFrame([(1, "دعوى في الحقوق الدستورية"), (2, "نزاع بين شخصين على عقار"), (3, "حقوق دستورية ونزاع خاص")], "id int, text string")
    got = {r["id"]: (r["score"], r["accepted"]) for r in retrieve.assess(rows, [private]).collect()}
    assert got[2] == (8, False) and got[3] == (11, False)
    method = Course("research", "methodological")
    body = "الوقائع أقام دعواه المدعي. الأسباب حيث ثبت. حكمت المحكمة. رقم القضية 12 " + "نص " * 600
    got = [(r["score"], r["accepted"]) for r in retrieve.assess(spark.createDataFrame([(1, body), (2, "حكمت")], "id int, text string"), [method]).orderBy("id").collect()]
    assert got[0][0] >= 24 and got[0][1] is True and got[1][1] is False


def test_subject_terms():
    c = Course("c", keywords=("عمل تجاري", "تاجر"), priority=("عمل تجارى",), secondary=("محل",))
    assert retrieve.subject_terms(c) == ["عمل تجاري", "تاجر", "محل", "تجاري"]
    assert retrieve.subject_terms(Course("m", "methodological")) == list(retrieve.METHOD_TERMS)


def test_search_prelimit_is_explicit(spark):
    """A better but older row is lost only by an explicit cap."""
    rows = [(f"k{i}", "s", None, None, i, "alpha") for i in range(50)] + [("best", "s", "1", "c", -1, "alpha beta")]
    cases = spark.createDataFrame(rows, "catalog_key string, source_id string, case_number string, court_name string, indexed_at int, normalized_text string")
    assert retrieve.search(cases, ["alpha", "beta"], limit=1).first()["catalog_key"] in {"best", "k49"}
    assert retrieve.search(cases, ["alpha", "beta"], limit=4).first()["catalog_key"] == "best"
    assert retrieve.search(cases, ["alpha", "beta"], limit=1, recall_cap=10).first()["catalog_key"] == "k49"
    assert retrieve.search(cases, ["%"], limit=1).count() == 0


@pytest.mark.parametrize(("scores", "mode", "visible"), [([94, 86], "auto", 1), ([94, 92, 88, 80], "manual", 3), ([95], "auto", 1), ([50], "manual", 1)])
def test_selection(spark, scores, mode, visible):
    ranked = spark.createDataFrame([("g", i, s) for i, s in enumerate(scores)], "g string, i int, final_score int")
    r = retrieve.select_candidates(ranked, "g", "final_score", "i").first()
    assert (r["mode"], r["visible"]) == (mode, visible)


def test_policy_rounds_halves_to_even(spark):
    for est in (10, 30, 50, 83):
        s = retrieve.policy_score(F.lit(est), {}, F.lit(True))
        r = spark.range(1).select(*(c.alias(n) for n, c in s.items())).first()
        assert r["reasoning_quality"] == round(15 * est / 100) and r["source_pdf_quality"] == 10


def test_identity(spark):
    hist = spark.createDataFrame([("1", "Court", "a" * 64)], "case_number string, court_name string, pdf_sha256 string")
    new = spark.createDataFrame([(1, " 1 ", "COURT", "b" * 64), (2, None, None, "a" * 64), (3, "2", "Court", "c" * 64), (4, "2", "court ", "d" * 64), (5, None, "Court", "e" * 64)], "id long, case_number string, court_name string, pdf_sha256 string")
    assert {r["id"] for r in identity.used(new, hist, "id").collect()} == {1, 2}
    assert {r["id"] for r in identity.insertable(new, hist, "id").collect()} == {3, 5}
    kept = retrieve.not_excluded(new.drop("pdf_sha256"), hist)
    assert {r["id"] for r in kept.collect()} == {2, 3, 4, 5}


def test_reservations_expire(spark):
    rows = [(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 00:29:00"), (3, "k", "2024-01-01 00:30:00"), (4, "k", "2024-01-01 00:30:01"), (5, "j", "2024-01-01 00:01:00")]
    asked = spark.createDataFrame(rows, "request_id long, key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r["request_id"] for r in identity.reservations(asked).where("granted").collect()} == {1, 4, 5}


def test_gate(spark):
    stats = spark.createDataFrame([("g", 5)], "generation_id string, cases long")
    covered = quality.coverage(spark.createDataFrame([("a",), ("a",), ("b",)], "slug string"), spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"), 2)
    counters = spark.createDataFrame([(0, 0)], "seen long, failed long")
    r = quality.gate(stats, covered, counters).first()
    assert not r["passed"] and r["missing_subjects"] == ["c"] and r["thin_subjects"] == ["b"] and r["failure_ratio"] == 1.0
    assert r["reason"] == "cases 5 < required 20; no official documents were discovered; document failure ratio 100.00% exceeds 35.00%; course coverage 1/3 < required 3/3"


def test_violations(spark):
    base = {c: "نص سليم" for c in validate.SECTIONS} | {"references": ["x"], "judgment_text": "المادة 87", "expected_case_number": "12"}
    drafts = [base, base | {"title": " "}, base | {"legal_issue": "**x** AI"}, base | {"legal_issue": "*بند"}, base | {"court_reasoning": "المادة 78"}, base | {"court_reasoning": "القضية رقم 99"}]
    schema = ", ".join(f"{c} string" for c in validate.SECTIONS) + ", references array<string>, judgment_text string, expected_case_number string, i int"
    got = [r["violations"] for r in validate.violations(spark.createDataFrame([tuple([*(d[c] for c in validate.SECTIONS), d["references"], d["judgment_text"], d["expected_case_number"], i]) for i, d in enumerate(drafts)], schema)).orderBy("i").collect()]
    assert got == [[], ["empty section"], ["forbidden: **", "markdown", "ai reference"], ["markdown"], ["unsupported articles: 78"], ["foreign case: 99"]]


def test_json_salvage():
    whole = {"title": "a}", "x": [1, {"y": '"'}]}
    text = '{"candidates":[' + json.dumps(whole) + ", " + json.dumps(whole) + ', {"title": "cut'
    assert list(validate.complete_objects(text)) == [whole, whole]
    assert list(validate.complete_objects("no")) == [] and list(validate.complete_objects('{"candidates": ["s", {"a": 1}], "b": {"c": 2}}')) == [{"a": 1}]


def test_candidate_faults(spark):
    good = {"title": "abc", "source_name": "src", "source_url": "https://x.example/", "legal_issue": "abc", "suitability_reason": "abc", "estimated_score": 50}
    bad = [good | {"pdf_page_start": 2}, good | {"pdf_page_start": 3, "pdf_page_end": 2}, good | {"catalog_range_verified": True}, good | {"subject_relevance": 41}, good | {"title": "a"}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([good, *bad])], "i int, j string").select("i", F.from_json("j", validate.CANDIDATE).alias("c"))
    got = [r["f"] for r in rows.select("i", validate.candidate_faults(F.col("c")).alias("f")).orderBy("i").collect()]
    assert got == [[], ["pages"], ["pages"], ["provenance"], ["subject_relevance"], ["title"]]


def test_metadata_in_document(spark):
    r = spark.createDataFrame([("Case: ١٢-٣ of Court A", {"number": "12-3", "court": "court a", "year": "1437", "none": ""})], "t string, m map<string,string>")
    assert r.select(validate.missing_metadata(F.col("t"), F.col("m")).alias("x")).first()["x"] == ["year"]
