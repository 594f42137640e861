import pytest
from pyspark.sql import functions as F

from mizan import __main__ as cli
from mizan.config import Settings, load
from mizan.functions.text import human_size, safe_filename, short_reason
from mizan.operators import workflow
from mizan.operators.retrieve import Course
from mizan.sources import files
from mizan.sources.store import CatalogStore

from .test_functions import LEGACY, MODERN, one


def test_settings():
    assert load({}) == Settings() and load({"MIZAN_AUTO_ACCEPT_SCORE": "80"}).auto_accept_score == 80
    for bad in ({"auto_accept_score": 101}, {"required_subject_coverage_percent": 0}, {"max_document_failure_ratio": 1.0}, {"pdf_max_pages": 0}):
        with pytest.raises(ValueError):
            load({}, **bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"0" * 500)
    docs = files.documents(spark, f"file://{tmp_path}", max_bytes=100)
    got = {r["path"].rpartition("/")[2]: r["is_pdf"] for r in docs.collect()}
    assert got == {"a.pdf": True, "b.pdf": False}

    def broken(content):
        raise ValueError

    pages = files.page_texts(docs, [lambda c: [c.decode(), None], broken]).orderBy("doc_id", "page_no").collect()
    assert len(pages) == 4 and {r["engine_rank"] for r in pages} == {0}
    assert files.stale(docs, F.current_timestamp() + F.expr("INTERVAL 2 HOURS"), 0).count() == 2
    names = spark.createDataFrame([(f"b-2024010{i}T000000Z",) for i in range(1, 6)], "path string")
    assert {r[0] for r in files.surplus_backups(names, 3).collect()} == {"b-20240101T000000Z", "b-20240102T000000Z"}
    assert one(spark, "x", files.pdf_faults(F.lit(True), F.lit(True), F.lit(2000))) == ["encrypted", "too many pages"]


def test_small_texts(spark):
    assert one(spark, "حكم رقم 1/2 (x)", safe_filename(F.col("t"))) == "حكم-رقم-1-2-x"
    assert one(spark, None, safe_filename(F.col("t"))) == "case"
    assert [one(spark, "x", human_size(F.lit(n))) for n in (12, 2048, 3 << 20)] == ["12 B", "2.0 KB", "3.0 MB"]
    assert one(spark, "  ", short_reason(F.col("t"), F.lit("ValueError"))) == "ValueError"
    assert one(spark, "nope", workflow.failure_message(F.col("t"))) == workflow.OTHER_FAILURE
    assert one(spark, "x", workflow.bullets(F.array(F.lit("a"), F.lit("b")))) == "- a\n- b"
    assert one(spark, "x", workflow.others(F.array(F.lit("a"), F.lit("b")), F.lit("a"))) == ["b"]


def test_extracts_and_metadata(spark):
    rows = [("ok", 1, LEGACY, "1990/1434"), ("ok", 2, "نص", "1990/1434"), ("tail", 1, "نص", "1"), ("other", 1, LEGACY, None), ("other", 2, MODERN, None), ("wrong", 1, LEGACY, "7")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, expected string")
    got = {r["doc_id"]: r["fault"] for r in workflow.validate_extracts(pages).collect()}
    assert got == {"ok": None, "tail": "no header first", "other": "another case on page 2", "wrong": "starts with another case"}
    meta = {r["doc_id"]: r["metadata"] for r in workflow.document_metadata(pages, header_required=True).collect()}
    assert set(meta) == {"ok", "other", "wrong"} and meta["ok"]["decision_number"] == "34251262"
    cand = spark.createDataFrame([("old", "keep", ("new", None))], "case_number string, court_name string, metadata struct<case_number:string,court_name:string>")
    r = workflow.verified_over_candidate(cand).first()
    assert (r["case_number"], r["court_name"]) == ("new", "keep")


def test_ranges_usage_and_records(spark):
    cand = spark.createDataFrame([("u1", "AA", 5), ("u2", "bb", 5), ("u3", "cc", 50), ("u4", "dd", 1)], "url string, catalog_pdf_sha256 string, pdf_page_end int")
    art = spark.createDataFrame([("u1", "aa", 9), ("u2", "xx", 9), ("u3", "cc", 9)], "url string, sha256 string, page_count int")
    assert {r["url"]: r["fault"] for r in workflow.range_faults(cand, art).collect()} == {"u1": None, "u2": "fingerprint changed", "u3": "range exceeds file", "u4": "not fetched"}
    hist = spark.createDataFrame([("s", "1", "c", "a", 1), ("s", "2", "c", "b", 2), ("t", "3", "c", "d", 3)], "subject_slug string, case_number string, court_name string, pdf_sha256 string, used_at int")
    assert [r["used_at"] for r in workflow.usage_window(hist, 0, 200, "s").collect()] == [2]
    assert workflow.usage_window(hist, 9, 2).count() == 2
    sent = spark.createDataFrame([(1, "t1", "s", "1", "C ", "z"), (2, "t2", "s", "9", "c", "y"), (3, "t2", "s", "9", "c", "y")], "id long, token string, subject_slug string, case_number string, court_name string, pdf_sha256 string")
    new, audit, release = workflow.record_sent(sent, hist, "id")
    assert [r["id"] for r in new.collect()] == [2] and audit.count() == 1 and release.count() == 2
    items = spark.range(20)
    assert [r["id"] for r in workflow.page_of(items, ["id"], 99).collect()] == [16, 17, 18, 19]
    v = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True)], "slug string, verified boolean")
    assert [(r["slug"], r["lacking"]) for r in workflow.not_yet(v, 2).collect()] == [("a", 1)]
    a = spark.createDataFrame([("d", 1, "x")], "doc_id string, page_no int, text string")
    b = spark.createDataFrame([("d", 1, "y"), ("d", 2, "z")], "doc_id string, page_no int, text string")
    assert workflow.merge_engines(a, b).where("text_a is null").count() == 1


def test_build_a_generation(spark, tmp_path):
    body = "نزاع تجاري بين تاجر ومورد حول عقد توريد بضائع " * 20
    rows = []
    for d in range(3):
        rows += [(f"doc{d}", 1, "فهرس", f"https://x.example/{d}.pdf", "s", "a" * 64), (f"doc{d}", 2, LEGACY.replace("1990", str(1990 + d)) + "\n" + body, f"https://x.example/{d}.pdf", "s", "a" * 64), (f"doc{d}", 3, body, f"https://x.example/{d}.pdf", "s", "a" * 64)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, url string, source_id string, pdf_sha256 string")
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    courses = [Course("commerce", keywords=("نزاع تجاري",), priority=("تاجر",))]
    assert cli.build(spark, store, pages, courses, load({}))[1].startswith("cases 3 < required 20")
    assert store.active() is None
    ok, why = cli.build(spark, store, pages, courses, load({}, min_cases_for_activation=3))
    assert ok, why
    g = store.active(6)
    assert (g.cases_indexed, g.covered_subjects) == (3, 1)
    cases = store.cases(g.generation_id).orderBy("case_number").collect()
    assert [(r["case_number"], r["page_start"], r["page_end"]) for r in cases] == [("1990/1434", 2, 3), ("1991/1434", 2, 3), ("1992/1434", 2, 3)]
    missing = [*courses, Course("absent", keywords=("فضاء خارجي",))]
    ok, why = cli.build(spark, store, pages, missing, load({}, min_cases_for_activation=3))
    assert not ok and "course coverage 1/2" in why and store.active(6).generation_id == g.generation_id
