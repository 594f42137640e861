"""Steps whose cost must not follow texts, files or labels that are not there."""

import re

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from mizan.functions import headers, text
from mizan.operators import retrieve, segment, validate
from mizan.sources import pages as source


def test_sizes_round_halves_to_even(spark):
    sizes = [1280, 1792, 1024, 1310720, 1048576 * 5 // 4 + 1, 1023, 1048575]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(text.human_size(F.col("n"))).collect()
    assert [r[0] for r in got] == ["1.2 KB", "1.8 KB", "1.0 KB", "1.2 MB", "1.3 MB", "1023 B", "1024.0 KB"]


@pytest.mark.parametrize("said", ["نص بلا عنوان " * 50, "قرار المحكمة في الحكم " * 50])
def test_a_page_without_a_label_has_no_search_form(monkeypatch, said):
    def no_form(*_):
        raise AssertionError("a form was made")

    monkeypatch.setattr(headers, "search_form", no_form)
    assert headers.primary(said) is None and headers.labelled(said) == [] and headers.metadata(said)[0] is None


def test_letters_of_numbers_are_those_of_re_i():
    label = headers._find(r"x([A-Za-z])")
    assert {c for c in map(chr, range(0x11000)) if label.fullmatch("x" + c)} == {c for c in map(chr, range(0x11000)) if re.fullmatch("x([A-Za-z])", "x" + c, re.I)}


def test_texts_of_pages_are_not_shuffled_or_broadcast(spark):
    pages = spark.range(3).selectExpr("id AS doc_id", "explode(sequence(1, 9)) AS page_no").selectExpr("doc_id", "page_no", "repeat('المدعي ', 60) AS text", "CASE page_no WHEN 2 THEN '7' WHEN 5 THEN '8' END AS number")
    wanted = spark.createDataFrame([(0, "7"), (1, "8"), (2, "9")], "doc_id long, expected string")
    hints = spark.createDataFrame([(0, 2, 9, "7")], "doc_id long, hint_start int, hint_end int, expected string")
    for found, want in ((segment.locate(wanted, pages), [(0, "7", 2, 4), (1, "8", 5, 9)]), (segment.refine_ranges(hints, pages), [(0, "7", 2, 4)])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert sorted((r["doc_id"], r["number"], r["page_start"], r["page_end"]) for r in found.collect()) == want


def test_small_shares_are_dealt_to_few_tasks(monkeypatch):
    monkeypatch.setattr(source, "MOST_TASKS", 7)
    files = [fs.FileInfo(f"f{i}", type=fs.FileType.File, size=25) for i in range(10)]
    reader = source._Files({"bytesPerTask": "10"})
    dealt = reader.dealt(files)
    assert len(dealt) == 7 and [x for d in dealt for x in d.own] == reader.shares(files) and max(len(d.own) for d in dealt) == 5


def test_relevance_bounds_what_python_gets_at_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    retrieve.assess(spark.createDataFrame([("x",)], "text string"), [retrieve.Course("c", keywords=("عقد توريد",))])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_draft_checks_tell_what_they_told(spark):
    said = ["AI", "ai.", "x Ai y", "aı", "Aİ!", "again AI-made", "_AI", "1ai", "éAI", "AIé", "aid", "(ai)", "", "ب AI ت", "AI\u0301", "* x", "a *b", "*b", "a*b", "\u00a0*b", "المادة ٠٧ والمواد 8", "الماد 7"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", validate.mentions_ai(F.col("t")), F.regexp_like("t", F.lit(r"(?iU)\bAI\b")), validate.has_markdown(F.col("t")), F.regexp_like("t", F.lit(r"(?U)(^|\s)\*(?=\S)")), text.article_numbers(F.col("t"))).collect()
    assert [r[0] for r in rows if r[1] != r[2] or r[3] != r[4]] == []
    assert [r[5] for r in rows if r[5]] == [["7", "8"]]
