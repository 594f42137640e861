import unicodedata

import pytest
from pyspark.sql import functions as F

from mizan.functions import headers, text, urls
from mizan.operators.retrieve import plain_term

LEGACY = "المملكة\nرقم الصك: 33659138\nرقم الدعوى: 1990/1434\nقرار التصديق رقم: 34251262 تاريخه 1434/06/25\nالموضوعات\nنص"
GRIEVANCES = "رقم القضية في المحكمة الإدارية 1/ق/9221 لعام 1437هـ\nرقم القضية في محكمة الاستئناف الإدارية 55\nالموضوعات\nمستند الحكم"
SECURITIES = "لجنة الفصل في منازعات الأوراق المالية\nرقم القضية لدى لجنة الفصل في منازعات الأوراق المالية: 45/10\nنوع الدعوى: مدنية\nالتصنيف"
INSURANCE = "لجان الفصل في المنازعات والمخالفات التأمينية\nرقم الدعوى: 370841\nنوع الوثيقة: تأمين\nالتصنيف الموضوعي"
TAX = "اللجنة الجمركية للزكاة\nالدائرة الاستئنافية\nالاستئناف المقيد برقم (136308-2022Z)\nمنطوق القرار"
MODERN = "محكمة الدرجة الأولى: المحكمة العامة بالرياض\nرقم القضية: ٣٤١٨١٦١٢ تاريخها: ١٤٣٤\nرقم القرار: ٣٥٢٦٢٩٧٤ تاريخه: ١٤٣٥/٠٦/٠٢\nمحكمة الاستئناف: محكمة الاستئناف بمكة"
REFERENCE = "المحكمة العامة\nوقد أشار المدعي في القضية رقم 5555 إلى ذلك"
DECISION = "لجان الفصل في المنازعات والمخالفات التأمينية\nقرار اللجنة الابتدائية بالرياض\nالقرار رقم: 1432-112"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("page", "number", "source"), [
    (LEGACY, "1990/1434", "case-legacy"), (GRIEVANCES, "1/ق/9221", "case-bog"), (SECURITIES, "45/10", "case-crsd"), (INSURANCE, "370841", "case-idc"),
    (TAX, "136308-2022Z", "case-gstc"), (MODERN, "34181612", "case-modern"), (DECISION, "1432-112", "decision"),
])
def test_header_grammars(page, number, source):
    found = headers.primary(page)
    assert (found[0], found[2]) == (number, source)
    assert headers.primary("\n".join(x[::-1] for x in page.splitlines()))[0] == number  # lines stored from their ends


@pytest.mark.parametrize("page", [REFERENCE, "", "القرار رقم: 1432-112"])
def test_no_header(page):
    assert headers.primary(page) is None


def test_presentation_forms_and_offsets():
    assert headers.primary(LEGACY.replace("الموضوعات", "ﺍﻟﻤﻮﺿﻮﻋﺎﺕ"))[0] == "1990/1434"
    lines = "س" * 69 + "\n"  # 70 characters a line, so the label's offset is 70 a line
    assert headers.primary(lines * 28 + MODERN.replace("محكمة الدرجة الأولى: المحكمة العامة بالرياض\n", "") + "\nمحكمة الدرجة الأولى") is not None
    assert headers.primary(lines * 66 + LEGACY) is None


def test_metadata():
    number, court, year, decision, date, appeal = headers.metadata(MODERN)
    assert (number, year, decision, date) == ("34181612", "1434", "35262974", "1435/06/02")
    assert court == "المحكمة العامة بالرياض" and appeal == "محكمة الاستئناف بمكة"
    assert headers.metadata(GRIEVANCES)[2] == "1437"


def test_labelled_numbers():
    assert headers.labelled(REFERENCE) == ["5555"]
    assert headers.labelled(DECISION) == ["1432-112"]
    assert headers.labelled(DECISION, decisions=False) == []


@pytest.mark.parametrize(("value", "number"), [("(٣٤/١)", "34/1"), ("12 هـ", "12"), ("abc", None), (None, None), ("55لعام1437", "55"), ("1ـ2", "12")])
def test_case_number(value, number):
    assert headers.case_number(value) == number


def test_normalizers_against_python(spark):
    samples = ["الْقَضِيَّةُ رقمـ ٣٤/١٤٣٥ إلى أُخرى! ABC", "", "  a b\t c ", "۱۲۳ ﻻ ﷲ", "ة ى ئ ؤ آ", "Straße Ünï 12-3/4"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select(
        "t", text.normalize_arabic(F.col("t")).alias("n1"), text.normalize_search(F.col("t")).alias("n2"), text.normalize_relevance(F.col("t")).alias("n3"), text.normalize_compact(F.col("t")).alias("n5")
    )
    for r in rows.collect():
        assert r["n1"] == plain_term(r["t"])
        assert r["n2"] == headers.search_form(r["t"])
        assert " ".join(r["n3"].split()) == headers.search_form(r["t"], digits=False)
        assert r["n5"] == "".join(r["t"].translate(str.maketrans(text.ARABIC_DIGITS, text.ASCII_DIGITS)).split()).lower()


def test_year_is_returned_not_an_error(spark):
    """The year of a text is its value; a text with one never fails."""
    assert one(spark, "صدر عام ١٤٣٧ هـ", text.detect_year(F.col("t"))) == "1437"
    assert one(spark, "no year", text.detect_year(F.col("t"))) is None


def test_court_title_articles(spark):
    assert one(spark, "x\nالمحكمة  العامة بالرياض.\n", text.detect_court(F.col("t"))) == "المحكمة العامة بالرياض"
    assert one(spark, "رقم الصك 12 في المحكمة\nنزاع حول عقد توريد", text.make_title(F.col("t"), F.lit("12"))) == "نزاع حول عقد توريد"
    assert one(spark, "x", text.make_title(F.col("t"), F.lit("12"))) == text.TITLE_OF_NUMBER + "12"
    assert one(spark, "المادة ٠٧٨ والمادة رقم (87) المواد 78", text.article_numbers(F.col("t"))) == ["78", "87"]
    assert one(spark, "12-345-6789-1011", text.number_tokens(F.col("t"))) == ["345", "6789", "1011"]


def test_urls(spark):
    rows = ["https://a.example/x.pdf", "http://a.example/", "https://u:p@a.example/", "https://a.example:8443/", "https://10.0.0.1/x", "https://127.0.0.1/", "https://8.8.8.8:443/"]
    got = spark.createDataFrame([(u,) for u in rows], "u string").select(urls.url_faults(F.col("u"), F.lit(True)).alias("f")).collect()
    assert [r["f"] for r in got] == [[], ["not https"], ["credentials"], ["port"], ["address not public"], ["address not public"], []]
    ok = urls.path_allowed(F.col("t"), F.array(F.lit("/Judgments/")), F.array(F.lit("/Forms/")))
    assert one(spark, "https://a.example/judgments/1.pdf", ok) is True
    assert one(spark, "https://a.example/judgments/forms/1.pdf", ok) is False
    assert one(spark, "https://a.example/other", ok) is False
    assert one(spark, '<a href="/a?x=1&amp;y=2">"https:\\/\\/b.example\\/c.pdf"', urls.links(urls.unescaped(F.col("t")))) == ["/a?x=1&y=2", "https://b.example/c.pdf"]


def test_nfkc_null(spark):
    assert one(spark, None, text.nfkc(F.col("t"))) is None
    assert one(spark, "ﬁ", text.nfkc(F.col("t"))) == unicodedata.normalize("NFKC", "ﬁ")


def test_compact_and_metadata_forms_of_every_character(spark):
    """As by the patterns that say what goes, for every character alone and among others; white space and ASCII take no pattern."""
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = [("x" + "".join(f"A{c}" for c in chars[i : i + 64]) + " Ω7", ) for i in range(0, len(chars), 64)] + [("".join(chars[i : i + 64]),) for i in range(0, 0x3100, 64)] + [("",), (None,), (" \t١٢ 3ـ",)]
    t = F.col("t")
    n5 = F.lower(F.regexp_replace(text.ascii_digits(t), text.SPACE + "+", ""))
    n6 = F.regexp_replace(text.plain_letters(F.translate(F.lower(text.ascii_digits(t)), text.TATWEEL, "")), r"[^0-9a-z؀-ۿ]+", "")
    df = spark.createDataFrame(rows, "t string")
    both = df.select("t", n5.alias("w5"), n6.alias("w6"), text.normalize_compact(t).alias("g5"), text.normalize_metadata(t).alias("g6"))
    assert both.where(~(F.col("w5").eqNullSafe(F.col("g5")) & F.col("w6").eqNullSafe(F.col("g6")))).count() == 0
    assert set(text.SPACES) == {c for c in chars if c.isspace()}
    plan = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan(text.normalize_compact(t))
    assert "CASE WHEN (octet_length" in plan(text.normalize_metadata(t)) and "[^" not in plan(text.normalize_metadata(t))
