"""Registered queries of configuration, files, headers, ranges, drafts, answers and reports, over inputs made of the tables' rows.

The tables hold no judgments, so a row's key chooses one of a few forms of text and puts its own numbers into it ({n} three
digits, {a} the same in Arabic digits, {o} a byte); SQL says from the same key what must come out.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __main__ as command
from ..config import load
from ..functions import headers, text, urls
from ..functions.text import ARABIC_DIGITS
from ..operators import quality, reports, retrieve, segment, validate, workflow
from ..operators.retrieve import Course
from ..shared import own_folder
from ..sources import files, pages, profiles
from ..sources.store import CatalogStore
from ..streaming import events as stream
from .catalog import _quote, query, table

DIGITS = "0123456789"


class Flipped(str):
    """A text whose lines are written from their ends."""


def _filled(key: Column, forms: list) -> Column:
    """The key's form with its numbers; null for a form that is none."""
    n, o = (key % 900 + 100).cast("string"), (key % 200 + 20).cast("string")
    given = F.element_at(F.array(*(F.lit(f).cast("string") for f in forms)), (key % len(forms) + 1).cast("int"))
    out = F.replace(F.replace(F.replace(given, F.lit("{n}"), n), F.lit("{a}"), F.translate(n, DIGITS, ARABIC_DIGITS)), F.lit("{o}"), o)
    flipped = [i for i, f in enumerate(forms) if isinstance(f, Flipped)]
    return F.when((key % len(forms)).isin(flipped), F.array_join(F.transform(F.split(out, "\n"), F.reverse), "\n")).otherwise(out) if flipped else out


def _text_sql(x: object) -> str:
    if x is None or isinstance(x, bool | int):
        return "NULL" if x is None else str(x).lower()
    said = " || chr(10) || ".join(_quote(part) for part in str(x).split("\n"))
    said = f"replace({said}, '{{n}}', CAST(key % 900 + 100 AS VARCHAR))" if "{n}" in str(x) else f"({said})"
    return f"replace({said}, '{{o}}', CAST(key % 200 + 20 AS VARCHAR))" if "{o}" in str(x) else said


def _filled_sql(name: str, kind: str, wanted: list) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text_sql(w)}" for i, w in enumerate(wanted))
    return f"CAST(CASE key % {len(wanted)} {cases} END AS {kind}) AS {name}"


def told_sql(columns: dict[str, tuple[str, list]], key: str = "event_id", source: str = "events") -> str:
    """SQL of a row for each key: columns {name: (kind, what each form must give)}."""
    return f"SELECT key, {', '.join(_filled_sql(n, *c) for n, c in columns.items())} FROM (SELECT {key} AS key FROM {source})"


def keys(spark: SparkSession, sf_dir: str, key: str = "event_id", source: str = "events") -> DataFrame:
    """Keys, dealt to all cores: they are few bytes and lie in few tasks' files, and each becomes long texts."""
    return table(spark, sf_dir, source).select(F.col(key).cast("long").alias("key")).repartition(4 * spark.sparkContext.defaultParallelism)


# numbers, headers and texts

_NUMBERS = [("({a}/١)", "{n}/1"), ("{n} هـ", "{n}"), ("abc", None), ("55لعام1{n}", "55"), ("{n}ـ2", "{n}2"), (" :-{a}/ق/١٤٣٧. ", "{n}/ق/1437"), ("１{n}", "1{n}")]


@query(told_sql({"number": ("VARCHAR", [w for _, w in _NUMBERS])}))
def case_number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return keys(spark, sf_dir).select("key", headers.normalize_case_number(_filled(k, [f for f, _ in _NUMBERS])).alias("number"))


_LABELS = [
    ("المحكمة\nوقد أشار في القضية رقم 5{n} ثم الدعوى رقم {n}/1 والقضية رقم 5{n}", "5{n},{n}/1"), ("لجان الفصل في المنازعات والمخالفات التأمينية\nالقرار رقم: 1432-{n}", "1432-{n}"),
    ("القرار رقم: 1432-{n}", ""), (Flipped("المحكمة\nالقضية رقم 5{n}"), "5{n}"),
]


@query(told_sql({"numbers": ("VARCHAR", [w for _, w in _LABELS])}))
def labelled_case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers behind labels by place; a committee's decisions where there is no case; lines also from their ends."""
    said = keys(spark, sf_dir).select("key", _filled(F.col("key"), [f for f, _ in _LABELS]).alias("text"))
    return said.select("key", F.array_join(headers.labelled_numbers("text"), ",").alias("numbers"))


LEGACY = "المملكة\nرقم الصك: 33659138\nرقم الدعوى: 1{n}/1434\nقرار التصديق رقم: 34251{n} تاريخه 1434/06/25\nالموضوعات\nنص"
MODERN = "محكمة الدرجة الأولى: المحكمة العامة بالرياض\nرقم القضية: ٣٤١٨١{a} تاريخها: ١٤٣٤\nرقم القرار: ٣٥٢٦٢{a} تاريخه: ١٤٣٥/٠٦/٠٢\nمحكمة الاستئناف: محكمة الاستئناف بمكة"
BODY = "نزاع تجاري بين تاجر ومورد حول عقد توريد بضائع " * 20
SECURITIES = "لجنة الفصل في منازعات الأوراق المالية"
_HEADED = [
    (LEGACY, "1{n}/1434", "case-legacy", None, None), (MODERN, "34181{n}", "case-modern", "المحكمة العامة بالرياض", "محكمة الاستئناف بمكة"), (Flipped(LEGACY), "1{n}/1434", "case-legacy", None, None),
    (f"{SECURITIES}\nرقم القضية لدى {SECURITIES}: 45/{{n}}\nنوع الدعوى: مدنية\nالتصنيف", "45/{n}", "case-crsd", SECURITIES, None),
    ("لجان الفصل في المنازعات والمخالفات التأمينية\nرقم الدعوى: 370{n}\nنوع الوثيقة: تأمين\nالتصنيف الموضوعي", "370{n}", "case-idc", None, None),
    ("اللجنة الجمركية للزكاة\nالدائرة الاستئنافية\nالاستئناف المقيد برقم (136{n}-2022Z)\nمنطوق القرار", "136{n}-2022Z", "case-gstc", None, None),
    ("المحكمة العامة\nوقد أشار المدعي في القضية رقم 5{n} إلى ذلك", None, None, None, None), ("محكمة الدرجة الأولى: بعد\nنص {n}", None, None, None, None), ("", None, None, None, None),
]


@query(told_sql({name: ("VARCHAR", [h[i] for h in _HEADED]) for i, name in enumerate(("number", "source", "court", "appeal_court"), 1)}))
def header_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar that names a page's case, and the courts that its labels give."""
    pages = keys(spark, sf_dir).select("key", _filled(F.col("key"), [h[0] for h in _HEADED]).alias("text"))
    read = pages.select("key", headers.primary_header("text").alias("h"), headers.judgment_metadata("text").alias("m"))
    return read.select("key", F.col("h.case_number").alias("number"), F.col("h.source").alias("source"), F.col("m.court_name").alias("court"), F.col("m.appeal_court_name").alias("appeal_court"))


_EXTRACTED = [
    ("المملكة\nالصك: ٣٣٦٥٩١٣٨ تاريخه: ١٤٣٣\nرقم الدعوى: 1{n}/1434\nقرار التصديق رقم: 34251{n} تاريخه 1434/06/25\nالموضوعات\nنص", "1{n}/1434", 7, "case-legacy", None, None, "34251{n}", "1{n}/1434"),
    ("رقم القضية في المحكمة الإدارية 1/ق/9{n} لعام 1437هـ\nرقم القضية في محكمة الاستئناف الإدارية 55\nالموضوعات\nمستند الحكم", "1/ق/9{n}", 14, "case-bog", "المحكمة الإدارية", "1437", None, "1/ق/9{n}"),
    (f"{SECURITIES}\nرقم القضية لدى {SECURITIES}: 45/{{n}}\nنوع الدعوى: مدنية\nالتصنيف", "45/{n}", 13, "case-crsd", SECURITIES, None, None, "45/{n}"),
    ("المحكمة العامة\nوقد أشار المدعي في القضية رقم 5{n} إلى ذلك", None, None, None, None, None, None, "5{n}"), ("", None, None, None, None, None, None, ""),
]
_EXTRACT_COLUMNS = ("case_number", "confidence", "source", "court_name", "judgment_year", "decision_number", "labels")


@query(told_sql({name: ("INTEGER" if name == "confidence" else "VARCHAR", [e[i] for e in _EXTRACTED]) for i, name in enumerate(_EXTRACT_COLUMNS, 1)}))
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = keys(spark, sf_dir).select("key", _filled(F.col("key"), [e[0] for e in _EXTRACTED]).alias("text"))
    read = pages.select("key", headers.primary_header("text").alias("h"), headers.judgment_metadata("text").alias("m"), F.array_join(headers.labelled_numbers("text"), ",").alias("labels"))
    return read.select("key", "h.*", F.col("m.court_name").alias("court_name"), F.col("m.judgment_year").alias("judgment_year"), F.col("m.decision_number").alias("decision_number"), "labels")


_TEXTS = [
    ("x\nالمحكمة  العامة بالرياض.\nصدر عام ١٤٣٧", None, "المحكمة العامة بالرياض. صدر عام ١٤٣٧", "1437", "المحكمة العامة بالرياض"), ("رقم الصك {n} في المحكمة\nنزاع حول عقد توريد {n}", "{n}", None, None, "نزاع حول عقد توريد {n}"),
    ("x", "{n}", None, None, "قضية رقم {n}"), ("{n} 456 789 012", None, None, None, "حكم قضائي منشور"),
]


@query(told_sql({name: ("VARCHAR", [t[i] for t in _TEXTS]) for i, name in enumerate(("court", "year", "title"), 2)}))
def texts_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court, year and title of texts without a known header."""
    k = F.col("key")
    rows = keys(spark, sf_dir).select("key", _filled(k, [t[0] for t in _TEXTS]).alias("text"), _filled(k, [t[1] for t in _TEXTS]).alias("number"))
    return rows.select("key", text.detect_court(F.col("text")).alias("court"), text.detect_year(F.col("text")).alias("year"), text.make_title(F.col("text"), F.col("number")).alias("title"))


# cases and ranges: a customer is a document

_CUSTOMERS = ("c_custkey", "customer")
_ADMITTED = [("1{n}/1434", f"  {LEGACY}\n{BODY}\n", 1026), ("7", f"{LEGACY}\n{BODY}", None), ("1{n}/1434", LEGACY, None), ("1{n}/1434", f"{LEGACY}\n{BODY}" * 2, 1500), ("1{n}/1434", BODY, None)]


@query(f"SELECT * FROM ({told_sql({'number': ('VARCHAR', [a[0] for a in _ADMITTED]), 'n_chars': ('INTEGER', [a[2] for a in _ADMITTED])}, *_CUSTOMERS)}) WHERE n_chars IS NOT NULL")
def case_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that are long enough and whose text says the number of their header: not another's, not none, not a short one."""
    k = F.col("key")
    own = keys(spark, sf_dir, *_CUSTOMERS).select("key", _filled(k, [a[0] for a in _ADMITTED]).alias("number"), _filled(k, [a[1] for a in _ADMITTED]).alias("text"), F.lit("u").alias("url"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))
    return segment.admitted(own, max_chars=1500).select("key", "number", F.length("text").alias("n_chars"))


def _layout(spark: SparkSession, sf_dir: str, pages: list[tuple[int, str, str | None]]) -> DataFrame:
    """Pages (doc_id, page_no, text, number) of every customer."""
    k = F.col("key")
    every = F.explode(F.array(*(F.struct(F.lit(p).alias("page_no"), F.lit(t).alias("text"), _filled(k, [n]).alias("number")) for p, t, n in pages)))
    return keys(spark, sf_dir, *_CUSTOMERS).select(k.alias("doc_id"), every.alias("x")).select("doc_id", "x.*")


_LONG = "المدعي " * 60
_HINTS = [(7, 11, "77{n}", "77{n}", 8, 9), (1, 9, "436", "34{n}", 5, 7), (4, 9, "77{n}", "77{n}", 8, 9), (40, 41, None, None, None, None)]


@query(f"SELECT key AS doc_id, hint_start, expected, number, page_start, page_end FROM ({told_sql({'hint_start': ('INTEGER', [h[0] for h in _HINTS]), 'expected': ('VARCHAR', [h[2] for h in _HINTS]), 'number': ('VARCHAR', [h[3] for h in _HINTS]), 'page_start': ('INTEGER', [h[4] for h in _HINTS]), 'page_end': ('INTEGER', [h[5] for h in _HINTS])}, *_CUSTOMERS)}) WHERE number IS NOT NULL")
def hinted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinted ranges moved to the headers near them: the expected number, else the nearest in the hint, else the nearest."""
    numbers, k = {5: "34{n}", 8: "77{n}", 10: "99{n}"}, F.col("key")
    pages = _layout(spark, sf_dir, [(i, _LONG, numbers.get(i)) for i in range(1, 13)])
    at = lambda i: F.element_at(F.array(*(F.lit(h[i]) for h in _HINTS)), (k % len(_HINTS) + 1).cast("int"))
    hints = keys(spark, sf_dir, *_CUSTOMERS).select(k.alias("doc_id"), at(0).alias("hint_start"), at(1).alias("hint_end"), _filled(k, [h[2] for h in _HINTS]).alias("expected"))
    return segment.refine_ranges(hints, pages).select("doc_id", "hint_start", "expected", "number", "page_start", "page_end")


_WANTED = [("7{n}", 2, 3), ("8{n}", 5, 24), ("9{n}", None, None)]


@query(f"SELECT key AS doc_id, expected, page_start, page_end FROM ({told_sql({'expected': ('VARCHAR', [w[0] for w in _WANTED]), 'page_start': ('INTEGER', [w[1] for w in _WANTED]), 'page_end': ('INTEGER', [w[2] for w in _WANTED])}, *_CUSTOMERS)}) WHERE page_start IS NOT NULL")
def located_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the expected case: up to the next other header or twenty pages, without decorative ones at the end."""
    pages = _layout(spark, sf_dir, [(1, _LONG, None), (2, _LONG, "7{n}"), (3, _LONG, None), (4, "صفحة", None), *((i, _LONG, "8{n}" if i in (5, 6) else None) for i in range(5, 31))])
    wanted = keys(spark, sf_dir, *_CUSTOMERS).select(F.col("key").alias("doc_id"), _filled(F.col("key"), [w[0] for w in _WANTED]).alias("expected"))
    return segment.locate(wanted, pages).select("doc_id", "expected", "page_start", "page_end")


# (first page, second page, expected number, verified, fault, number of the first header, case number, decision)
_EXTRACTS = [
    (LEGACY, "نص", "1{n}/1434", True, None, "1{n}/1434", "34251{n}"), ("نص", LEGACY, "1{n}/1434", False, "no header first", None, None), (LEGACY, MODERN, None, False, "another case on page 2", "1{n}/1434", "34251{n}"),
    (LEGACY, None, "7", False, "starts with another case", "1{n}/1434", "34251{n}"), ("see 12{n} there", None, "12{n}", True, "no header first", None, None), ("nothing", None, "12{n}", False, "no header first", None, None),
    ("القضية رقم 5{n}", None, "5{n}", True, "no header first", None, None),
]


def _extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    page = lambda i: F.struct(F.lit(i + 1).alias("page_no"), _filled(k, [e[i] for e in _EXTRACTS]).alias("text"))
    rows = keys(spark, sf_dir, *_CUSTOMERS).select(k.alias("doc_id"), _filled(k, [e[2] for e in _EXTRACTS]).alias("expected"), F.explode(F.array(page(0), page(1))).alias("x"))
    return rows.where("x.text is not null").select("doc_id", "x.page_no", "x.text", "expected")


@query(f"SELECT key AS doc_id, verified FROM ({told_sql({'verified': ('BOOLEAN', [e[3] for e in _EXTRACTS])}, *_CUSTOMERS)})")
def single_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By headers if there are any, else by labels, else by the number's digits on one page."""
    return segment.verify_single_case(_extracts(spark, sf_dir)).select("doc_id", "verified")


_ARABIC = f"translate(CAST(key % 900 + 100 AS VARCHAR), '{DIGITS}', '{ARABIC_DIGITS}')"
_WHOLE = "CASE key % 7 " + " ".join(f"WHEN {i} THEN " + " || chr(12) || ".join(f"replace({_text_sql(p)}, '{{a}}', {_ARABIC})" for p in e[:2] if p is not None) for i, e in enumerate(_EXTRACTS)) + " END"


@query(f"SELECT t.key AS doc_id, fault, number, sha256({_WHOLE.replace('key %', 't.key %')}) AS sha256 FROM ({told_sql({'fault': ('VARCHAR', [e[4] for e in _EXTRACTS]), 'number': ('VARCHAR', [e[5] for e in _EXTRACTS])}, *_CUSTOMERS)}) t")
def extract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.validate_extracts(_extracts(spark, sf_dir))


@query(f"SELECT key AS doc_id, case_number, decision_number, '1434/06/25' AS decision_date FROM ({told_sql({'case_number': ('VARCHAR', [e[5] for e in _EXTRACTS]), 'decision_number': ('VARCHAR', [e[6] for e in _EXTRACTS])}, *_CUSTOMERS)}) WHERE case_number IS NOT NULL")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents that begin with a header, from their first page."""
    return workflow.document_metadata(_extracts(spark, sf_dir), header_required=True).select("doc_id", *(F.col(f"metadata.{c}").alias(c) for c in ("case_number", "decision_number", "decision_date")))


# addresses, files and the store

_URLS = [
    ("https://a{n}.example/x.pdf", ""), ("http://a{n}.example/", "not https"), ("https://u:p@a{n}.example/", "credentials"), ("https://a{n}.example:8{n}/", "port"), ("https://10.0.{o}.1/x", "address not public"), ("https://[fd00::{n}]/", "address not public"),
    ("https://8.8.8.{o}:443/", ""), ("ftp://u@192.168.{o}.1:21/", "not https,credentials,port,address not public"),
]


@query(told_sql({"faults": ("VARCHAR", [w for _, w in _URLS])}))
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keys(spark, sf_dir).select("key", _filled(F.col("key"), [u for u, _ in _URLS]).alias("url"))
    return rows.select("key", F.array_join(urls.url_faults(F.col("url"), F.lit(True)), ",").alias("faults"))


@query("""SELECT 'p' || p_partkey || ':v' || n AS document_id, CASE p_partkey % 4 WHEN 0 THEN 'https://x' || p_partkey || '.example/' || n || '.pdf' ELSE 'https://y.example/v/' || n END AS url
FROM (SELECT p_partkey, unnest(generate_series(CASE WHEN p_partkey % 4 = 3 THEN 9 ELSE 1 END, p_partkey % 7)) AS n FROM part WHERE p_partkey % 4 <> 2)""")
def series_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of numbered series: with the number in their address or without, of no address, and of empty ranges."""
    k = F.col("p_partkey")
    template = F.when(k % 4 == 0, F.concat(F.lit("https://x"), k, F.lit(".example/{volume}.pdf"))).when(k % 4 == 2, F.lit(None)).otherwise(F.lit("https://y.example/v/{volume}"))
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("id"), template.alias("url_template"), F.when(k % 4 == 3, 9).otherwise(1).alias("first"), (k % 7).cast("int").alias("last"))
    return profiles.series(own)


_BOUND = 70
_CONTENT = "CASE WHEN n_nationkey % 3 = 0 THEN '<html>' ELSE '%PDF-1.7 ' END || repeat(n_name, CAST(n_nationkey % 9 AS INTEGER)) || chr(12) || n_name"


def _nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, within the size bound."""
    path, k = own_folder(spark, "files"), F.col("n_nationkey")
    content = F.concat(F.when(k % 3 == 0, "<html>").otherwise("%PDF-1.7 "), F.repeat("n_name", (k % 9).cast("int")), F.lit("\f"), "n_name")
    table(spark, sf_dir, "nation").select("n_nationkey", content.alias("value")).write.partitionBy("n_nationkey").text(path)
    return files.documents(spark, path, max_bytes=_BOUND, pattern="*.txt")


@query(f"SELECT sha256(t || chr(10)) AS sha256, strlen(t) + 1 AS size_bytes, starts_with(t, '%PDF-') AS is_pdf FROM (SELECT {_CONTENT} AS t FROM nation) WHERE strlen(t) < {_BOUND}")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files within the size bound, with their digest and whether they begin as PDF does."""
    return _nation_files(spark, sf_dir).select("sha256", "size_bytes", "is_pdf")


@query(f"""WITH f AS (SELECT {_CONTENT} || chr(10) AS t FROM nation), s AS (SELECT *, sha256(t) AS doc_id FROM f WHERE strlen(t) <= {_BOUND})
SELECT doc_id, CAST(1 AS INTEGER) AS page_no, CAST(0 AS INTEGER) AS engine_rank, split_part(t, chr(12), 1) AS text FROM s UNION ALL SELECT doc_id, 2, 0, split_part(t, chr(12), 2) FROM s UNION ALL SELECT doc_id, 3, 0, '' FROM s UNION ALL SELECT doc_id, 1, 2, 'other' FROM s""")
def pages_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each engine reads; one that fails gives none."""

    def broken(content: bytes) -> list[str]:
        raise ValueError("no such format")

    return files.page_texts(_nation_files(spark, sf_dir), [lambda c: [*c.decode().split("\f"), None], broken, lambda c: ["other"]])


@query("SELECT 'b-' || lpad(CAST(n_nationkey * 7 % 25 AS VARCHAR), 8, '0') || 'T000000Z' AS path FROM nation ORDER BY 1 DESC OFFSET 5")
def backups_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("b-"), F.lpad((F.col("n_nationkey") * 7 % 25).cast("string"), 8, "0"), F.lit("T000000Z"))
    return files.surplus_backups(table(spark, sf_dir, "nation").select(name.alias("path")), 5)


def _builds(spark: SparkSession, sf_dir: str) -> tuple[CatalogStore, dict[str, int]]:
    """A build for each region, of its nations: every third fails."""
    store, ids = CatalogStore(spark, own_folder(spark, "store")), {}
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey"), F.lit("x").alias("collection_id"), F.col("n_name").alias("catalog_key"), F.concat(F.lit("s"), F.col("n_nationkey") % 2).alias("source_id"), F.lit("t").alias("text"))
    for r in (x[0] for x in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()):
        g = store.begin(6)
        ids[g.generation_id] = r
        store.write_cases(g, nation.where(F.col("n_regionkey") == r).drop("n_regionkey"))
        if r % 3 == 1:
            store.finish(g, "failed", f"gate {r}", documents_seen=-r)
        else:
            store.promote(store.finish(g, "building", documents_seen=r * 9, covered_subjects=r))
    return store, ids


_STATES = "s AS (SELECT r_regionkey AS r, CASE WHEN r_regionkey % 3 = 1 THEN 'failed' WHEN r_regionkey = (SELECT max(r_regionkey) FROM region WHERE r_regionkey % 3 <> 1) THEN 'ready' ELSE 'superseded' END AS status FROM region)"


@query(f"WITH {_STATES} SELECT r, status, CAST(CASE WHEN status = 'failed' THEN 0 ELSE r * 9 END AS BIGINT) AS seen, CASE WHEN status = 'failed' THEN 'gate ' || r END AS error, status = 'ready' AS readable FROM s")
def generation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a build for each region: replaced, failed, read; and which one readers of version 6 may use."""
    store, ids = _builds(spark, sf_dir)
    active = store.active(6)
    rows = [(ids[g.generation_id], g.status, g.documents_seen, g.last_error, active.generation_id == g.generation_id and store.active(5) is None) for g in store.states()]
    return spark.createDataFrame(rows, f"r {dict(table(spark, sf_dir, 'region').dtypes)['r_regionkey']}, status string, seen long, error string, readable boolean")


@query(f"""WITH {_STATES}, c AS (SELECT n_regionkey AS r, count(*) AS cases, count(DISTINCT n_nationkey % 2) AS sources FROM nation GROUP BY 1), l AS (SELECT max(r) AS r FROM s)
SELECT true AS readable, s.r AS own, c.cases, CAST(1 AS BIGINT) AS collections, c.sources, CAST(s.r AS BIGINT) AS covered, n.status AS newer_status, x.cases AS newer_cases, 'gate ' || n.r AS newer_error
FROM s JOIN c USING (r) LEFT JOIN (SELECT s.* FROM s JOIN l USING (r)) n ON n.r <> s.r LEFT JOIN c x ON x.r = n.r WHERE s.status = 'ready'""")
def report_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner is told of the catalog: the generation that is read, and the build after it that failed."""
    store, ids = _builds(spark, sf_dir)
    states = spark.createDataFrame([(g.generation_id, g.parser_version, g.status, g.started_at, g.covered_subjects, g.last_error) for g in store.states()], "generation_id string, parser_version int, status string, started_at string, covered_subjects long, last_error string")
    built = [own.select("generation_id", "collection_id", "source_id") for g in store.states() if (own := store.cases(g.generation_id)) is not None]
    cases = reduce(DataFrame.union, built)
    own = F.create_map(*(F.lit(x) for i, r in ids.items() for x in (i, r)))[F.col("generation_id")]
    out = reports.catalog_report(states, cases, store.active(6).generation_id, 6)
    return out.select("readable", own.alias("own"), "cases", "collections", "sources", "covered", "newer_status", "newer_cases", "newer_error")


@query("""SELECT CAST(pos AS INTEGER) AS pos, pos || ') ' || coalesce(number, 'بلا رقم') || ' — ' || coalesce(court, 'محكمة غير متوفرة') || chr(10) || 'المادة: ' || event_type || ' | التقييم: ' || coalesce(score, 0) || '/100' || chr(10) || 'التاريخ: ' || used AS line
FROM (SELECT event_type, CASE WHEN event_id % 3 > 0 THEN 'c' || event_id END AS number, CASE WHEN event_id % 2 = 0 THEN 'Court ' || user_id WHEN event_id % 5 = 0 THEN NULLIF('', '') END AS court, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS score, strftime(ts, '%Y-%m-%d') AS used, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS pos FROM events) WHERE pos <= 20""")
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty cases used, as the owner reads them."""
    i = F.col("event_id")
    used = table(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 3 > 0, F.concat(F.lit("c"), i)).alias("case_number"), F.when(i % 2 == 0, F.concat(F.lit("Court "), "user_id")).when(i % 5 == 0, "").alias("court_name"), F.col("event_type").alias("subject_slug"), F.when(i % 4 > 0, i % 100).alias("suitability_score"), F.date_format("ts", "yyyy-MM-dd").alias("used_at"))
    return reports.history_report(used)


@query("""WITH m AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS pos FROM (SELECT DISTINCT user_id FROM events WHERE user_id <> 7))
SELECT CAST(0 AS INTEGER) AS pos, '👑 المالك: 7' AS line UNION ALL SELECT pos, '• ' || user_id FROM m WHERE pos <= 50""")
def report_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.users_report(table(spark, sf_dir, "events").select("user_id"), 7)


_SOURCE_SQL = "CASE WHEN doc_id % 3 = 0 THEN source || '، المصدر الرسمي: https://x.example/' || doc_id % 2 WHEN doc_id % 3 = 1 THEN 'المصدر الرسمي: https://x.example/' || doc_id % 2 WHEN doc_id % 2 = 0 THEN source END"


@query(rf"""WITH d AS (SELECT *, {_SOURCE_SQL} AS verified FROM documents)
SELECT doc_id, 'T ' || doc_id AS title, CASE WHEN doc_id % 5 > 0 THEN 'رقم القضية=' || doc_id || ';' ELSE '' END || 'المحكمة=' || source AS metadata,
  CASE lang WHEN 'de' THEN 'ثالثاً: تحليل تسبيب المحكمة في ضوء المبادئ الأصولية' WHEN 'fr' THEN 'ثالثاً: تحليل تسبيب المحكمة في ضوء المبادئ والنصوص الإدارية' ELSE 'ثالثاً: تحليل تسبيب المحكمة' END || '=r' || doc_id AS third,
  'one|' || lang || CASE WHEN verified IS NOT NULL AND verified NOT IN ('one', lang) THEN '|' || verified ELSE '' END AS refs FROM d""")
def rendered_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document of a comment holds: title, metadata that is given, headings of its course, references each once."""
    i = F.col("doc_id")
    slug = F.when(F.col("lang") == "de", "usul_al_fiqh").when(F.col("lang") == "fr", "administrative_contracts").otherwise("trade_law")
    refs = F.array(F.lit(" one "), F.col("lang"), F.lit("  "), F.lit("one"), F.concat("lang", F.lit("\n")))
    drafts = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  T "), i, F.lit("\n")).alias("title"), slug.alias("subject_slug"), *(F.concat(F.lit(b[0] if b != "court_reasoning" else "r"), i).alias(b) for b in reports.BODIES), refs.alias("references"),
        F.when(i % 5 > 0, i).alias("case_number"), F.col("source").alias("court_name"), F.lit("").alias("judgment_year"), F.when((i % 3 == 0) | (i % 3 == 2) & (i % 2 == 0), F.col("source")).alias("source_name"), F.when(i % 3 < 2, F.concat(F.lit("https://x.example/"), i % 2)).alias("source_url"),
    )
    flat = lambda rows, a, b, sep: F.array_join(F.transform(rows, lambda x: F.concat(x[a], F.lit("="), x[b])), sep)
    return reports.rendered(drafts).select("doc_id", "title", flat(F.col("metadata"), "label", "value", ";").alias("metadata"), flat(F.slice("sections", 3, 1), "heading", "body", "").alias("third"), F.array_join("reference_list", "|").alias("refs"))


# configuration: a nation's row gives a record

_SLUG = "lower(replace(n_name, ' ', '-'))"


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 rows of nation, a table of fixed size."""
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _records(spark: SparkSession, sf_dir: str) -> list[tuple[str, dict]]:
    slug = lambda r: r["n_name"].replace(" ", "-").lower()
    return [(f"c/{slug(r)}.yaml", {"slug": slug(r), "relevance_mode": "methodological"} if r["n_nationkey"] % 5 == 0 else {"slug": slug(r), "search_keywords": [f"{r['n_name']} trade", "lease"], "priority_topics": ["sale"]}) for r in _nations(spark, sf_dir)]


_WORDS = "[w for w in string_split(lower(replace(n_name, '_', ' ')), ' ') if len(w) >= 4]"


@query(f"SELECT {_SLUG} AS slug, CASE WHEN n_nationkey % 5 = 0 THEN 'methodological' ELSE 'direct' END AS mode, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name || ' trade,lease' END AS keywords, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 8 ELSE 4 + len(list_distinct({_WORDS})) END AS INTEGER) AS n_terms, CASE WHEN n_regionkey = 1 THEN 'moj,r1' ELSE '' END AS preferred FROM nation")
def course_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked course records with the terms that search takes from them and their preferred sources."""
    records = profiles.profile_records(_records(spark, sf_dir))
    preferred = profiles.source_map({"subjects": {r["n_name"].replace(" ", "-").lower(): ["moj", f"r{r['n_regionkey']}"] for r in _nations(spark, sf_dir) if r["n_regionkey"] == 1} | {"none": None}})
    own = [profiles.course(records, r["slug"], preferred) for r in records]
    return spark.createDataFrame([(c.slug, c.mode, ",".join(c.keywords), len(retrieve.subject_terms(c)), ",".join(c.preferred)) for c in own], "slug string, mode string, keywords string, n_terms int, preferred string")


@query(f"SELECT {_SLUG} AS slug, CAST(row_number() OVER (PARTITION BY n_name ORDER BY i) - 1 AS INTEGER) AS pos, term FROM (SELECT n_name, unnest([n_name || ' trade', 'lease', 'sale'] || {_WORDS} || ['trade']) AS term, generate_subscripts([n_name || ' trade', 'lease', 'sale'] || {_WORDS} || ['trade'], 1) AS i FROM nation)")
def course_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, then their telling words, each once."""
    rows = [(r["n_name"].replace(" ", "-").lower(), i, t) for r in _nations(spark, sf_dir) for i, t in enumerate(retrieve.subject_terms(Course("c", keywords=(f"{r['n_name']} trade", "lease"), priority=("sale",))))]
    return spark.createDataFrame(rows, "slug string, pos int, term string")


@query(f"""SELECT {_SLUG} AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'numbered_pdf_series' ELSE 'landing_page_crawl' END AS kind, CAST(greatest(0, n_nationkey - 3) AS INTEGER) AS depth, CAST(greatest(1, n_nationkey * 10 - 20) AS INTEGER) AS pages,
CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS INTEGER) AS last, '/' || n_regionkey || '/' AS prefixes, CAST(greatest(100, n_regionkey * 60) AS INTEGER) AS least, CAST(greatest(1000, n_regionkey * 900) AS INTEGER) AS most, CAST(greatest(0, n_regionkey - 2) AS DOUBLE) AS delay FROM nation""")
def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a manifest for each region; limits are kept within sense."""
    rows = []
    for region in sorted({r["n_regionkey"] for r in _nations(spark, sf_dir)}):
        own = [r for r in _nations(spark, sf_dir) if r["n_regionkey"] == region]
        spec = lambda r: {"id": r["n_name"].replace(" ", "-").lower(), "source_id": "s", "max_depth": r["n_nationkey"] - 3, "max_pages": r["n_nationkey"] * 10 - 20, "allowed_path_prefixes": [f"/{r['n_regionkey']}/"]}
        kinds = [{"kind": "numbered_pdf_series", "volumes": {"start": 1, "end": r["n_nationkey"]}} if r["n_nationkey"] % 2 == 0 else {"kind": "landing_page_crawl"} for r in own]
        sources, limits = profiles.manifest({"sources": [spec(r) | k for r, k in zip(own, kinds, strict=True)], "min_case_text_chars": region * 60, "max_case_text_chars": region * 900, "request_delay_seconds": region - 2})
        rows += [(s.id, s.kind, s.max_depth, s.max_pages, s.last, ",".join(s.document_prefixes), limits["min_case_text_chars"], limits["max_case_text_chars"], limits["request_delay_seconds"]) for s in sources]
    return spark.createDataFrame(rows, "id string, kind string, depth int, pages int, last int, prefixes string, least int, most int, delay double")


@query("SELECT n_name AS policy, CASE WHEN n_nationkey % 3 = 0 THEN '40,20,' || n_nationkey || ',15,10' ELSE '40,20,15,15,10' END AS weights, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 ELSE 5 END AS INTEGER) AS margin, n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0 AS required FROM nation")
def scoring_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = lambda k: {"weights": {"reasoning_quality": k}, "selection": {"min_auto_accept_margin": k % 4, "require_score_margin_for_auto_accept": k % 2 == 0}} if k % 3 == 0 else {}
    rows = [(r["n_name"], ",".join(map(str, w.values())), margin, required) for r in _nations(spark, sf_dir) for w, margin, required in [profiles.scoring(given(r["n_nationkey"]))]]
    return spark.createDataFrame(rows, "policy string, weights string, margin int, required boolean")


@query("""SELECT n_name, CAST(CASE WHEN ok THEN n_nationkey * 5 END AS INTEGER) AS score, CAST(CASE WHEN ok THEN n_nationkey END AS INTEGER) AS pages, CASE WHEN ok THEN ['none', 'low', 'extreme', 'high', 'max'][n_regionkey + 1] END AS effort, CAST(CASE WHEN ok THEN 30 END AS INTEGER) AS ttl, NOT ok AS refused
FROM (SELECT *, n_nationkey BETWEEN 1 AND 20 AND n_regionkey <> 2 AS ok FROM nation)""")
def settings_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, then the environment, then what is given; values out of their range or set are refused."""
    rows, efforts = [], ["none", "low", "extreme", "high", "max"]
    for r in _nations(spark, sf_dir):
        env = {"MIZAN_AUTO_ACCEPT_SCORE": str(r["n_nationkey"] * 5), "MIZAN_PDF_MAX_PAGES": "20", "MIZAN_REASONING_EFFORT": f" {efforts[r['n_regionkey']].title()}"}
        try:
            s = load(env, pdf_max_pages=r["n_nationkey"])
            rows.append((r["n_name"], s.auto_accept_score, s.pdf_max_pages, s.reasoning_effort, s.reservation_ttl_minutes, False))
        except ValueError:
            rows.append((r["n_name"], None, None, None, None, True))
    return spark.createDataFrame(rows, "n_name string, score int, pages int, effort string, ttl int, refused boolean")


# prompts, drafts and answers


@query("""SELECT c_custkey, 'HEAD' || chr(10) || chr(10) || 'المادة:' || chr(10) || c_name || chr(10) || chr(10) || 'الموضوعات:' || chr(10) || '- عقد' || chr(10) || '- ' || c_mktsegment || chr(10) || chr(10) || 'أنماط القضايا المناسبة:' || chr(10) || '- نمط ' || c_custkey
 || chr(10) || chr(10) || 'كلمات البحث:' || chr(10) || '- تاجر' || chr(10) || chr(10) || 'ما يُتجنب:' || chr(10) || '- لا يوجد' || chr(10) || chr(10) || 'محاور التعليق:' || chr(10) || '- التسبيب' || chr(10) || chr(10) || 'قضايا مستبعدة:' || chr(10)
 || CASE WHEN c_custkey % 2 = 0 THEN 'لا توجد قضايا مستبعدة حتى الآن.' ELSE '- رقم القضية: ' || c_custkey || ' | المحكمة: محكمة | الرابط: غير متوفر' || chr(10) || '- رقم القضية: غير متوفر | المحكمة: غير متوفرة | الرابط: https://x.example/' || c_custkey END AS prompt FROM customer""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    case = lambda number, court, url: F.struct(number.cast("string").alias("case_number"), court.cast("string").alias("court_name"), url.cast("string").alias("source_url"))
    excluded = F.array(case(k, F.lit("محكمة"), F.lit("")), case(F.lit(None), F.lit(""), F.concat(F.lit("https://x.example/"), k)))
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("c").alias("slug"), F.col("c_name").alias("name"), F.array(F.lit("عقد"), "c_mktsegment").alias("topics"), F.array(F.lit("تاجر")).alias("keywords"), F.array().cast("array<string>").alias("avoid"),
        F.array(F.concat(F.lit("نمط "), k)).alias("suitable"), F.array(F.lit("التسبيب")).alias("focus"), F.when(k % 2 == 0, F.slice(excluded, 1, 0)).otherwise(excluded).alias("excluded"),
    )
    return workflow.research_prompt(requests, "HEAD").select("c_custkey", "prompt")


_DRAFTS = [
    ({}, ""), ({"title": " "}, "empty section"), ({"legal_issue": "**x{n}** AI"}, "forbidden: ** | markdown | ai reference"), ({"legal_issue": "*بند {n}"}, "markdown"), ({"legal_issue": "a * {n}"}, ""), ({"court_reasoning": "المادة 7{n}"}, "unsupported articles: 7{n}"),
    ({"court_reasoning": "القضية رقم 9{n}"}, "foreign case: 9{n}"), ({"court_reasoning": "القضية رقم 9{n}", "expected": None}, ""), ({"title": "ChatGPT {n}", "legal_issue": None}, "empty section | forbidden: ChatGPT"), ({"title": "paid {n}"}, ""),
]


@query(told_sql({"violations": ("VARCHAR", [v for _, v in _DRAFTS])}))
def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    sections = (_filled(k, [d.get(c, "نص سليم") for d, _ in _DRAFTS]).alias(c) for c in validate.SECTIONS)
    drafts = keys(spark, sf_dir).select("key", *sections, F.array(F.lit("r")).alias("references"), F.lit("المادة 87").alias("judgment_text"), _filled(k, [d.get("expected", "12{n}") for d, _ in _DRAFTS]).alias("expected_case_number"))
    return validate.violations(drafts).select("key", F.array_join("violations", " | ").alias("violations"))


_SAID = lambda kind, **more: json.dumps({"type": kind, **more})
_STREAMS = [
    ([(None, _SAID("response.output_text.delta", delta="He{n}")), (None, _SAID("response.output_text.delta", delta="y")), (None, _SAID("response.output_text.done", text="ignored")), (None, _SAID("response.completed", response={"status": "completed", "output_text": "Hey{n}"}))], "completed", "Hey{n}", 0, None),
    ([("response.output_text.done", json.dumps({"text": "only{n}"})), *[(None, _SAID("response.output_item.done", item=x)) for x in ({"id": "a{n}"}, {"id": "a{n}"}, {}, {})]], "completed", "only{n}", 3, None),
    ([(None, "{no {n}")], "error", None, 0, "invalid json"), ([(None, _SAID("ping"))], "error", None, 0, "no final response"),
    ([(None, _SAID("response.output_text.delta", delta="part{n}")), (None, _SAID("response.incomplete", response={"status": "incomplete"}))], "incomplete", "part{n}", 0, None),
]


@query(f"SELECT CAST(key AS VARCHAR) AS stream_id, status, text, n_items, error FROM ({told_sql({'status': ('VARCHAR', [s[1] for s in _STREAMS]), 'text': ('VARCHAR', [s[2] for s in _STREAMS]), 'n_items': ('INTEGER', [s[3] for s in _STREAMS]), 'error': ('VARCHAR', [s[4] for s in _STREAMS])})})")
def sse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items count once by id, those without one each; a done text counts only without pieces; the last terminal event wins."""
    k, most = F.col("key"), max(len(s[0]) for s in _STREAMS)
    at = lambda i, j: _filled(k, [s[0][i][j] if i < len(s[0]) else None for s in _STREAMS])
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), at(i, 0).alias("event"), at(i, 1).alias("data")) for i in range(most))))
    return stream.fold_batch(keys(spark, sf_dir).select(k.cast("string").alias("stream_id"), rows.alias("x")).where("x.data is not null").select("stream_id", "x.*"))


_EMPTY = [
    ('{"status": "incomplete", "output": [{"type": "reasoning"}, {"type": "web_search_call", "id": "w{n}"}, 5], "incomplete_details": {"reason": "max_{n}"}}', "The response did not contain output text (status=incomplete, output_types=['reasoning', 'web_search_call'], incomplete_reason=max_{n}, error=none)", "w{n}"),
    ('{"output": [{"type": "web_search_call", "id": "a{n}"}, {"type": "web_search_call", "id": "b"}, {"type": "message", "content": [{"type": "text", "text": "yes"}]}]}', None, "a{n},b"),
    ('{"error": {"code": "e{n}"}}', "The response did not contain output text (status=unknown, output_types=['none'], incomplete_reason=none, error=e{n})", ""),
    ('{"output_text": "direct {n}"}', None, ""), ("{broken {n}", "The response did not contain output text (status=unknown, output_types=['none'], incomplete_reason=none, error=none)", ""),
]


@query(told_sql({"why": ("VARCHAR", [e[1] for e in _EMPTY]), "calls": ("VARCHAR", [e[2] for e in _EMPTY])}))
def empty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an answer has no text, and the web searches that it made."""
    said = keys(spark, sf_dir).select("key", _filled(F.col("key"), [e[0] for e in _EMPTY]).alias("said"))
    calls = F.array_join(F.transform(validate.web_calls(F.col("said")), lambda x: F.try_variant_get(x, "$.id", "string")), ",")
    return said.select("key", validate.empty_response(F.col("said")).alias("why"), calls.alias("calls"))


@query("""SELECT role, CAST((rn - 1) % 200 + 1 AS INTEGER) AS page_no, sha256(text) AS text_sha256 FROM (SELECT role, replace(coalesce(text, ''), chr(12), ' ') AS text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations)""")
def pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as pages of documents, two hundred in a file, and read back by shares of each file."""
    path = own_folder(spark, "pages")
    said = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")).alias("text"))
    # a turn's place in its role: that in its range, behind the ranges before it
    said.repartitionByRange("role", "conv_id", "turn").withColumn("range", F.spark_partition_id()).write.parquet(ranges := own_folder(spark, "ranges"))
    said = spark.read.parquet(ranges)
    before = said.groupBy("role", "range").count().withColumn("before", F.sum("count").over(Window.partitionBy("role").orderBy("range")) - F.col("count"))  # a row a range
    place = F.row_number().over(Window.partitionBy("role", "range").orderBy("conv_id", "turn")) - 1
    placed = said.withColumn("place", place).join(F.broadcast(before.select(F.col("role").alias("r"), F.col("range").alias("k"), "before")), F.col("role").eqNullSafe(F.col("r")) & (F.col("range") == F.col("k")))
    placed = placed.select("role", "text", (F.col("place") + F.col("before")).alias("place")).withColumn("file", F.floor(F.col("place") / 200))
    rows = placed.repartition("role", "file").sortWithinPartitions("role", "place").select("role", "text")
    rows.write.partitionBy("role").option("lineSep", "\f").option("maxRecordsPerFile", 200).text(path)
    read = pages.read_pages(spark, path, suffix=".txt", bytesPerTask=10_000)
    return read.select(F.regexp_extract("path", "role=([^/]*)/", 1).alias("role"), "page_no", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT true AS promoted, count(*) FILTER (c_custkey % 5 > 0) AS cases, count(*) FILTER (c_custkey % 5 > 0) AS collections, count(DISTINCT c_mktsegment) FILTER (c_custkey % 5 > 0) AS sources,
count(*) AS seen, count(*) FILTER (c_custkey % 5 = 0) AS failed, CAST(1 AS BIGINT) AS covered, CAST(0 AS INTEGER) AS stats_code, CAST(1 AS INTEGER) AS coverage_code FROM customer""")
def catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over a store: a generation of the pages of all customers, every fifth without a header, behind the gate;
    then its stats, and its coverage, of which one of two courses is missing."""
    k, path = F.col("c_custkey"), own_folder(spark, "command")
    head = F.when(k % 5 == 0, F.lit("صفحة")).otherwise(_filled(k, [f"{LEGACY}\n{BODY}"]))
    dealt = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes in few tasks' files
    own = dealt.select(k.alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), head.alias("head"), F.concat(F.lit("https://x.example/"), k).alias("url"), F.col("c_mktsegment").alias("source_id"))
    pages_ = own.select("doc_id", "page_no", F.when(F.col("page_no") == 1, F.col("head")).otherwise(F.lit(BODY)).alias("text"), "url", "source_id", F.sha2("url", 256).alias("pdf_sha256"))
    store, course = CatalogStore(spark, f"{path}/store"), Course("trade", keywords=("عقد توريد",), priority=("تاجر",))
    promoted, _ = command.build(spark, store, pages_, [course], load({}))
    g = store.active()
    codes = command.main(["stats", store.base]), command.coverage_code(spark, store, [course, Course("none", keywords=("qqqq zzzz",))], load({}))
    stats = quality.catalog_stats(store.cases(g.generation_id))
    told = (F.lit(promoted).alias("promoted"), "cases", "collections", "sources", F.lit(g.documents_seen).cast("long").alias("seen"), F.lit(g.documents_failed).cast("long").alias("failed"), F.lit(g.covered_subjects).cast("long").alias("covered"))
    return stats.select(*told, F.lit(codes[0]).alias("stats_code"), F.lit(codes[1]).alias("coverage_code"))
