"""A refresh whose pages' files are small and whose texts are not."""

import random
import re

from pyspark.sql import functions as F

from mizan import __main__ as command
from mizan.config import load
from mizan.functions import headers, text
from mizan.plans.derived import BODY, LEGACY, MODERN
from mizan.sources.store import CatalogStore


def test_no_case_or_document_is_broadcast(spark, tmp_path, monkeypatch):
    rows = [(d, p, LEGACY.replace("{n}", str(100 + d)) + "\n" + BODY if p == 1 and d % 4 else BODY, f"https://x.example/{d}", "s", "0" * 64) for d in range(30) for p in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, page_no int, text string, url string, source_id string, pdf_sha256 string").write.parquet(str(tmp_path / "pages"))
    plans, put = [], CatalogStore._replace

    def told(self, name, df, key, gone=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, name, df, key, gone)

    monkeypatch.setattr(CatalogStore, "_replace", told)
    store = CatalogStore(spark, str(tmp_path / "store"))
    assert command.build(spark, store, spark.read.parquet(str(tmp_path / "pages")), [], load({})) == (True, "")
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    g = store.active()
    assert (g.documents_seen, g.documents_failed, g.cases_indexed) == (30, 8, 22)


def test_ends_lose_what_python_strips(spark):
    said = [f"{a}x{b}y{c}" for a in text.SPACES for b in ("", " \n") for c in (text.SPACES, "\n", "\r\n", a)] + ["", " ", text.SPACES, "​x﻿", "é ", None]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.strip(F.col("t"))).collect()
    assert [r for r in got if r[1] != (r[0] if r[0] is None else r[0].strip())] == []


def test_courts_are_those_of_the_patterns(spark):
    rnd, words = random.Random(5), ["المحكمة", "محكمة", "الدائرة", "دائرة", "لجنة", "اللجنة", "العامة", "التجارية", "الفصل", "الأحوال", "الشخصية", "بالرياض", ".", "\n", "  ", "x"]
    said = ["", None, *(" ".join(rnd.choices(words, k=rnd.randrange(1, 12))) for _ in range(400)), "x " * 3994 + "محكمة التجارية بجدة", "x " * 4010 + "محكمة التجارية"]

    def want(t):
        sample = " ".join(t[:8000].split())
        found = (m[1] for p in text.COURT_PATTERNS if (m := re.search(p, sample)))
        return next((x.strip(text.EDGE)[:180] for x in found), None)

    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.detect_court(F.col("t"))).collect()
    assert [r for r in got if r[1] != (None if r[0] is None else want(r[0]))] == []
    assert len({r[1] for r in got}) > 50


def test_the_number_alone_is_that_of_the_metadata(spark):
    forms = (LEGACY, MODERN, BODY, f"{BODY * 6}\n{LEGACY}", f"x\nرقم الدعوى: 12/1440 ه\n{BODY}", "رقم القضية: 77{n}\n" + MODERN, "\n".join(x[::-1] for x in LEGACY.splitlines()), "", "x", None)
    said = [t and t.replace("{n}", "345").replace("{o}", "45").replace("{a}", "٣٤٥") for t in forms]
    got = spark.createDataFrame([(t,) for t in said], "t string").select(headers.judgment_number("t"), headers.judgment_metadata("t")["case_number"]).collect()
    assert [r for r in got if r[0] != r[1]] == [] and len({r[0] for r in got}) > 2
