"""The table function over pages against the windows."""

import random

from pyspark.sql import functions as F

from mizan.operators import segment

PAGES = "doc_id int, page_no int, text string, number string"


def test_running_cases_equal_the_windows(spark):
    rnd = random.Random(4)
    body = lambda: rnd.choice([None, "", "  \n ", "short", "x" * 99, "y" * 100, "  " + "z" * 119, " \n" + "w" * 130 + "  ", "é " * 80])
    rows = [(d, p, body(), rnd.choice([None, "1", "1", "2", "3"])) for d in range(40) for p in range(1, rnd.randint(2, 14))]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    want = segment.case_ranges(pages)
    for most in (30, 150, 18_000):
        cut = F.substring(F.regexp_replace("text", f"^{segment.SPACE}+", ""), 1, most)
        got = segment.running_cases(pages, max_chars=most)
        keys = ["doc_id", "number", "page_start", "page_end", "text"]
        assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.withColumn("text", cut).select(*keys).collect()))


def test_a_document_of_very_many_pages(spark):
    n = 100_000
    pages = spark.range(1, n + 1, numPartitions=4).select(F.lit(7).alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.repeat(F.lit("page "), 40).alias("text"), F.when(F.col("id") == 1, F.lit("9")).alias("number"))
    got = segment.running_cases(pages).collect()
    assert [(r["number"], r["page_start"], r["page_end"], len(r["text"])) for r in got] == [("9", 1, n, 18_000)]
    assert segment.running_cases(pages.limit(0)).collect() == []
