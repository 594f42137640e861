"""The first of equal documents where rows are repeated, or lack a text or an id."""

from pyspark.sql import functions as F

from mizan.operators import identity
from mizan.plans import catalog


def test_odd_documents_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "a"), (1, "a"), (2, "a"), (3, ""), (4, ""), (5, None), (None, "b"), (None, "b"), (None, "c"), (6, "c"), (6, "d"), (7, " "), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["dedup_keep_first"](spark, str(tmp_path)).select("pdf_sha256", "doc_id").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(catalog.oracle_sql()["dedup_keep_first"]).fetchall(), key=repr)


def test_one_row_of_a_key_stays_whole(spark):
    rows = [(2, "k", "x"), (1, "k", "y"), (1, "k", "y"), (None, "k", "z"), (None, "n", "w"), (None, "n", "w"), (8, None, "u"), (8, None, "u"), (9, "", "v")]
    df = spark.createDataFrame(rows, "id long, key string, said string")
    want = [(1, "k", "y"), (8, None, "u"), (8, None, "u"), (9, "", "v"), (None, "n", "w")]
    assert sorted(map(tuple, identity.keep_first(df, [F.col("key")], "id").collect()), key=repr) == want


def test_a_case_sent_twice_at_once_is_recorded_once(spark):
    kind = "id long, case_number string, court_name string, pdf_sha256 string"
    new = spark.createDataFrame([(1, "1", "Court", "a" * 64)] * 2 + [(2, None, None, "b" * 64)] * 2, kind)
    assert sorted(r["id"] for r in identity.insertable(new, new.limit(0).drop("id"), "id").collect()) == [1, 2]
