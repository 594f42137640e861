"""Reservations of a key with very many requests."""

import random

from pyspark.sql import functions as F

from mizan.operators import identity


def test_a_key_of_many_requests_is_no_single_row(spark):
    n = 30_000
    many = spark.range(n).select(F.col("id").alias("request_id"), F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    odd = spark.sql("SELECT 900001L AS request_id, CAST(NULL AS STRING) AS key, timestamp_seconds(5) AS at UNION ALL SELECT 900002L, NULL, timestamp_seconds(6) UNION ALL SELECT 900003L, 'n', NULL UNION ALL SELECT 900004L, 'n', timestamp_seconds(9)")
    out = identity.reservations(many.union(odd))
    got = {r["request_id"]: r["granted"] for r in out.collect()}
    assert got == {i: i % 31 == 0 for i in range(n)} | {900001: True, 900002: False, 900003: True, 900004: True}
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_stretches_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), 1_700_000_000 + rnd.choice([0, 40_000, 90_000]) + rnd.randrange(0, 20_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, key string, s long").select("request_id", "key", F.timestamp_seconds("s").alias("at"))
    want, until = {}, {}
    for i, key, s in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = s > until.get(key, 0)
        until[key] = s + 1800 if want[i] else until[key]
    assert {r["request_id"]: r["granted"] for r in identity.reservations(df).collect()} == want
