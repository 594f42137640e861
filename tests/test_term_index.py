"""Searches through the posting table against searches of all cases, and what they read."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mizan.operators import retrieve
from mizan.sources import term_index
from mizan.sources.store import CatalogStore
from mizan.sources.term_index import TermIndex, grams

CASES = "catalog_key string, normalized_text string, source_id string, case_number string, court_name string, indexed_at int, collection_id string"


def rows(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    text = lambda: rnd.choice([" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), "", None, "zz"])
    return [(f"k{i}", text(), rnd.choice(["s1", "s2"]), rnd.choice(["1", None]), "c", i % 50, "x") for i in range(n)], words


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    own, words = rows(600)
    df = spark.createDataFrame(own, CASES).cache()
    out = TermIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", parts=16)
    out.write(df)
    return df, words, out


def test_search_equals_a_reading_of_all(spark, index):
    df, words, own = index
    rnd = random.Random(2)
    for terms in [[w] for w in words[:6]] + [rnd.sample(words, 3) for _ in range(4)] + [[words[7][1:5] + " " + words[8]], ["nowhere"], ["zz"], [], ["x"]]:
        want = [tuple(r) for r in retrieve.search(df, terms, ("s1",), 10).select("catalog_key", "match_score").collect()]
        got = [tuple(r) for r in own.search(terms, ("s1",), 10).select("catalog_key", "match_score").collect()]
        assert got == want, terms


def test_a_rare_term_reads_little(spark, index):
    df, words, own = index
    counts = {w: df.where(F.contains(F.col("normalized_text"), F.lit(w))).count() for w in words[:40] if len(w) >= 5}
    rare = min((w for w in counts if counts[w]), key=counts.get)
    found = own.candidates([rare])
    assert counts[rare] <= found.count() <= counts[rare] + 5
    every = [f for f in spark.read.parquet(f"{own.base}/cases").inputFiles()]
    touched = [f for f in found.inputFiles() if "/cases/" in f]
    assert len(touched) <= found.count() < len(every) and all("/bucket=" in f for f in touched)


def test_grams():
    assert grams("abcd") == {"abc", "bcd"} and grams("ab") == set() and grams("") == set()


def test_store_search(spark, tmp_path):
    own, words = rows(80)
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    assert store.search(["a"]) is None
    g = store.begin(6)
    with pytest.raises(ValueError, match="without cases"):
        store.index_terms(g)
    store.write_cases(g, spark.createDataFrame(own, CASES))
    store.promote(g)
    terms = words[:4]
    before = [r["catalog_key"] for r in store.search(terms).collect()]
    store.index_terms(g)
    assert [r["catalog_key"] for r in store.search(terms).collect()] == before and before


def test_a_run_has_one_row_for_each_gram(spark, index):
    """Rows that are shuffled are those of runs of cases; each case is in the list of each of its grams, once."""
    df, _, own = index
    cases, postings = spark.read.parquet(f"{own.base}/cases"), spark.read.parquet(f"{own.base}/postings")
    place = F.shiftleft("block", term_index.BLOCK) + F.col("offset")
    told = postings.select("gram", "bucket", "block", F.explode("offsets").alias("offset")).select("gram", "bucket", place.alias("place"))
    got = told.join(cases, ["bucket", "place"]).select("gram", "catalog_key").collect()
    want = {(g, r["catalog_key"]) for r in df.collect() for g in grams(r["normalized_text"] or "")}
    assert len(got) == told.count() == len(want) and {tuple(r) for r in got} == want
    assert cases.select("place").distinct().count() == 600
    assert postings.count() == postings.select("gram", "bucket", "block").distinct().count() < len(want)
    assert {r["gram"]: r["n"] for r in spark.read.parquet(f"{own.base}/grams").collect()} == Counter(g for g, _ in want)


def test_runs_end_with_their_block_and_size(monkeypatch):
    """Blocks, buckets and a full run each begin new rows; characters beyond 16 bits and empty texts."""
    texts = [(0, 32766, "abcd"), (0, 32767, "abc"), (0, 32768, "abc"), (1, 1 << 33, "😀bc😀"), (1, (1 << 33) + 5, None), (1, (1 << 33) + 6, "xx"), (1, (1 << 33) + 7, "abcabc"), (1, (1 << 33) + 8, "bca")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "place", "text"])
    want = sorted((g, b, p) for b, p, t in texts for g in grams(t or ""))
    for most in (1, 4, 1 << 20):
        monkeypatch.setattr(term_index, "RUN", most)
        got = [r for x in term_index.postings_of(iter([batch(texts[:2]), batch(texts[2:4]), batch(texts[4:])])) for r in x.to_pylist()]
        assert sorted((r["gram"], r["bucket"], (r["block"] << 15) + o) for r in got for o in r["offsets"]) == want
        assert all(r["n"] == len(r["offsets"]) for r in got)
    assert [r["offsets"] for r in got if r["gram"] == "abc"] == [[32766, 32767], [0], [7]]
    assert list(term_index.postings_of(iter([batch([(0, 0, "ab")])]))) == []
