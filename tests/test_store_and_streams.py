import json
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mizan.sources import crawl, profiles
from mizan.sources.store import CatalogStore, Generation
from mizan.streaming import events as stream

CASES = "collection_id string, catalog_key string, text string"


def some(spark, collection, n):
    return spark.createDataFrame([(collection, f"{collection}{i}", "t") for i in range(n)], CASES)


def test_generations(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    assert store.active() is None
    a = store.begin(6)
    with pytest.raises(ValueError, match="being built"):
        store.begin(6)
    with pytest.raises(ValueError, match="without cases"):
        store.promote(a)
    assert store.replace_collection(a, "x", some(spark, "x", 3)) == 3
    with pytest.raises(ValueError, match="another collection"):
        store.replace_collection(a, "x", some(spark, "y", 1))
    assert store.active() is None
    store.promote(a)
    assert store.active(6).generation_id == a.generation_id and store.active(5) is None
    b = store.begin(6)
    store.write_cases(b, some(spark, "x", 1).union(some(spark, "y", 2)))
    assert store.cases(a.generation_id).count() == 3 and store.cases(b.generation_id).count() == 3
    assert store.replace_collection(b, "y", some(spark, "y", 0)) == 0
    assert store.cases(b.generation_id).count() == 1
    store.finish(b, "failed", "x" * 2000, documents_seen=-3)
    assert store.active().generation_id == a.generation_id
    failed = next(g for g in store.states() if g.generation_id == b.generation_id)
    assert len(failed.last_error) == 1000 and failed.documents_seen == 0
    c = store.begin(6)
    store.replace_collection(c, "x", some(spark, "x", 2))
    store.promote(c)
    assert {g.generation_id: g.status for g in store.states()} == {a.generation_id: "superseded", b.generation_id: "failed", c.generation_id: "ready"}
    assert set(store.cleanup(0)) == {a.generation_id, b.generation_id} and store.cases(c.generation_id).count() == 2


def test_crashed_build_frees_its_lease(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    old = (datetime.now(timezone.utc) - timedelta(hours=7)).isoformat()
    store._put(Generation("old", 6, started_at=old, heartbeat_at=old))
    assert store.begin(6).status == "building"
    assert next(g for g in store.states() if g.generation_id == "old").status == "failed"


def test_one_of_two_builders_begins(spark, tmp_path):
    store, got = CatalogStore(spark, f"file://{tmp_path}/store"), []

    def begin():
        try:
            got.append(store.begin(6))
        except ValueError as e:
            got.append(str(e))

    for _ in range(3):
        threads = [threading.Thread(target=begin) for _ in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        won = [g for g in got if isinstance(g, Generation)]
        assert len(got) == 4 and len(won) == 1 and all("being built" in g for g in got if isinstance(g, str))
        store.finish(won[0], "failed", "x")
        got.clear()
    assert store.begin(6).status == "building"


def test_a_live_build_keeps_its_lease(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    g = store.begin(6)
    before = g.heartbeat_at
    with store.alive(g, timedelta(seconds=0.1)):
        until = time.time() + 30
        while time.time() < until and store.states()[0].heartbeat_at == before:
            time.sleep(0.1)
    assert store.states()[0].heartbeat_at > before
    store.finish(g, "failed", "x")
    assert store.heartbeat(g).status == "failed"


def test_document_records(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    g = store.begin(6)
    schema = "document_id string, status string, case_count int"
    assert store.documents(g.generation_id) is None and store.indexed(g, spark.createDataFrame([("a",)], "document_id string")).count() == 0
    store.write_documents(g, spark.createDataFrame([("a", "indexed", 3), ("b", "failed", -2), ("c", "failed", None)], schema))
    store.write_documents(g, spark.createDataFrame([("b", "indexed", 5)], schema))
    assert {tuple(r) for r in store.documents(g.generation_id).select("document_id", "status", "case_count").collect()} == {("a", "indexed", 3), ("b", "indexed", 5), ("c", "failed", 0)}
    assert [r[0] for r in store.indexed(g, spark.createDataFrame([("a",), ("z",)], "document_id string")).collect()] == ["a"]


EVENTS = [
    ("done", 1, None, {"type": "response.output_text.delta", "delta": "He"}), ("done", 2, None, {"type": "response.output_text.delta", "delta": "y"}), ("done", 3, None, {"type": "response.output_text.done", "text": "ignored"}),
    ("done", 4, None, {"type": "response.completed", "response": {"status": "completed", "output_text": "Hey"}}),
    ("open", 1, "response.output_text.done", {"text": "only"}), ("open", 2, None, {"type": "response.output_item.done", "item": {"id": "a"}}), ("open", 3, None, {"type": "response.output_item.done", "item": {"id": "a"}}), ("open", 4, None, {"type": "response.output_item.done", "item": {}}),
    ("bad", 1, None, "{no"), ("none", 1, None, {"type": "ping"}),
]
WANT = {"done": ("completed", "Hey", 0, None), "open": ("completed", "only", 2, None), "bad": ("error", None, 0, "invalid json"), "none": ("error", None, 0, "no final response")}


def rows():
    return [(s, n, e, d if isinstance(d, str) else json.dumps(d)) for s, n, e, d in EVENTS]


def test_fold_batch(spark):
    df = spark.createDataFrame(rows(), "stream_id string, seq int, event string, data string").repartition(3)
    got = {r["stream_id"]: (r["status"], r["text"], r["n_items"], r["error"]) for r in stream.fold_batch(df).collect()}
    assert got == WANT


def test_fold_of_one_stream_equals_batch():
    for name, want in WANT.items():
        fold = stream.Fold()
        for _, _, e, d in (r for r in rows() if r[0] == name):
            fold = stream.Fold(fold.kept)  # as the state is kept between batches
            fold.add(e, d)
        assert fold.outcome(name)[1:] == want


def test_sse_lines(spark):
    lines = ["event: x", 'data: {"a":', "data: 1}", "", ": comment", "", "data: last"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "stream_id string, line_no int, line string")
    got = [(r["event"], r["data"]) for r in stream.parse_sse(df).orderBy("seq").collect()]
    assert got == [("x", '{"a":\n1}'), (None, "last")]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("slug: a\nname_ar: ا\nsearch_keywords: [x, y]\n")
    (tmp_path / "b.yaml").write_text("slug: b\nrelevance_mode: methodological\n")
    df = profiles.profiles(spark, f"file://{tmp_path}/*.yaml")
    assert [(r["slug"], r["relevance_mode"], r["search_keywords"]) for r in df.orderBy("slug").collect()] == [("a", "direct", ["x", "y"]), ("b", "methodological", [])]
    records = profiles.profile_records(profiles.read_yaml(spark, f"file://{tmp_path}/*.yaml"))
    assert profiles.course(records, "a", {"a": ("s",)}).preferred == ("s",)
    with pytest.raises(KeyError):
        profiles.course(records, "zz")
    for bad in ([("x/c.yaml", {"slug": "d"})], [("x/c.yaml", {"slug": "c", "relevance_mode": "odd"})], [("x/c.yaml", {"slug": "c"}), ("y/c.yaml", {"slug": "c"})]):
        with pytest.raises(ValueError):
            profiles.profile_records(bad)


def test_manifest_limits():
    sources, limits = profiles.manifest({"sources": [{"id": "s", "source_id": "o", "kind": "numbered_pdf_series", "max_depth": -1, "max_pages": 0, "volumes": {"start": 1, "end": 2}}], "min_case_text_chars": 5, "max_case_text_chars": 5, "request_delay_seconds": -1})
    assert (sources[0].max_depth, sources[0].max_pages, sources[0].first, sources[0].last) == (0, 1, 1, 2)
    assert limits == {"min_case_text_chars": 100, "max_case_text_chars": 1000, "request_delay_seconds": 0.0}
    assert profiles.scoring({"weights": {"reasoning_quality": 7}})[0]["reasoning_quality"] == 7 and profiles.scoring({})[1:] == (5, True)


def test_crawl(spark):
    registry = profiles.registry(spark, {"sources": [{"id": "o", "role": "official", "domains": ["A.example"], "supports_direct_pdf": True}]})
    pages = spark.createDataFrame([
        ("https://a.example/j/0", '<a href="1">x</a> <a href="/forms/f.pdf"> "https:\\/\\/a.example\\/j\\/d0.pdf"'),
        ("https://a.example/j/1", '<a href="/j/2"><a href="d1.pdf?x=1"><a href="https://b.example/j/other.pdf"><a href="http://a.example/j/plain.pdf">'),
        ("https://a.example/j/2", '<a href="/j/d2.pdf"><a href="/j/3">'), ("https://a.example/j/3", '<a href="/j/d3.pdf">'),
    ], "url string, html string")
    source = profiles.Source("s", "o", "O", "landing_page_crawl", landing_pages=("https://a.example/j/0",), max_depth=2, page_prefixes=("/J/",), document_prefixes=("/j/",), excluded=("/forms/",))
    got = {r["url"].rpartition("/")[2] for r in crawl.crawl(pages, registry, source).collect()}
    assert got == {"d0.pdf", "d1.pdf?x=1"} | {"d2.pdf"}
    shallow = crawl.crawl(pages, registry, profiles.Source("s", "o", "O", "k", landing_pages=("https://a.example/j/0",), max_depth=0, document_prefixes=("/j/",)))
    assert {r["url"].rpartition("/")[2] for r in shallow.collect()} <= {"d0.pdf"}
    r = profiles.classify(pages.select("url").limit(1), registry).first()
    assert (r["domain"], r["is_official"], r["original_pdf"]) == ("a.example", True, True)


def test_changes(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "a")], "key string, at int, text string")
    assert [r["at"] for r in stream.changes(df).orderBy("at").collect()] == [1, 3, 4]
    assert df.where(F.lit(False)).count() == 0


RECORDS = "document_id string, status string, case_count int"


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    g = store.begin(6)
    many = spark.range(400).select(F.col("id").cast("string").alias("document_id"), F.lit("seen").alias("status"), F.lit(1).alias("case_count"))
    assert store.write_documents(g, many) == store.BUCKETS
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "documents").rglob("*.parquet")}
    assert store.write_documents(g, spark.createDataFrame([("7", "indexed", 9), ("new", "indexed", 2)], RECORDS)) <= 2
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "documents").rglob("*.parquet")}
    assert len(before.keys() & after.keys()) >= len(before) - 2 and all(before[p] == after[p] for p in before.keys() & after.keys())
    got = {r["document_id"]: (r["status"], r["case_count"]) for r in store.documents(g.generation_id).collect()}
    assert len(got) == 401 and got["7"] == ("indexed", 9) and got["new"] == ("indexed", 2) and got["8"] == ("seen", 1)
    assert store.write_documents(g, many.limit(0)) == 0
    # columns that records did not have before
    store.write_documents(g, spark.createDataFrame([("9", "failed", 0, "why")], RECORDS + ", note string"))
    assert {r["note"] for r in store.documents(g.generation_id).where("document_id IN ('9', '10')").collect()} == {"why", None}


def test_a_write_that_fails_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    g = store.begin(6)
    store.write_documents(g, spark.createDataFrame([("a", "seen", 1), ("b", "seen", 1)], RECORDS))

    def cut(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(store, "_write", cut)
        with pytest.raises(RuntimeError, match="cut off"):
            store.write_documents(g, spark.createDataFrame([("a", "indexed", 5), ("c", "indexed", 5)], RECORDS))
    assert {tuple(r) for r in store.documents(g.generation_id).select("document_id", "status").collect()} == {("a", "seen"), ("b", "seen")}
    store.write_documents(g, spark.createDataFrame([("a", "indexed", 5), ("c", "indexed", 5)], RECORDS))
    assert {tuple(r) for r in store.documents(g.generation_id).select("document_id", "status").collect()} == {("a", "indexed"), ("b", "seen"), ("c", "indexed")}


def stream_of(spark, path):
    return spark.readStream.schema(CASES).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_a_cut_off_batch_is_replayed(spark, tmp_path, monkeypatch):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    g = store.begin(6)
    batches = [[("x", "a", "1"), ("x", "b", "1")], [("x", "b", "2"), ("y", "c", "2")], [("z", "a", "3")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CASES).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    calls, record = [], store._record

    def cut(gen, batch_id):
        calls.append(batch_id)
        if calls == [0, 1]:  # the second batch has written its cases
            raise RuntimeError("cut off")
        record(gen, batch_id)

    monkeypatch.setattr(store, "_record", cut)
    q = store.build_from(g, stream_of(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp")
    with pytest.raises(Exception, match="cut off"):
        q.awaitTermination(120)
    assert [r[0] for r in store.staged(g).select("batch_id").distinct().collect()] == [0]
    with pytest.raises(ValueError, match="without cases"):
        store.promote(g)
    assert store.build_from(g, stream_of(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp").awaitTermination(120)
    assert calls == [0, 1, 1, 2]
    # all of it once more, as if the checkpoint were lost: nothing is taken twice
    assert store.build_from(g, stream_of(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/other").awaitTermination(120)
    assert calls == [0, 1, 1, 2]
    assert store.seal(g).status == "ready" and store.active().cases_indexed == 3
    assert {tuple(r) for r in store.cases(g.generation_id).select("collection_id", "catalog_key", "text").collect()} == {("z", "a", "3"), ("x", "b", "2"), ("y", "c", "2")}


def test_a_sealed_build_that_the_gate_refuses_is_not_read(spark, tmp_path):
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    a = store.begin(6)
    store.stage(a, some(spark, "x", 2), 0)
    store.seal(a)
    b = store.begin(6)
    with pytest.raises(ValueError, match="without cases"):
        store.seal(b)
    store.stage(b, some(spark, "x", 1), 0)
    refused = store.seal(b, lambda cases: f"only {cases.count()}" if cases.count() < 2 else None)
    assert (refused.status, refused.last_error) == ("failed", "only 1") and store.active().generation_id == a.generation_id
    assert store.begin(6).status == "building"
