"""Pages of files as a data source: shares of a file, streams, engines that fail."""

import os
import random

from pyspark.sql import functions as F

from mizan.sources import pages


class Failing:
    def count(self, file):
        raise ValueError("no such format")

    def read(self, file, first, last):
        raise AssertionError


class Lines:
    """Another engine: a line is a page."""

    def count(self, file):
        return len(file.read().splitlines())

    def read(self, file, first, last):
        file.seek(0)
        yield from (x.decode() for x in file.read().splitlines()[first - 1 : last])


def written(tmp_path, texts):
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    return f"file://{tmp_path}"


def want(texts):
    out = set()
    for name, text in texts.items():
        parts = text.split("\f")
        parts = parts[:-1] if parts[-1] == "" else parts
        out |= {(name, i, p) for i, p in enumerate(parts, 1)}
    return out


def test_pages_of_text_files(spark, tmp_path):
    rnd = random.Random(1)
    texts = {f"d{i}.txt": "\f".join("é" * rnd.randrange(40) for _ in range(rnd.randrange(30))) + rnd.choice(["", "\f"]) for i in range(12)} | {"empty.txt": "", "one.txt": "a", "ends.txt": "a\f", "gap.txt": "\f\fx"}
    path = written(tmp_path, texts)
    (tmp_path / "other.bin").write_bytes(b"x\fy")
    for size in (10, 200, 1 << 20):
        got = [(os.path.basename(r["path"]), r["page_no"], r["text"]) for r in pages.read_pages(spark, path, suffix=".txt", bytesPerTask=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want(texts)


def test_blocks_end_anywhere(tmp_path, monkeypatch):
    monkeypatch.setattr(pages.PagedText, "BLOCK", 3)
    text = "ab\fcdefg\f\fh\fijklmnop"
    (tmp_path / "x").write_text(text)
    engine, parts = pages.PagedText(), text.split("\f")
    with (tmp_path / "x").open("rb") as f:
        assert engine.count(f) == 5
        for a in range(1, 6):
            for b in range(a, 6):
                assert list(engine.read(f, a, b)) == parts[a - 1 : b]


def test_a_huge_file_is_read_by_several_tasks(spark, tmp_path):
    n = 20_000
    path = written(tmp_path, {"huge.txt": "\f".join(f"{i} " + "x" * 1000 for i in range(1, n + 1))})
    df = pages.read_pages(spark, path, bytesPerTask=4 << 20).withColumn("task", F.spark_partition_id())
    by_task = df.groupBy("task").agg(F.count("*").alias("n"), F.min("page_no").alias("a"), F.max("page_no").alias("b")).collect()
    assert len(by_task) == 5 and sum(r["n"] for r in by_task) == n and all(r["b"] - r["a"] + 1 == r["n"] for r in by_task)
    assert df.where(~F.col("text").startswith(F.concat("page_no", F.lit(" ")))).isEmpty()


def test_engines(spark, tmp_path):
    path = written(tmp_path, {"a.txt": "x\ny\nz"})
    assert pages.read_pages(spark, path, engine=f"{__name__}:Failing").collect() == []
    assert [(r["page_no"], r["text"]) for r in pages.read_pages(spark, path, engine=f"{__name__}:Lines", bytesPerTask=2).orderBy("page_no").collect()] == [(1, "x"), (2, "y"), (3, "z")]


def test_a_stream_reads_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for k, texts in enumerate([{"a.txt": "1\f2"}, {}, {"b.txt": "3\f", "c.txt": "4"}]):
        for name in texts:
            written(tmp_path / "in", {name: texts[name]})
            os.utime(tmp_path / "in" / name, (1_700_000_000 + k, 1_700_000_000 + k))
        df = pages.read_pages(spark, f"file://{tmp_path}/in", stream=True, bytesPerTask=1)
        q = df.writeStream.foreachBatch(lambda d, _: seen.extend((os.path.basename(r["path"]), r["page_no"], r["text"]) for r in d.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(seen) == [("a.txt", 1, "1"), ("a.txt", 2, "2"), ("b.txt", 1, "3"), ("c.txt", 1, "4")]
