"""Streams against their batch twins: out of order within the lateness, repeated, and split into any batches."""

import json
import random
import uuid
from datetime import datetime, timedelta

import pytest

from mizan.operators.identity import reservations
from mizan.streaming import events as stream
from mizan.streaming.reservations import reserve_stream

START = datetime(2024, 1, 1)
FAR = timedelta(days=30)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, rows, schema, make, seed=0, files=5, slack=20, sentinel=None):
    """(rows that the stream gives, rows left in its state); rows come by time, but for some slack, in so many batches, some of
    them twice. The sentinel, a row far ahead, moves the watermark over all."""
    rnd = random.Random(seed)
    place = [f.split()[0] for f in schema.split(", ")].index("at")
    mixed = sorted(rows + rnd.sample(rows, len(rows) // 5), key=lambda r: r[place].timestamp() + rnd.uniform(0, slack))
    path, name = f"{tmp_path}/{uuid.uuid4().hex}", "t" + uuid.uuid4().hex
    cuts = sorted(rnd.sample(range(len(mixed)), files - 1))
    parts = [mixed[a:b] for a, b in zip([0, *cuts], [*cuts, len(mixed)], strict=True)] + [[sentinel]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/{i:02d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name), q.lastProgress["stateOperators"][0]["numRowsTotal"]


REQUESTS = "request_id long, key string, at timestamp, release boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_reservations(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(i, f"k{rnd.randrange(4)}", at(rnd.randrange(4 * 3600)), False) for i in range(60)]
    rows += [(r[0], r[1], r[2] + timedelta(seconds=rnd.randrange(1, 2000)), True) for r in rows[::3]]  # given back, by those who hold it and by others
    want = {tuple(r) for r in reservations(spark.createDataFrame(rows, REQUESTS)).select("key", "request_id", "granted").collect()}
    got, left = run(spark, tmp_path, rows, REQUESTS, lambda s: reserve_stream(s, late="30 seconds"), seed, sentinel=(999, "end", START + FAR, False))
    found = [tuple(r) for r in got.select("key", "request_id", "granted").collect()]
    assert sorted(found) == sorted(want) and len(want) == 60 and {g for _, _, g in want} == {True, False}
    assert left == 1  # the sentinel


def test_reservations_given_back(spark):
    rows = [(1, "k", at(0), False), (2, "k", at(60), False), (2, "k", at(61), True), (3, "k", at(62), False), (1, "k", at(63), True), (4, "k", at(64), False), (5, "k", at(64 + 1800), False), (6, "k", at(65 + 1800), False)]
    got = {r["request_id"]: r["granted"] for r in reservations(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


EVENTS = "stream_id string, seq int, at timestamp, event string, data string"
END = ("end", 0, START + FAR, None, None)


def log(seed):
    rnd, rows = random.Random(seed), []
    said = lambda kind, **more: json.dumps({"type": kind, **more})
    for s in range(24):
        t, n = rnd.randrange(3000), rnd.randint(1, 8)
        for seq in range(n):
            t += rnd.choice([0.001, 1, 30, 170, 400]) if s % 2 else rnd.choice([0.001, 1, 30])
            pick = rnd.random()
            data = said("response.output_text.delta", delta=f"<{seq}>") if pick < 0.5 else said("response.output_text.done", text="done") if pick < 0.6 else said("response.output_item.done", item={"id": rnd.choice("ab")} if pick < 0.7 else {}) if pick < 0.8 else said("response.completed", response={"status": f"s{seq}"}) if pick < 0.93 else "{broken" if pick < 0.95 else None
            rows.append((f"s{s}", seq, at(t), None, data))
        if s % 3 == 0:
            rows.append((f"s{s}", n, at(t + 1), stream.CLOSED, None))
    return rows


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_outcomes(spark, tmp_path, seed):
    rows = log(seed)
    want = sorted((tuple(r) for r in stream.fold_batch(spark.createDataFrame(rows, EVENTS)).collect()), key=repr)
    got, left = run(spark, tmp_path, rows, EVENTS, lambda s: stream.fold_stream(s, late="30 seconds"), seed, sentinel=END)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and left == 1
    assert {r[4] for r in want} >= {None, "idle timeout"}


def test_a_closed_stream_gives_one_row(spark, tmp_path):
    done = json.dumps({"type": "response.completed", "response": {"status": "completed", "output_text": "first"}})
    again = json.dumps({"type": "response.failed", "response": {"status": "failed"}})
    rows = [("a", 1, at(0), None, done), ("a", 2, at(3), None, again), ("a", 3, at(90), None, done), ("a", 4, at(200), None, done), ("b", 1, at(0), None, done), ("b", 2, at(100), None, again)]
    got, left = run(spark, tmp_path, rows, EVENTS, lambda s: stream.fold_stream(s, late="30 seconds"), files=3, sentinel=END)
    assert sorted(tuple(r) for r in got.select("stream_id", "status", "text").collect()) == [("a", "failed", None), ("b", "completed", "first")] and left == 1
    assert sorted(r[0] for r in stream.fold_batch(spark.createDataFrame(rows, EVENTS)).select("status").collect()) == ["completed", "failed"]


def test_idle_times(spark, tmp_path):
    rows = [(f"s{i % 4}", at(random.Random(i).randrange(9000))) for i in range(150)]
    schema = "stream_id string, at timestamp"
    want = sorted(tuple(r) for r in stream.idle_times(spark.createDataFrame(rows, schema)).collect())
    distinct = {r for r in rows}
    assert sum(r[4] for r in want) == len(rows) and len(want) > 8
    got, left = run(spark, tmp_path, sorted(distinct), schema, lambda s: stream.idle_times(s, late="60 seconds"), sentinel=("end", START + FAR))
    assert sorted(tuple(r)[:4] for r in got.collect()) == [r[:4] for r in want] and left == 1


LINES = "stream_id string, line_no int, at timestamp, line string"


@pytest.mark.parametrize("seed", [6, 7])
def test_lines(spark, tmp_path, seed):
    rnd, rows = random.Random(seed), []
    for s in range(6):
        t = rnd.randrange(600)
        for i in range(40):
            t += rnd.choice([0, 0.01, 5, 60])
            rows.append((f"s{s}", i, at(t), rnd.choice(["", "", "event: a ", "event:b", "data: x", "data:  y z ", ": comment", "id: 3", None])))
    want = sorted((tuple(r) for r in stream.parse_sse(spark.createDataFrame(rows, LINES)).collect()), key=repr)
    got, left = run(spark, tmp_path, rows, LINES, lambda s: stream.parse_sse_stream(s, late="30 seconds"), seed, sentinel=("end", 0, START + FAR, "x"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and left == 1 and len(want) > 20


TICKS = "key string, seq int, at timestamp, text string"


@pytest.mark.parametrize("seed", [8, 9])
def test_shown_texts(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(f"k{i % 3}", i, at(rnd.choice([0, 0, 0, 4000]) + rnd.randrange(900)), rnd.choice(["one", "two", None])) for i in range(120)]
    batch = stream.shown(spark.createDataFrame(rows, TICKS), "10 seconds", "15 minutes")
    want = sorted((tuple(r) for r in batch.collect()), key=repr)
    got, left = run(spark, tmp_path, rows, TICKS, lambda s: stream.shown_stream(s, "10 seconds", "15 minutes", late="30 seconds"), seed, sentinel=("end", 0, START + FAR, "x"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and left == 1
    assert 3 < len(want) < len(rows)


def test_a_restart_gives_nothing_twice(spark, tmp_path):
    """The same folder read by two runs of one query: what the first run waited for comes out in the second, once."""
    rows = [(i, f"k{i % 3}", at(i * 100), False) for i in range(40)]
    want = sorted(tuple(r) for r in reservations(spark.createDataFrame(rows, REQUESTS)).select("key", "request_id", "granted").collect())
    found = []
    for k, part in enumerate([rows[:15], rows[15:], [(999, "end", START + FAR, False)]]):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        out = reserve_stream(spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in/*"), late="30 seconds")
        q = out.writeStream.foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.select("key", "request_id", "granted").collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(found) == want
