"""Event streams folded into one response, line protocols, changed texts and idle times: as batches and as streams.

Rows (stream_id, seq, event, data): data is the JSON of one event. The last completed, incomplete or failed event with a
response gives the result; without one the text pieces and finished items make it; with neither, or with data that is no
JSON, the stream ends in an error.

A log of live streams also has ``at``, the time of each event, and one definition for batch and stream: a stream closes
LINGER after its first terminal event, or once IDLE has passed without an event; what comes after that, until it
has idled, belongs to no outcome. An event CLOSED says that the connection ended; without it and without a terminal event, the stream ended by idling, an error.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import OrderedFold, apart, in_order, micros

TERMINAL = ("response.completed", "response.incomplete", "response.failed")
CLOSED = "connection.closed"
OUTCOME = "stream_id string, status string, text string, n_items int, error string"
IDLE, LINGER, LATE = "180 seconds", "5 seconds", "60 seconds"


class Fold:
    """What is known of a stream so far; small, whatever its length but for its own text and items."""

    def __init__(self, kept: str | None = None):
        self.text, self.items, self.ids, self.final, self.error, self.ended = "", 0, [], None, None, False
        if kept:
            self.text, self.items, self.ids, self.final, self.error, self.ended = json.loads(kept)

    def add(self, name: str | None, data: str | None) -> None:
        self.ended = self.ended or name == CLOSED
        if self.error or not data:
            return
        try:
            event = json.loads(data)
        except ValueError:
            self.error = "invalid json"
            return
        if not isinstance(event, dict):
            return
        kind = event.get("type") or event.get("event") or name
        if kind == "response.output_text.delta" and isinstance(event.get("delta"), str):
            self.text += event["delta"]
        elif kind == "response.output_text.done" and isinstance(event.get("text"), str) and not self.text:
            self.text = event["text"]
        elif kind == "response.output_item.done" and isinstance(event.get("item"), dict):
            own = str(event["item"].get("id") or "")
            if not own or own not in self.ids:
                self.items += 1
                self.ids += [own] if own else []
        elif kind in TERMINAL and isinstance(event.get("response"), dict):
            self.final = event["response"]

    @property
    def kept(self) -> str:
        return json.dumps([self.text, self.items, self.ids, self.final, self.error, self.ended])

    def outcome(self, stream_id: str) -> tuple:
        if self.error:
            return stream_id, "error", None, 0, self.error
        if self.final is not None:
            return stream_id, str(self.final.get("status") or "completed"), self.final.get("output_text") or self.text or None, self.items, None
        if self.text or self.items:
            return stream_id, "completed", self.text or None, self.items, None
        return stream_id, "error", None, 0, "no final response"


def _read(events: DataFrame) -> tuple[Column, Column]:
    """(the event, its kind)"""
    e = F.from_json("data", "type string, event string, delta string, text string, item struct<id:string>, response struct<status:string,output_text:string>")
    return e, F.coalesce(e["type"], e["event"], F.col("event"))


def counted(events: DataFrame, idle: str = IDLE, linger: str = LINGER) -> DataFrame:
    """Events of a log with ``stretch``: a stream that speaks again after it has idled begins another one. Those after the
    stretch's close are left out."""
    e, kind = _read(events)
    ends = F.coalesce((kind.isin(*TERMINAL) & e["response"].isNotNull()) | (F.col("event") == CLOSED), F.lit(False))
    order = lambda *keys: Window.partitionBy("stream_id", *keys).orderBy("at", "seq")
    timed = events.where(F.col("stream_id").isNotNull() & F.col("at").isNotNull())
    gap = F.coalesce(apart(F.col("at"), F.lag("at").over(order()), idle), F.lit(False))
    dealt = timed.withColumn("__gap", gap.cast("int")).withColumn("stretch", F.sum("__gap").over(order()))
    end = F.min(F.when(ends, F.col("at"))).over(order("stretch"))
    return dealt.withColumn("__end", end).where(F.col("__end").isNull() | ~apart(F.col("at"), F.col("__end"), linger)).drop("__gap", "__end")


def fold_batch(events: DataFrame, idle: str = IDLE, linger: str = LINGER) -> DataFrame:
    """An outcome for each stream; built in, but that invalid JSON is told by try_parse_json. With ``at``: as a log of live
    streams, one for each stretch; repeated rows count once."""
    live = "at" in events.columns
    if live:
        events = counted(events.dropDuplicates(["stream_id", "at", "seq", "event", "data"]), idle, linger)
    else:
        events = events.withColumn("at", F.lit(0)).withColumn("stretch", F.lit(0))
    e, kind = _read(events)
    ok = F.try_parse_json("data").isNotNull() | F.col("data").isNull() | (F.col("data") == "")
    read = events.select("stream_id", "stretch", F.struct("at", "seq").alias("place"), ok.alias("ok"), kind.alias("kind"), e.alias("e"), (F.col("event").eqNullSafe(CLOSED) if live else F.lit(True)).alias("closed"))
    one = F.struct("place", "kind", F.col("e.delta").alias("delta"), F.col("e.text").alias("text"), F.col("e.item.id").alias("id"), F.col("e.item").isNotNull().alias("has_item"), F.col("e.response").alias("r"))
    sorted_ = F.array_sort(F.collect_list(one))
    grouped = read.groupBy("stream_id", "stretch").agg(F.every("ok").alias("ok"), F.some("closed").alias("closed"), sorted_.alias("es"))
    of = lambda kind: F.filter("es", lambda x: x["kind"] == kind)
    deltas = F.array_join(F.transform(of("response.output_text.delta"), lambda x: F.coalesce(x["delta"], F.lit(""))), "")
    # a done text counts only where no piece came before it
    first_delta = F.array_min(F.transform(F.filter(of("response.output_text.delta"), lambda x: F.coalesce(x["delta"], F.lit("")) != ""), lambda x: x["place"]))
    done = F.get(F.filter(of("response.output_text.done"), lambda x: (F.coalesce(x["text"], F.lit("")) != "") & F.coalesce(x["place"] < first_delta, F.lit(True))), F.lit(0))["text"]
    ids = F.transform(F.filter(of("response.output_item.done"), lambda x: x["has_item"]), lambda x: F.coalesce(x["id"], F.lit("")))
    n_items = F.size(F.array_distinct(F.filter(ids, lambda x: x != ""))) + F.size(F.filter(ids, lambda x: x == ""))
    final = F.element_at(F.filter("es", lambda x: x["kind"].isin(*TERMINAL) & x["r"].isNotNull()), -1)["r"]
    parts = grouped.select("stream_id", "ok", "closed", F.nullif(F.concat(F.coalesce(done, F.lit("")), deltas), F.lit("")).alias("said"), n_items.alias("n_items"), F.when(F.size(F.filter("es", lambda x: x["kind"].isin(*TERMINAL) & x["r"].isNotNull())) > 0, final).alias("final"))
    timed_out = F.col("final").isNull() & ~F.col("closed")
    some = F.col("said").isNotNull() | (F.col("n_items") > 0)
    status = F.when(~F.col("ok") | timed_out, "error").when(F.col("final").isNotNull(), F.coalesce("final.status", F.lit("completed"))).when(some, "completed").otherwise("error")
    error = F.when(~F.col("ok"), "invalid json").when(timed_out, "idle timeout").when(F.col("final").isNull() & ~some, "no final response")
    text = F.when(F.col("ok") & ~timed_out, F.coalesce(F.nullif(F.col("final.output_text"), F.lit("")), F.col("said")))
    return parts.select("stream_id", status.alias("status"), text.alias("text"), F.when(F.col("ok"), F.col("n_items")).otherwise(0).cast("int").alias("n_items"), error.alias("error"))


def fold_stream(events: DataFrame, idle: str = IDLE, linger: str = LINGER, late: str = LATE) -> DataFrame:
    """A streaming DataFrame of the outcomes that fold_batch gives for the same events: one row for each stretch of a stream,
    once the watermark has passed its close. A stretch that closed stays marked until it has idled, so that a late or repeated
    event opens no second one."""
    idle_us, linger_us = micros(idle), micros(linger)

    class Live(OrderedFold):
        """due: first the time of the close, then of forgetting."""

        def __init__(self, key: str, kept: list | None = None):
            self.fold, self.last, self.end, self.told = Fold(), 0, None, False
            super().__init__(key, kept)

        def add(self, at: int, row: dict) -> list[tuple]:
            self.last = at
            if self.told:
                self.due = at + idle_us
                return []
            self.fold.add(row.get("event"), row.get("data"))
            if self.end is None and (self.fold.final is not None or self.fold.ended):
                self.end = at
            self.due = at + idle_us if self.end is None else min(at + idle_us, self.end + linger_us)
            return []

        def close(self) -> list[tuple]:
            if self.told:
                self.fold, self.last, self.end, self.told, self.due = Fold(), 0, None, False, None
                return []
            self.told, self.due = True, self.last + idle_us
            f = self.fold
            if not (f.error or f.final is not None or f.ended):
                return [(self.key, "error", None, f.items, "idle timeout")]
            return [f.outcome(self.key)]

        def kept(self) -> list:
            return [None if self.told else self.fold.kept, self.last, self.end, self.told]

        def restore(self, kept: list) -> None:
            fold, self.last, self.end, self.told = kept
            self.fold = Fold(fold)

    return in_order(events, "stream_id", "at", "seq", ["event", "data"], Live, OUTCOME, late)


def idle_times(events: DataFrame, idle: str = IDLE, late: str | None = None) -> DataFrame:
    """events (stream_id, at) -> (stream_id, began, last, timed_out, n_events) of each stretch without a longer pause: it times
    out at timed_out. One definition for batch and stream; on a stream give ``late``, and rows come when that time has passed."""
    timed = events if late is None else events.withWatermark("at", late)
    stretch = timed.groupBy("stream_id", F.session_window("at", idle).alias("w")).agg(F.min("at").alias("began"), F.max("at").alias("last"), F.count("*").alias("n_events"))
    return stretch.select("stream_id", "began", "last", F.col("w.end").alias("timed_out"), "n_events")


def parse_sse(lines: DataFrame) -> DataFrame:
    """lines (stream_id, line_no, line) -> events (stream_id, seq, event, data): fields between blank lines; comments and
    unknown fields count for nothing."""
    order = Window.partitionBy("stream_id").orderBy("line_no")
    block = F.sum((F.col("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = lines.withColumn("block", F.coalesce(block, F.lit(0)))
    data = F.array_sort(F.collect_list(F.when(F.col("line").startswith("data:"), F.struct("line_no", F.ltrim(F.expr("substring(line, 6)")).alias("t")))))
    name = F.max_by(F.when(F.col("line").startswith("event:"), F.trim(F.expr("substring(line, 7)"))), F.when(F.col("line").startswith("event:"), F.col("line_no")))
    grouped = kept.groupBy("stream_id", "block").agg(name.alias("event"), data.alias("d"))
    return grouped.where(F.size("d") > 0).select("stream_id", F.col("block").alias("seq"), "event", F.array_join(F.transform("d", lambda x: x["t"]), "\n").alias("data"))


def parse_sse_stream(lines: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """lines (stream_id, line_no, at, line) -> the events that parse_sse gives, as a stream. State is the open block; a stream
    that has idled is over, and its open block ends there."""
    idle_us = micros(idle)

    class Block(OrderedFold):
        def __init__(self, key: str, kept: list | None = None):
            self.seq, self.event, self.data = 0, None, []
            super().__init__(key, kept)

        def flush(self) -> list[tuple]:
            out = [(self.key, self.seq, self.event, "\n".join(self.data))] if self.data else []
            self.seq, self.event, self.data = self.seq + 1, None, []
            return out

        def add(self, at: int, row: dict) -> list[tuple]:
            self.due, line = at + idle_us, row.get("line")
            if line == "":
                return self.flush()
            if line and line.startswith("event:"):
                self.event = line[6:].strip(" ")
            elif line and line.startswith("data:"):
                self.data.append(line[5:].lstrip(" "))
            return []

        def close(self) -> list[tuple]:
            self.due = None
            return self.flush()

        def kept(self) -> list:
            return [self.seq, self.event, self.data]

        def restore(self, kept: list) -> None:
            self.seq, self.event, self.data = kept

    return in_order(lines, "stream_id", "at", "line_no", ["line"], Block, "stream_id string, seq int, event string, data string", late)


#: After so long without a tick a text counts as new.
FORGET = "1 day"


def changes(ticks: DataFrame) -> DataFrame:
    """ticks (key, at, text) -> those whose text is not that of the tick before."""
    before = F.lag("text").over(Window.partitionBy("key").orderBy("at"))
    return ticks.withColumn("__before", before).where(~F.col("text").eqNullSafe(F.col("__before"))).drop("__before")


def shown(ticks: DataFrame, every: str, forget: str = FORGET) -> DataFrame:
    """ticks (key, at, seq, text) -> (key, at, text): at the end of each interval the last text in it, where it is not that shown
    before, or that was shown more than ``forget`` before the interval."""
    length, keep = micros(every), micros(forget)
    slot = F.expr(f"unix_micros(at) div {length}")
    timed = ticks.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    last = timed.groupBy("key", slot.alias("slot")).agg(F.max_by("text", F.struct("at", "seq")).alias("text"), F.min(F.unix_micros("at")).alias("first"))
    order = Window.partitionBy("key").orderBy("slot")
    ends = F.lag((F.col("slot") + 1) * length).over(order)
    told = last.withColumn("__same", F.col("text").eqNullSafe(F.lag("text").over(order)) & (F.col("first") - ends <= keep))
    return told.where(~F.coalesce("__same", F.lit(False))).select("key", F.timestamp_micros(((F.col("slot") + 1) * length).cast("long")).alias("at"), "text")


def shown_stream(ticks: DataFrame, every: str, forget: str = FORGET, late: str = LATE) -> DataFrame:
    """What shown() gives, as a stream: by time, not by rows. State is the text of the open interval and the one shown."""
    length, keep = micros(every), micros(forget)

    class Ticker(OrderedFold):
        def __init__(self, key: str, kept: list | None = None):
            self.text, self.end, self.shown = None, None, None
            super().__init__(key, kept)

        def add(self, at: int, row: dict) -> list[tuple]:
            self.text, self.end = row.get("text"), (at // length + 1) * length
            self.due = self.end - 1
            return []

        def close(self) -> list[tuple]:
            if self.end is None:  # nothing came for long enough
                self.shown = self.due = None
                return []
            out = [] if self.shown == [self.text] else [(self.key, _instant(self.end), self.text)]
            self.shown, self.due, self.end = [self.text], self.end + keep, None
            return out

        def kept(self) -> list:
            return [self.text, self.end, self.shown]

        def restore(self, kept: list) -> None:
            self.text, self.end, self.shown = kept

    return in_order(ticks, "key", "at", "seq", ["text"], Ticker, "key string, at timestamp, text string", late)


def _instant(at: int) -> datetime:
    """A session-zone-free time of microseconds since 1970."""
    return datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000)
