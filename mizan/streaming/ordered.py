"""Folds over the rows of a key in order of time, on a stream: whatever the batches, the same rows come out.

Rows wait in the key's state until the watermark has passed them; what comes later than that is dropped, so no row that was
folded can be preceded by a later one. A fold names the time until which it must be kept; when the watermark has passed it,
the fold closes and the state goes. State therefore holds the rows of the last ``late`` and the folds that are open, and
returns to nothing when the keys fall silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class OrderedFold:
    """What is known of a key. Times are microseconds since 1970."""

    #: When it closes by itself: after this time, unless rows move it. None: nothing is held.
    due: int | None = None

    def __init__(self, key: Any, kept: list | None = None):
        self.key = key
        if kept:
            self.restore(kept)

    def add(self, at: int, row: dict) -> list[tuple]:
        """Take in the next row; the rows that come out."""
        raise NotImplementedError

    def close(self) -> list[tuple]:
        """The due time has passed; sets the next one, or None."""
        raise NotImplementedError

    def kept(self) -> list:
        """What restore() takes, as JSON can hold it."""
        raise NotImplementedError

    def restore(self, kept: list) -> None:
        raise NotImplementedError

    def pass_time(self, at: int) -> list[tuple]:
        """Close as often as it is due before this time."""
        out = []
        while self.due is not None and at > self.due:
            out += self.close()
        return out


def in_order(rows: DataFrame, key: str, at: str, order: str, fields: list[str], fold: type[OrderedFold], schema: str, late: str) -> DataFrame:
    """A streaming DataFrame of what the folds of rows give. Rows of a key count in order of (at, order); those without a key
    or a time are left out, and rows repeated with all their columns count once.

    late: how far rows may be out of order in time, over all keys.
    """
    micros = F.unix_micros(F.col(at))
    timed = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__time"), micros.alias("__at"), F.col(order).alias("__order"), F.to_json(F.struct(*fields)).alias("__row"))
    names = [c.split()[0] for c in schema.split(", ")]

    def step(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept, due = json.loads(state.get[0]) if state.exists else [[], None, None]
        one = fold(group[0], kept)
        one.due = due
        for b in batches:
            waiting += [[a, o, r] for a, o, r in zip(b["__at"].tolist(), b["__order"].tolist(), b["__row"].tolist(), strict=True)]
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted(w for w in waiting if w[0] <= now)
        waiting, out, before = [w for w in waiting if w[0] > now], [], None
        for w in ready:
            if w != before:
                out += one.pass_time(w[0]) + one.add(w[0], json.loads(w[2]))
            before = w
        out += one.pass_time(now)
        if not waiting and one.due is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps([waiting, one.kept(), one.due]),))
            next_ = min([w[0] for w in waiting] + ([] if one.due is None else [one.due]))
            state.setTimeoutTimestamp(max(-(-next_ // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    return timed.withWatermark("__time", late).groupBy("__key").applyInPandasWithState(step, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def micros(interval: str) -> int:
    """Microseconds of an interval like '180 seconds'."""
    return int(pd.Timedelta(interval) // pd.Timedelta(microseconds=1))


def apart(at: Column, before: Column, interval: str) -> Column:
    """Whether two times are more than an interval apart."""
    return F.unix_micros(at) - F.unix_micros(before) > micros(interval)
