"""Reservations as a stream: the live twin of operators.identity.reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import OrderedFold, in_order


def reserve_stream(requests: DataFrame, ttl_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """requests (request_id long, key string, at timestamp, release boolean) -> (key, request_id, granted), once the watermark
    has passed them.

    A row with ``release`` true gives the key back if the request of its id holds it. A key's state is the request that holds
    it and the end of its time; it goes when the time has run out or the key was given back.
    """
    ttl = max(1, ttl_minutes) * 60_000_000

    class Held(OrderedFold):
        holder: int | None = None

        def add(self, at: int, row: dict) -> list[tuple]:
            if row.get("release"):
                if self.due is not None and row.get("request_id") == self.holder:
                    self.due = self.holder = None
                return []
            granted = self.due is None
            if granted:
                self.due, self.holder = at + ttl, row.get("request_id")
            return [(self.key, row.get("request_id"), granted)]

        def close(self) -> list[tuple]:
            self.due = self.holder = None
            return []

        def kept(self) -> list:
            return [self.holder]

        def restore(self, kept: list) -> None:
            self.holder = kept[0]

    return in_order(requests, "key", "at", "request_id", ["request_id", "release"], Held, "key string, request_id long, granted boolean", late)
