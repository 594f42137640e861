"""Identity of cases: duplicates, exclusions, use, records and reservations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import present


def folded(c: Column) -> Column:
    """Case and outer spaces do not count."""
    return F.lower(F.trim(c))


def keep_first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row of least ``order`` of each key, one that has no order only where none has; a row that is repeated stays once.
    Rows with a null or empty key part all stay.

    Tasks keep a row of each key before rows are shuffled, so none holds all rows of one key.
    """
    whole = F.coalesce(F.forall(F.array(*(k.cast("string") for k in keys)), lambda k: F.coalesce(k, F.lit("")) != ""), F.lit(False))
    at = F.struct(F.col(order).isNull(), F.col(order))
    keyed = df.where(whole).select(F.struct(*keys).alias("__key"), at.alias("__at"), F.struct("*").alias("__row"))
    first = keyed.groupBy("__key").agg(F.min_by("__row", "__at").alias("__row"))
    return first.select("__row.*").unionByName(df.where(~whole))


def retain(df: DataFrame, group: str, recency: Column, tie: str, keep: int, active: Column, shares: int = 64) -> DataFrame:
    """Rows that retention removes: beyond the newest ``keep`` of each group, never an active one.

    The last row that stays of each group is found first: among the newest of each share of the group, so that a group of
    any size is spread over tasks. The others are told by comparing with it. Null times are the oldest.
    """
    rows = df.where(~F.coalesce(active, F.lit(False))).withColumn("__at", recency)
    newest = [F.col("__at").desc_nulls_last(), tie]
    share = F.pmod(F.xxhash64(tie), F.lit(shares))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    near = rows.select(group, tie, "__at", share.alias("__share")).withColumn("__rn", rank(group, "__share")).where(F.col("__rn") <= keep)
    last = near.withColumn("__rn", rank(group)).where(F.col("__rn") == keep).select(F.col(group).alias("__group"), F.col(tie).alias("__tie"), F.col("__at").alias("__last"))
    older = F.coalesce(F.col("__at") < F.col("__last"), F.col("__at").isNull() & F.col("__last").isNotNull())
    beyond = older | (F.col("__at").eqNullSafe(F.col("__last")) & (F.col(tie) > F.col("__tie")))
    return rows.join(last, F.col(group).eqNullSafe(F.col("__group"))).where(beyond).select(*df.columns)


def used(cases: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Cases used before: by the document's hash, or by number and court. One equi-join for each, never one with OR."""
    hist = history.select(F.col("case_number").alias("h_case"), F.col("court_name").alias("h_court"), F.col("pdf_sha256").alias("h_sha"))
    by_sha = cases.where(present(F.col("pdf_sha256"))).join(hist, F.col("pdf_sha256") == F.col("h_sha"), "left_semi")
    named = cases.where(present(F.col("case_number")) & present(F.col("court_name")))
    by_name = named.join(hist, (folded(F.col("case_number")) == folded(F.col("h_case"))) & (folded(F.col("court_name")) == folded(F.col("h_court"))), "left_semi")
    return by_sha.unionByName(by_name).dropDuplicates([key])


def insertable(new: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """Rows of ``new`` that may be recorded: not used before, and the first of equal ones among themselves."""
    fresh = new.join(used(new, history, order).select(order), order, "left_anti")
    by_sha = keep_first(fresh, [F.col("pdf_sha256")], order)
    return keep_first(by_sha, [folded(F.col("case_number")), folded(F.col("court_name"))], order)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old and new; of a key in both the new one, of one repeated in new the last by ``seq``."""
    last = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))).where("__rn = 1").drop("__rn", "seq")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def reservations(requests: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """requests (request_id, holder key, at) -> with ``granted``: a key is free once its holder's time has run out.

    A grant lasts ttl from its start, so which requests are granted follows from the first on: the next grant of a key is its
    first request after the last grant's end. A request more than ttl after the one before it is always granted; there a
    key's requests are cut into stretches, which are folded apart, so that a key's requests spread over tasks. Stretches are
    told from the first and last request of each ttl of time, not from all requests. The fold keeps only the end of the
    running grant. Requests without a time are granted and hold nothing.

    With a column ``release``, its true rows are no requests: they give the key back if the request of their id holds it.
    """
    ttl = max(1, ttl_minutes) * 60_000_000
    gives_back = F.coalesce(F.col("release"), F.lit(False)) if "release" in requests.columns else F.lit(False)
    asked = requests.select("key", F.col("request_id").cast("bigint").alias("request_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), gives_back.alias("release"))
    asked = asked.withColumn("slot", F.floor(F.col("at") / ttl))
    order = Window.partitionBy("key").orderBy("slot")
    slots = asked.where("at is not null").groupBy("key", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    begins = F.coalesce(F.col("first") - F.lag("last").over(order) > ttl, F.lit(True))
    slots = slots.withColumn("begins", begins).select(F.col("key").alias("__key"), F.col("slot").alias("__slot"), F.sum(F.col("begins").cast("int")).over(order).alias("stretch"))
    dealt = asked.join(slots, asked["key"].eqNullSafe(slots["__key"]) & (asked["slot"] == slots["__slot"]), "left").select("key", "stretch", "at", "request_id", "release")
    dealt = dealt.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "request_id", "release")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until, holder = None, None, None
        for b in batches:
            out = []
            for key, stretch, at, request, release in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, stretch) != last:
                    last, until = (key, stretch), None
                if release:
                    until = None if request == holder else until
                    continue
                free = until is None or at > until
                if free and at is not None:
                    until, holder = at + ttl, request
                out.append((key, request, free))
            columns = zip(*out, strict=True) if out else ((), (), ())
            kinds = (b.schema.field(0).type, pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "request_id", "granted"])

    return dealt.mapInArrow(fold, f"key {dict(dealt.dtypes)['key']}, request_id bigint, granted boolean")


def round_identity(number: Column, court: Column, url: Column) -> Column:
    """How a search round tells cases apart: by number and court, else by address."""
    by_case = F.concat_ws("|", F.lit("case"), F.lower(number), F.lower(court))
    return F.when(present(number) & present(court), by_case).otherwise(F.concat_ws("|", F.lit("url"), url))


def allowed(users: DataFrame, members: DataFrame, owner: int) -> DataFrame:
    """users with ``allowed``: the owner and the members."""
    known = members.select(F.col("user_id").alias("__m")).distinct()
    return users.join(known, users["user_id"] == known["__m"], "left").withColumn("allowed", (F.col("user_id") == owner) | F.col("__m").isNotNull()).drop("__m")


def member_changes(requests: DataFrame, members: DataFrame, owner: int) -> DataFrame:
    """requests (seq, by, user_id, action: add or remove) in their order -> with ``result``: refused unless the owner asks, for ids
    that are none, and for the owner's own removal; else added, removed, or unchanged where it already was so."""
    mine = F.col("by") == owner
    refused = ~F.coalesce(mine, F.lit(False)) | (F.col("user_id").isNull()) | ((F.col("action") == "add") & (F.col("user_id") <= 0)) | ((F.col("action") == "remove") & (F.col("user_id") == owner))
    known = members.select(F.col("user_id").alias("__m")).distinct()
    asked = requests.withColumn("__no", refused).join(known, requests["user_id"] == known["__m"], "left")
    # whether the user is in before a request: by the last valid one before it, else by the list
    before = F.last(F.when(~F.col("__no"), F.col("action") == "add"), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("user_id") == owner) | F.coalesce(before, F.col("__m").isNotNull())
    adds = F.col("action") == "add"
    result = F.when(F.col("__no"), "refused").when(adds & ~inside, "added").when(~adds & inside, "removed").otherwise("unchanged")
    return asked.withColumn("result", result).drop("__no", "__m")
