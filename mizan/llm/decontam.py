"""Benchmark decontamination by a distributed positional inverted index.

The index is built once, whatever the benchmarks: a run of documents is a shard, and a shard holds for each of its terms the
list of positions where it stands. Benchmarks are the queries. They come in blocks of bounded size; each block goes to all
shards, and every shard intersects its own lists, so no list is ever shuffled:

* the lengths of the lists say which terms of a window are rarest in the shard; a window with a term that has no list is out;
* the lists of the rarest terms, less their offset in the item, give alignments of the item with a document;
* an alignment grows to both sides while the words there are the item's. A run as long as the window is a ``phrase``; runs
  that meet with one word changed, put in or taken out between them are a ``proximity`` match.

Three terms of a window are tried, so an edited term, or one at an edge beside it, hides no proximity match. Documents are
told apart by id and text: repeated rows of both get one result each, the same. Null text has no words; items without words
have no window; null item ids hit words but count as no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LARGE_ROWS, arrow_limits, saved

WINDOW = 13
#: Windows of fewer words have no proximity matches: one word of four is no small edit.
NEAR_WORDS = 5
#: UTF-8 bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
#: Alignments, and windows, that are worked on together.
CHUNK = 1 << 18
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 32 for b in range(256))
_NO_TERM, _DOC_END, _ITEM_END = -3, -1, -2
#: More than any term's frequency in a shard.
_NONE = 1 << 40


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and all that is not ASCII; only A to Z are lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class _Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_key, text) -> shards: (doc_ids, text_keys, n_words) of their documents; terms, ascending, with the
    length of each one's list; and the lists, as steps from position to position. A position is free between documents."""
    arrow_limits(docs.sparkSession)
    names = ["doc_ids", "text_keys", "n_words", "terms", "lengths", "steps"]

    def one(column: pa.Array, dtype: pa.DataType) -> pa.Array:
        return pa.array([column.to_pylist()], pa.list_(dtype)) if isinstance(column, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.array(column, dtype))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            numbers, ids, n_words = _Numbers(), [], []
            for t in b.column(2).to_pylist():
                own = words(t)
                n_words.append(len(own))
                ids.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
            n_words = np.array(n_words, np.int64)
            ids = np.concatenate(ids)
            at = np.arange(len(ids)) + np.repeat(np.arange(len(n_words)), n_words)
            hashes = np.fromiter(map(_term, numbers), np.int64, len(numbers))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            ids = rank[ids]
            by_term = np.argsort(ids, kind="stable")
            lengths = np.bincount(ids, minlength=len(order))
            positions = at[by_term]
            steps = np.diff(positions, prepend=0)
            heads = np.cumsum(lengths) - lengths
            steps[heads] = positions[heads]
            yield pa.RecordBatch.from_arrays(
                [one(b.column(0), b.column(0).type), one(b.column(1), pa.int64()), one(n_words, pa.int64()), one(hashes[order], pa.int64()), one(lengths, pa.int32()), one(steps, pa.int32())], names
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_ids array<{kind}>, text_keys array<long>, n_words array<long>, terms array<long>, lengths array<int>, steps array<int>")


class Queries:
    """A block of items: their terms one after another, _ITEM_END between them."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes + window  # place of an item's first term
        self.length = int((self.sizes + 1).sum()) + 2 * window + 2
        self.place = np.concatenate([np.arange(n) + f for n, f in zip(self.sizes, self.first, strict=True)]) if items else np.zeros(0, np.int64)
        self.terms = np.fromiter((_term(w) for own in items for w in own), np.int64, len(self.place))
        # windows: first place and width
        per = np.maximum(1, self.sizes - window + 1)
        self.start = np.repeat(self.first - (np.cumsum(per) - per), per) + np.arange(per.sum())
        self.width = np.repeat(np.minimum(self.sizes, window), per)


def _runs(stream: np.ndarray, wanted: np.ndarray, at: np.ndarray, place: np.ndarray, most: int, side: int) -> np.ndarray:
    """How many words from (at, place) on, to one side, are the item's."""
    reach = side * np.arange(most)
    a, p = np.clip(at[:, None] + reach, 0, len(stream) - 1), np.clip(place[:, None] + reach, 0, len(wanted) - 1)
    return np.logical_and.accumulate(stream[a] == wanted[p], axis=1).sum(axis=1)


def search(shard: dict[str, np.ndarray], q: Queries) -> np.ndarray:
    """Matches of a block in a shard: rows (document of the shard, item, 1 if a phrase, first, last)."""
    window, lengths = q.window, shard["lengths"].astype(np.int64)
    heads = np.cumsum(lengths) - lengths
    total = np.cumsum(shard["steps"], dtype=np.int64)
    before = np.where(heads > 0, total[np.maximum(heads, 1) - 1], 0) if len(total) else heads
    positions = total - np.repeat(before, lengths) + window + 1
    starts = np.cumsum(shard["n_words"] + 1) - shard["n_words"] - 1 + window + 1
    stream = np.full(int((shard["n_words"] + 1).sum()) + 2 * window + 3, _DOC_END, np.int32)
    stream[positions] = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    # the shard's list of each term of the block
    found = np.minimum(np.searchsorted(shard["terms"], q.terms), max(0, len(lengths) - 1))
    there = shard["terms"][found] == q.terms if len(lengths) else np.zeros(len(q.terms), bool)
    wanted = np.full(q.length, _ITEM_END, np.int32)
    wanted[q.place] = np.where(there, found, _NO_TERM)
    frequency = np.zeros(q.length, np.int64)
    frequency[q.place] = np.where(there, lengths[found] if len(lengths) else 0, 0)
    missing = np.concatenate(([0], np.cumsum(frequency == 0)))
    lost = missing[q.start + q.width] - missing[q.start]
    near = q.width >= NEAR_WORDS
    open_ = np.flatnonzero(lost <= near)
    anchors = []
    for i in range(0, len(open_), CHUNK):
        w = open_[i : i + CHUNK]
        cells = q.start[w][:, None] + np.arange(window)
        f = frequency[np.minimum(cells, q.length - 1)]
        valid = (np.arange(window) < q.width[w][:, None]) & (f > 0)
        # frequency and offset in one number, so that the three least need no whole sort
        least = np.partition(np.where(valid, f, _NONE) << 16 | np.arange(window), range(min(3, window)), axis=1)[:, :3]
        rarest, chosen = least & 0xFFFF, least >> 16 < _NONE
        chosen[:, 1:] &= near[w][:, None]
        anchors.append((q.start[w][:, None] + rarest)[chosen])
    anchors = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, np.int64)
    item_of = np.searchsorted(q.first, anchors, "right") - 1
    # each place of an anchor's list is an alignment; so many at a time, also within one list
    cuts, out = np.cumsum(frequency[anchors]), []
    for lo in range(0, int(cuts[-1]) if len(cuts) else 0, CHUNK):
        flat = np.arange(lo, min(lo + CHUNK, int(cuts[-1])))
        k = np.searchsorted(cuts, flat, "right")
        place, item = anchors[k], item_of[k]
        at = positions[heads[wanted[place]] + flat - (cuts[k] - frequency[place])]
        alive = (stream[at + 1] == wanted[place + 1]) | (stream[at - 1] == wanted[place - 1]) | (q.sizes[item] == 1)
        grown = _grown(stream, wanted, at[alive], place[alive], item[alive], np.minimum(q.sizes[item[alive]], window), window)
        out.append(_joined(grown, q.sizes, window))
    rows = _joined(np.concatenate(out), q.sizes, window) if out else np.zeros((0, 4), np.int64)
    doc = np.searchsorted(starts, rows[:, 2], "right") - 1
    return np.column_stack((doc, rows[:, 0], rows[:, 1], rows[:, 2] - starts[doc], rows[:, 3] - starts[doc]))


def _joined(rows: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Distinct matches; phrases of one item that share all but one word of a window are one, as every window of both is within
    it. So a document of one word over and over gives a few rows, not one for each of its words."""
    rows = np.unique(rows, axis=0)  # by item, then proximity before phrases, then place
    if not len(rows):
        return rows
    fresh = np.ones(len(rows), bool)
    # the furthest end so far of the same item's phrases: ends made to grow from group to group
    group = np.cumsum(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    span = int(rows[:, 3].max()) + 2
    end = np.maximum.accumulate(rows[:, 3] + group * span) - group * span
    width = np.minimum(sizes[rows[:, 0]], window)
    same = (group[1:] == group[:-1]) & (rows[1:, 1] == 1)
    fresh[1:] = ~(same & (rows[1:, 2] <= end[:-1] - width[1:] + 2))
    heads = np.flatnonzero(fresh)
    out = rows[heads]
    out[:, 3] = end[np.append(heads[1:], len(rows)) - 1]
    near = out[:, 1] == 0
    out[near, 3] = rows[heads[near], 3]
    return out


def _grown(stream: np.ndarray, wanted: np.ndarray, at: np.ndarray, place: np.ndarray, item: np.ndarray, width: np.ndarray, window: int) -> np.ndarray:
    """Rows (item, 1 if a phrase, first, last) of the alignments of a place of an item with a place of the shard that grow to
    a match."""
    before, after = _runs(stream, wanted, at - 1, place - 1, window - 1, -1), _runs(stream, wanted, at + 1, place + 1, window - 1, 1)
    run = before + 1 + after
    first, last = at - before, at + after
    whole = run >= width
    out = [np.column_stack((item, np.ones(len(item), np.int64), first, last))[whole]]
    some = np.flatnonzero(~whole & (width >= NEAR_WORDS))
    for side in (-1, 1):
        edge, beyond = (place[some] - before[some] - 1, first[some] - 1) if side < 0 else (place[some] + after[some] + 1, last[some] + 1)
        inner_word, inner_term = stream[beyond] != _DOC_END, wanted[edge] != _ITEM_END
        # a word changed, put in, or taken out where the run ends: what it costs the item, and where the next run begins
        for cost, d_at, d_place, fits in ((1, 1, 1, inner_word & inner_term), (0, 1, 0, inner_word), (1, 0, 1, inner_term)):
            more = _runs(stream, wanted, beyond + side * d_at, edge + side * d_place, window - 1, side)
            ok = fits & (run[some] + cost + more >= width[some]) & ((more > 0) | (d_at == d_place))
            far = beyond + side * (more - (not d_at))
            rows = (item[some], np.zeros(len(some), np.int64), far if side < 0 else first[some], last[some] if side < 0 else far)
            out.append(np.column_stack(rows)[ok])
    return np.concatenate(out)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text), benchmark (item_id, text) -> (documents with n_words, matches).

    Matches: (doc_id, text_key, item_id, kind, first, last), places of words in the document. Kind ``phrase``: every window
    within first..last stands in the item; ``proximity``: a window of the item stands there but for one word.
    """
    src = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    shards = saved(index(src), "postings", LARGE_ROWS)
    every = shards.select(F.explode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").alias("n_words"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, item_id {kind.simpleString()}, kind string, first long, last long"
    found = None
    for k in range(n_blocks):
        block = [(r[0], own) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect() if (own := words(r[1]))]  # about block_bytes
        if not block:
            continue
        shared = docs.sparkSession.sparkContext.broadcast((Queries([x[1] for x in block], window), [x[0] for x in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, names = shared.value
            names = pa.array(names, to_arrow_type(kind))
            for b in batches:
                for i in range(b.num_rows):
                    column = {n: b.column(n)[i].values for n in b.schema.names}
                    m = search({n: column[n].to_numpy(zero_copy_only=False) for n in ("n_words", "terms", "lengths", "steps")}, q)
                    said = np.where(m[:, 2] == 1, "phrase", "proximity")
                    doc = pa.array(m[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [column["doc_ids"].take(doc), column["text_keys"].take(doc), names.take(pa.array(m[:, 1])), pa.array(said.tolist(), pa.string()), pa.array(m[:, 3]), pa.array(m[:, 4])],
                        ["doc_id", "text_key", "item_id", "kind", "first", "last"],
                    )

        part = saved(shards.mapInArrow(run, schema), "matches")
        shared.destroy()
        found = part if found is None else found.union(part)
    return every, found if found is not None else docs.sparkSession.createDataFrame([], schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, contaminated, near_items) for each row of docs. near_items: items
    that have a proximity match and no phrase there."""
    every, matches = find(docs, benchmark, window, block_bytes)
    key = ["doc_id", "text_key"]
    phrases = matches.where("kind = 'phrase'")
    # hit words, a row for each: spans of a document may overlap
    hit = phrases.select(*key, "first", "last").distinct().select(*key, F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    item = F.col("item_id").cast("string")
    by_item = matches.groupBy(*key, item.alias("item")).agg(F.bool_or(F.col("kind") == "phrase").alias("exact"))
    items = by_item.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_list(F.when(~F.col("exact"), F.col("item")))).alias("near_items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_key"].eqNullSafe(b["text_key"])
    verdict = saved(items.join(hit, same(items, hit), "left").select(items["doc_id"].alias("d"), items["text_key"].alias("k"), "n_hit", "items", "near_items"), "verdicts")
    out = every.join(verdict, every["doc_id"].eqNullSafe(F.col("d")) & every["text_key"].eqNullSafe(F.col("k")), "left")
    none = F.array().cast("array<string>")
    out = out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return out.select(
        *key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "near_items"
    )


def op4(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items")
    )
