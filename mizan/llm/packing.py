"""Best-fit packing of token sequences by patterns.

Documents become pieces of at most ``size`` tokens. Patterns of few lengths that fill a sequence are enumerated on a
coarse grid of lengths; non-negative least squares fits how often to use each to the histogram of lengths; the counts
are rounded down and what remains is packed best-fit. All of that sees only the histogram, at most ``size`` rows
whatever the input; the pieces get their places by a join on their length and their rank among pieces of that length.

Null text counts as empty: its document is the closing id alone. Repeated rows and null ids are packed like others.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, saved

SIZE = 2048
#: Steps of the grid of lengths and the most documents in a pattern.
GRID, PARTS = 128, 4
#: Words whose ids a worker keeps; only speed depends on it.
CACHE_WORDS = 500_000
_INNER_SPACES = re.compile(r" (?=\s|\Z)")
_WORD_START = re.compile(r" (?=\S)")
#: How a byte-level BPE of this kind splits text (fixed pattern).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _tokenizer(path: str):
    """The byte-level BPE of a tokenizers file; its vocabulary is in order of its merges, so ranks say all that they do."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a plain byte-level BPE is asked for")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class WordCache:
    """Ids of texts without added tokens. A byte-level BPE never joins what stands before a space and a following non-space, so a text
    is cut there, and the ids of a cut with its space are computed once for each worker."""

    def __init__(self, path: str):
        self.encode, self.seen = _tokenizer(path).encode_ordinary, {}

    def _new(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.seen) < CACHE_WORDS and len(word) <= 32:
            self.seen[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        words = text.split(" ") if not _INNER_SPACES.search(text) else _WORD_START.split(text)
        head, get, new = self.encode(words[0]), self.seen.get, self._new
        return struct.pack(f"<{len(head)}I", *head) + b"".join([get(w) or new(w) for w in words[1:]])


class TextIds:
    """Ids of whole texts as the tokenizers file says: its added tokens, wherever they stand in a text, are their own ids;
    what lies between them is encoded by itself."""

    def __init__(self, path: str):
        added = json.loads(Path(path).read_text())["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that stand anywhere are asked for")
        self.plain, self.added = WordCache(path), {t["content"]: struct.pack("<I", t["id"]) for t in added}
        # the longest of those that begin at a place
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if added else lambda text: [text]

    def __call__(self, text: str) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return self.plain(text)
        return b"".join([self.added[p] if i % 2 else self.plain(p) for i, p in enumerate(parts)])


@cache
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces of each document with (part, rank): a piece's place among those of its length in its task's output."""
    arrow_limits(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, met = text_ids(tokenizer_path), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in batches:
            row, rest = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = ids_of(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                begin = 0
                for piece, end in enumerate(range((n - 1) % size + 1, n + 1, size)):
                    row.append(i)
                    rest.append((piece, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end]), part, met[end - begin]))
                    met[end - begin] += 1
                    begin = end
            if row:
                columns = [pa.array(c, t) for c, t in zip(zip(*rest, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns], names)

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def patterns(grid: int = GRID, parts: int = PARTS) -> np.ndarray:
    """All ways to fill the grid with at most that many lengths: a column of counts by length 1..grid for each."""

    def fill(left: int, most: int, n: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if n > 1:
            for x in range(min(most, left - 1), -(-left // n) - 1, -1):
                for more in fill(left - x, x, n - 1):
                    yield (x, *more)

    found = list(fill(grid, grid, parts))
    out = np.zeros((grid, len(found)))
    for j, p in enumerate(found):
        for x in p:
            out[x - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 of least |ax - b|, by active sets. After that many changes of the set the fit so far is taken: what it leaves
    over is packed as residual, so only the fit depends on it."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / (x[at][low] - s[low])).min()
            x[at] += step * (s - x[at])
            used[at[x[at] <= tol]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], size: int = SIZE, grid: int = GRID, parts: int = PARTS) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces of a histogram of lengths: rows (length, lo, hi, sequence, offset). The piece of that length
    and of rank r, lo <= r < hi, stands in sequence ``sequence + r - lo`` at ``offset``."""
    step = -(-size // grid)
    left = {n: c for n, c in histogram.items() if c > 0}
    taken, there = dict.fromkeys(left, 0), sorted(left)
    cells = np.zeros(grid, int)
    for n, c in left.items():
        cells[-(-n // step) - 1] += c
    groups: list[tuple[int, list[tuple[int, int]]]] = []  # count of like sequences, (length, first rank) of each place

    def take(n: int, count: int) -> tuple[int, int]:
        first = taken[n]
        taken[n] += count
        left[n] -= count
        cells[-(-n // step) - 1] -= count
        if not left[n]:
            there.remove(n)
        return n, first

    if left.get(size):
        groups.append((left[size], [take(size, left[size])]))
    if cells.any():
        ways, total = patterns(grid, parts), int(cells.sum())
        scaled = np.floor(nnls(ways, cells / total) * total + 1e-6).astype(int)
        for j in np.argsort(-scaled, kind="stable"):
            # all places but the smallest take the longest pieces of their cells; the smallest takes what fits best
            need = ways[:, j].astype(int)
            need[np.flatnonzero(need)[0]] -= 1
            where = np.flatnonzero(need)
            times = int(min([scaled[j], *(cells[where] // need[where])]))
            runs = []
            for w in where if times > 0 else ():
                for _ in range(need[w]):
                    own, want = [], times
                    for n in range(min((w + 1) * step, size), w * step, -1):
                        if want and left.get(n):
                            m = min(want, left[n])
                            own.append((m, take(n, m)))
                            want -= m
                    runs.append(own)
            done = 0
            while runs and done < times:
                # a run ends where any place comes to another length
                m = min(r[0][0] for r in runs)
                i = bisect_right(there, size - sum(r[0][1][0] for r in runs)) - 1
                if i >= 0:
                    m = min(m, left[there[i]])
                groups.append((m, [r[0][1] for r in runs] + ([take(there[i], m)] if i >= 0 else [])))
                for r in runs:
                    c, (n, first) = r[0]
                    r[:1] = [(c - m, (n, first + m))] if c > m else []
                done += m
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for g in groups:
        gaps.setdefault(size - sum(n for n, _ in g[1]), []).append(g)
    order = sorted(gaps)

    def put(count: int, places: list[tuple[int, int]]) -> None:
        gap = size - sum(n for n, _ in places)
        if gap not in gaps:
            insort(order, gap)
        gaps.setdefault(gap, []).append((count, places))

    for n in sorted(left, reverse=True):
        while left[n]:
            i = bisect_left(order, n)
            if i < len(order):
                gap = order[i]
                count, places = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
                m = min(count, left[n])
                if count > m:
                    put(count - m, [(k, first + m) for k, first in places])
                put(m, [*places, take(n, m)])
            else:
                each = min(size // n, left[n])
                m = left[n] // each
                put(m, [take(n, m) for _ in range(each)])
    out, sequence = [], 0
    for gap in order:
        for count, places in gaps[gap]:
            offset = 0
            for n, first in places:
                out.append((n, first, first + count, sequence, offset))
                offset += n
            sequence += count
    return out


def pack(documents: DataFrame, id_col: str, text_col: str, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark: SparkSession = documents.sparkSession
    cut = saved(pieces(documents, id_col, text_col, tokenizer_path, size), "pieces")
    counts = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    slots = spark.createDataFrame(plan(histogram, size), "length long, lo long, hi long, sequence long, offset long")
    ranked = cut.join(counts, ["part", "length"]).withColumn("at", F.col("rank") + F.col("before"))
    on = (ranked["length"] == slots["length"]) & (ranked["at"] >= slots["lo"]) & (ranked["at"] < slots["hi"])
    # the plan's rows follow the histogram's, not the input's
    return ranked.join(F.broadcast(slots), on).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.col("at") - F.col("lo")).alias("sequence_id"), "offset"
    )
