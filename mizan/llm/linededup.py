"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its words (cut at ASCII white space). Two lines match if their words are equal, or if one word was put in, taken
out or changed and the longer of them has WORDS_PER_EDIT words at least: the edit bound is none below that length and one
from it on, however long a line is. A line goes
if an earlier line, by document id and place, matches it, whether or not that earlier line goes itself; the first of
each group so stays. Lines without words always stay.

Equal lines become one by a 128-bit hash first. Lines within one edit share their first or last half; those that share one
with another line emit their deletion neighbourhood: the hash of their words without word i, for each i, and of all words.
Equal variants are joined, each line with the earliest line of the variant, so groups of any size give no pairs. What was
deleted must fit (the same place of lines of n words, or nothing of the shorter of two), and the words of each joined
pair are compared, so that no line goes for equal hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, saved, scratch, whole_row

#: A line of so many words may differ by one; shorter lines match only if equal.
WORDS_PER_EDIT = 5
_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _hash(words: list[bytes], seed: int) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), seed) - (1 << 63)


def _halves(words: list[bytes]) -> list[int]:
    """Keys that a line shares with any line that one edit of a word makes of it: with n words in the longer of the two,
    the first or the last n // 2 words are the same."""
    out = []
    for n in (len(words), len(words) + 1):
        half = n // 2
        out += [_hash(words[:half], 4 * n), _hash(words[len(words) - half :], 4 * n + 1)]
    return out


def _deletions(words: list[bytes]) -> list[int]:
    """Hashes of all words, and of the words without each one: a polynomial over the words' hashes, so that leaving one out
    takes a step, not the whole line."""
    h, k = [xxhash.xxh64_intdigest(w) for w in words], len(words)
    powers, before, after = [1], [0], [0] * (k + 1)
    for x in h:
        before.append((before[-1] * _BASE + x) & _ALL)
        powers.append(powers[-1] * _BASE & _ALL)
    for m in range(k - 1, -1, -1):
        after[m] = (h[m] * powers[k - 1 - m] + after[m + 1]) & _ALL
    return [(x & _ALL) - (1 << 63) for x in (before[k], *(before[m] * powers[k - m - 1] + after[m + 1] for m in range(k)))]


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """True if one edit of a word, or none, makes one line of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def lines(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs (doc_id, text_key, text) -> (doc_id, text_key, line_no, h1, h2, halves) of each line with words."""
    arrow_limits(docs.sparkSession)
    names = ["doc_id", "text_key", "line_no", "h1", "h2", "halves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, h1, h2, halves = [], [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                for j, line in enumerate(split_lines(text)):
                    words = line.encode().split()
                    if words:
                        row.append(i)
                        no.append(j)
                        whole = xxhash.xxh128_intdigest(b" ".join(words))
                        h1.append((whole >> 64) - (1 << 63))
                        h2.append((whole & _ALL) - (1 << 63))
                        # a line of a word less may match one that is long enough
                        halves.append(_halves(words) if len(words) >= words_per_edit - 1 else [])
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(halves, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, line_no int, h1 long, h2 long, halves array<long>")


def _words(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, own array of line numbers) -> (doc_id, text_key, line_no, words joined) of those lines."""
    names = ["doc_id", "text_key", "line_no", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, found = [], [], []
            for i, (text, own) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                every = split_lines(text)
                row += [i] * len(own)
                no += own
                found += [b" ".join(every[j].encode().split()) for j in own]
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(found, pa.binary())], names)

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, text_key long, line_no int, words binary")


def _variants(crowd: DataFrame) -> DataFrame:
    """(place, words) -> (place, v, n, gap): variants of the lines: hash, words in it, the place that was deleted (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, v, n, gap = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                words = x.split(b" ")
                k = len(words)
                row += [i] * (k + 1)
                v += _deletions(words)
                n += [k, *[k - 1] * k]
                gap += range(-1, k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(v, pa.int64()), pa.array(n, pa.int32()), pa.array(gap, pa.int32())], ["place", "v", "n", "gap"])

    return crowd.mapInArrow(run, T.StructType([crowd.schema["place"], *T.StructType.fromDDL("v long, n int, gap int").fields]))


def _verified(pairs: DataFrame) -> DataFrame:
    """(place, a, b) -> place of the pairs whose words are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [within_one(x.split(b" "), y.split(b" ")) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near, pa.bool_()))], ["place"])

    return pairs.mapInArrow(run, T.StructType([pairs.schema["place"]]))


def kept_lines(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs (doc_id, text_key, text) -> (doc_id, text_key, kept array of line numbers with words that stay)."""
    place = F.struct("doc_id", "text_key", "line_no").alias("place")
    with scratch() as keep:
        distinct = keep(lines(docs, words_per_edit).groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("halves").alias("halves")), "distinct-lines")
        # a line's four keys are distinct, so a key of two lines has two hashes
        keys = distinct.select("h1", F.explode("halves").alias("key"))
        shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
        crowd = saved(keys.join(shared, "key", "left_semi").select("h1").distinct(), "crowd")
        by_doc = distinct.join(crowd, "h1", "left_semi").groupBy("place.doc_id", "place.text_key").agg(F.collect_list("place.line_no").alias("own"))
        own = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "own")
        texts = docs.join(own, docs["doc_id"].eqNullSafe(own["d"]) & docs["text_key"].eqNullSafe(own["k"])).dropDuplicates(["d", "k"]).select("doc_id", "text_key", "text", "own")
        words = saved(_words(texts).select(place, "words"), "crowded-lines")
        v = saved(_variants(words), "variants")
        earliest = v.groupBy("v", "n", "gap").agg(F.min("place").alias("least"), F.count("*").alias("c"))
        # of a variant: the earliest line that it is whole, and the earliest one for each place with several lines that lack it
        lacking = F.map_from_entries(F.collect_list(F.when((F.col("gap") >= 0) & (F.col("c") > 1), F.struct("gap", "least"))))
        meet = earliest.groupBy("v", "n").agg(F.min(F.when(F.col("gap") < 0, F.col("least"))).alias("whole"), lacking.alias("lacking"), F.sum("c").alias("c"))
        # lines of n + 1 words lack a place of these n; they are long enough for an edit from n + 1 words on
        meet = meet.where((F.col("c") > 1) & (F.col("n") + 1 >= words_per_edit) & (F.col("whole").isNotNull() | (F.size("lacking") > 0)))
        joined = v.where("gap >= 0").join(meet, ["v", "n"])
        other = F.explode(F.array(F.col("whole"), F.element_at("lacking", F.col("gap")))).alias("other")
        joined = joined.select("place", other).where("other is not null and other <> place").distinct()
        pairs = saved(joined.select(F.greatest("place", "other").alias("place"), F.least("place", "other").alias("other")).distinct(), "line-pairs")
        first, second = words.select("place", F.col("words").alias("a")), words.select(F.col("place").alias("other"), F.col("words").alias("b"))
        gone = keep(_verified(pairs.join(first, "place").join(second, "other").select("place", "a", "b")).distinct(), "near-lines")
    kept = distinct.select("place").join(gone, "place", "left_anti")
    return kept.groupBy("place.doc_id", "place.text_key").agg(F.array_sort(F.collect_list("place.line_no")).alias("kept"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """df with the text left in ``text_col``, and n_lines and n_kept: lines with words before and after. Columns of df of
    those two names are replaced; all others stay as they are, whatever their names.

    Null text stays null (no lines). Rows repeated with id and text count as one document and each get its result; null ids
    come before all others. Lines without words stay, so a document may be left with those alone (n_kept 0).
    """
    arrow_limits(df.sparkSession)
    text = F.col(text_col).cast("string")
    src = df.select(whole_row(), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kept = kept_lines(src.select("doc_id", "text_key", "text"), words_per_edit).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "kept")
    out = src.join(kept, src["doc_id"].eqNullSafe(kept["d"]) & (src["text_key"] == kept["k"]), "left").select("row", "text", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_kept = [], [], []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                stay, left, worded = set(own or ()), [], 0
                for i, line in enumerate(split_lines(text)):
                    has_words = bool(line.encode().split())
                    worded += has_words
                    if i in stay or not has_words:
                        left.append(line)
                texts.append(None if text is None else "\n".join(left))
                n_lines.append(worded)
                n_kept.append(len(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_kept, pa.int32())], ["row", "text", "n_lines", "n_kept"])

    done = out.mapInArrow(run, T.StructType([out.schema["row"], *T.StructType.fromDDL("text string, n_lines int, n_kept int").fields]))
    others = [c for c in df.columns if c not in ("n_lines", "n_kept")]
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in others), "n_lines", "n_kept")


def op10(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents.select("doc_id", "text"))
