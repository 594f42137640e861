"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and beginnings of words, that far more toxic than clean documents of the labelled sample
hold. A sample document's own features come from a lexicon learned without its fold, so the trees see hits as they fall on
unseen texts. Trees learn from all folds but the last, the calibration from the last, with weights that restore the classes'
true shares. Only lexicon lines and sample ids come to the driver, both of bounded number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, saved

#: Bounds of the labelled sample: toxic and clean documents, whole texts. FOLDS by a hash of the text.
SAMPLE, FOLDS = {1: 4000, 0: 12_000}, 5
#: Lexicon lines, documents that a line must be in, least log-odds and least G-statistic of a line.
LINES, LEAST_DOCS, LEAST_ODDS, LEAST_G = 2000, 3, 1.0, 12.0
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6)
TREES, DEPTH, STEP = 30, 3, 0.2
#: Words that address someone, in the usual languages of web text.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre tú usted ustedes vosotros ti tus".split())
#: Words before and after a hit in which an address counts as near.
NEAR = 5
WORD = re.compile(r"[@$0-9]?[^\W\d_]+(?:[@$!|*+._0-9-]{1,2}[^\W\d_]+)*")
#: Signs that stand for letters, and signs put between letters.
_LETTERS = str.maketrans("@$013457!|", "asoieastil", "*+._-2689")
_RUN = re.compile(r"(.)\1{2,}")
#: Characters that are cut into words at a time.
PIECE = 1 << 18
FEATURES = ("hits", "weight", "strongest", "surest", "lines", "near", "second_person", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated", "obfuscated_hits", "words")


def plain(word: str) -> str:
    """Lower case, signs read as letters, letters repeated three times or more once."""
    low = word.lower()
    return _RUN.sub(r"\1", low if low.isalpha() else low.translate(_LETTERS))


def entries(word: str) -> list[str]:
    """Lexicon lines that a plain word may meet."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) > n)]


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, a piece after another; pieces end at white space."""
    at = 0
    while len(text) - at > PIECE and (m := re.compile(r"\s").search(text, at + PIECE)):
        yield WORD.findall(text, at, m.start())
        at = m.start()
    yield WORD.findall(text, at)


#: Line -> (log-odds, logarithm of the G-statistic).
Lexicon = dict[str, tuple[float, float]]


class Reader:
    """Features of texts by one lexicon; what a word says is worked out once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def told(self, word: str) -> tuple[str, float, bool, bool, bool]:
        """(its lexicon line, the line's weight, addresses someone, obfuscated, shouted)"""
        low = plain(word)
        weight, line = max((self.lexicon[e][0], e) if e in self.lexicon else (0.0, "") for e in entries(low))
        if len(self.known) > 200_000:
            self.known.clear()
        out = self.known[word] = (line if weight else "", weight, low in SECOND_PERSON, low != word.lower(), len(word) > 2 and word.isupper())
        return out

    def features(self, text: str) -> list[float]:
        n = hits = obfuscated = obfuscated_hits = second = shouted = near = 0
        weight, lines = 0.0, set()
        last_you = last_hit = -NEAR - 1  # places, also across pieces
        counted: set[int] = set()
        for words in words_of(text):
            for i, w in enumerate(words, n):
                line, x, you, odd, loud = self.known.get(w) or self.told(w)
                if not (x or you or odd or loud):
                    continue
                obfuscated += odd
                shouted += loud
                if you:
                    second, last_you = second + 1, i
                    if i - last_hit <= NEAR and last_hit not in counted:
                        near += 1
                        counted = {last_hit}
                if x:
                    hits, weight, obfuscated_hits, last_hit = hits + 1, weight + x, obfuscated_hits + odd, i
                    lines.add(line)
                    if i - last_you <= NEAR:
                        near += 1
                        counted = {i}
            n += len(words)
        per, chars = 100 / max(1, n), 100 / max(1, len(text))
        strongest, surest = (max((self.lexicon[line][k] for line in lines), default=0.0) for k in (0, 1))
        capitals, marks = sum(map(str.isupper, text)), Counter(c for c in text if c in "!?.,;:*#$%&@")
        return [
            hits * per, weight * per, strongest, surest, float(len(lines)), near / max(1, hits), second * per, capitals * chars, shouted * per,
            (marks["!"] + marks["?"]) * chars, marks.total() * chars, obfuscated * per, obfuscated_hits * per, math.log1p(n),
        ]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learnable: Column) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic, fold) of the labelled sample, and for each class how many labelled documents a sampled one stands for.

    Of rows that share a doc_id one is taken; of labels that contradict each other, toxic."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(F.col(id_col).isNotNull() & learnable).select(F.col(id_col).alias("doc_id")).distinct()
    known = saved(marked.join(ids, "doc_id", "left_semi").select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "toxicity-labels")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    few = [known.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(n) for t, n in SAMPLE.items()]
    chosen = few[0].union(few[1]).select("doc_id", "toxic")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))  # at most sum(SAMPLE) ids
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", "h").alias("text"))
    return one.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), {t: n / min(n, SAMPLE[t]) for t, n in totals.items()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, toxic, fold, n): documents of a batch with a lexicon line."""
    for b in batches:
        found: Counter = Counter()
        for text, toxic, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = {plain(w) for words in words_of(text) for w in set(words)}
            found.update((e, toxic, fold) for e in {e for w in own for e in entries(w)})
        if found:
            line, toxic, fold = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.string()), *(pa.array(x, pa.int32()) for x in (toxic, fold)), pa.array(found.values(), pa.int64())], ["line", "toxic", "fold", "n"])


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Of each fold learned without it, and at last learned from all."""
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}  # 2 * FOLDS rows
    counts = saved(sample.select("text", "toxic", "fold").mapInArrow(_counted, "line string, toxic int, fold int, n long").groupBy("line", "toxic", "fold").agg(F.sum("n").alias("n")), "toxicity-lines")
    out = []
    for without in range(FOLDS + 1):
        size = {t: sum(n for (x, fold), n in sizes.items() if x == t and fold != without) for t in (0, 1)}
        of = lambda t: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") != without), F.col("n")).otherwise(0)).cast("double")  # noqa: E731, B023
        by_line = counts.groupBy("line").agg(of(1).alias("t"), of(0).alias("c")).where(F.col("t") >= LEAST_DOCS)
        odds = F.log((F.col("t") + 0.5) / (size[1] + 1)) - F.log((F.col("c") + 0.5) / (size[0] + 1))
        both, share = F.col("t") + F.col("c"), size[1] / max(1, size[0] + size[1])
        g = 2 * (F.col("t") * F.log(F.col("t") / (both * max(share, 1e-9))) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * max(1 - share, 1e-9)))).otherwise(0.0))
        best = by_line.select("line", odds.alias("odds"), g.alias("g")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G)).orderBy(F.desc("g"), "line").limit(LINES)
        out.append({r["line"]: (round(r["odds"], 4), round(math.log(r["g"]), 4)) for r in best.collect()})
    return out


def with_features(rows: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """rows (text, fold, ...) with an array of features in place of the text, by the lexicon of the fold."""
    rest = [c for c in rows.columns if c not in ("text", "fold")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in lexicons]
        for b in batches:
            found = [readers[fold].features(text) for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), b.column("fold"), pa.array(found, pa.list_(pa.float64()))], [*rest, "fold", "features"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", fold int, features array<double>")


class Model:
    """Lexicon, trees and calibration. Where the sample lacks a class, its score is the other class."""

    def __init__(self, sample: DataFrame, weights: dict[int, float]):
        self.constant = None if len(weights) == 2 else float(max(weights, default=0))
        if self.constant is not None:
            return
        lexicons = learn_lexicons(sample)
        self.lexicon = lexicons[-1]
        tasks = min(8, sample.sparkSession.sparkContext.defaultParallelism)
        rows = saved(with_features(sample.select("text", "toxic", "fold"), lexicons).coalesce(tasks), "toxicity-features")
        told = rows.select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("features").alias("features"))
        weight = F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])
        held, rest = told.where(F.col("fold") == FOLDS - 1), told.where(F.col("fold") < FOLDS - 1)
        if held.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
            held = rest = told  # too few to set some apart
        gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, checkpointInterval=-1)
        self.trees = gbt.fit(rest)
        self.calibration = IsotonicRegression(featuresCol="raw", weightCol="weight").fit(self._raw(held).withColumn("weight", weight))

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows (text, ...) with a score in place of the text."""
        if self.constant is not None:
            return rows.withColumn("score", F.lit(self.constant)).drop("text")
        found = with_features(rows.withColumn("fold", F.lit(0)), [self.lexicon]).withColumn("features", array_to_vector("features"))
        return self.calibration.transform(self._raw(found)).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))).drop("features", "raw", "prediction", "fold")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row. Null text: empty, which gets a score like any other.

    Learns from labels of ids whose crc32(id as text) mod 5 is not 0; a null id is not held out and has no label."""
    arrow_limits(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    sample, weights = training_rows(docs, labels, id_col, text_col, ~held_out)
    model = Model(saved(sample, "toxicity-sample"), weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return model.scores(rows).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
