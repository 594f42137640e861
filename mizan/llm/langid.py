"""Language identification by cross-parsing.

For each language a suffix automaton of a labelled sample knows every string that stands in it. A text, its letters in lower
case and all else one space, is parsed from its first to its last character into the longest strings that the automaton knows,
across words. Each phrase costs the bits that name a place in the sample, so languages with smaller samples are not
favoured; the language with the cheapest parse wins.

Parsing is vectorized: texts are cut into chunks that advance side by side, each from a fresh start at first. A chunk is then
parsed again from the state in which the one before it ended, until both parses are in one state, from where on
they agree. So the phrases are those of the whole text, and no text holds up the others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, whole_row

#: Bounds of the labelled sample: documents of a language, and characters of them in all.
SAMPLE_DOCS, SAMPLE_CHARS = 180, 60_000
#: Characters of a chunk, and characters that are parsed together.
CHUNK, TOGETHER = 1024, 1 << 22
#: Cells of a transition table; larger automata, of scripts with thousands of letters, are searched instead.
CELLS = 1 << 25
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Of each code point: the lower-case letter, or a space."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], np.int32)


def normalized(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``letters`` says of the code points of all texts one after another, each from one space to another, runs of spaces
    made one; and the length of each."""
    raw, space = "".join([f" {t} " for t in texts]), letters[32]
    ends = np.cumsum([len(t) + 2 for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    parts, upto, kept, blank_before = [letters[:0]], [np.zeros(1, np.int64)], 0, False
    for i in range(0, len(raw), TOGETHER):  # in steps, for the sake of very long texts
        own = letters[np.frombuffer(raw[i : i + TOGETHER].encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = own == space
        stays = ~blank
        stays[1:] |= ~blank[:-1]
        stays[0] |= not blank_before
        stays[starts[(starts >= i) & (starts < i + len(own))] - i] = True
        count = np.cumsum(stays)
        upto.append(kept + count[ends[(ends > i) & (ends <= i + len(own))] - i - 1])
        parts.append(own[stays])
        kept, blank_before = kept + int(count[-1]), blank[-1]
    return np.concatenate(parts), np.diff(np.concatenate(upto))


def automaton(codes: list[int]) -> np.ndarray:
    """Transitions (state, code, to) of the suffix automaton of a string; the start is 0, to which none leads."""
    nexts: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array([(s, c, t) for s, own in enumerate(nexts) for c, t in own.items()], np.int64).reshape(-1, 3)


class Parser:
    """Parses texts by several automata at once. States of all are rows of one table; a state is its row's first cell."""

    def __init__(self, automata: list[np.ndarray]):
        alphabet = np.unique(np.concatenate([a[:, 1] for a in automata]))
        self.width = len(alphabet) + 1  # symbol 0: in no sample
        symbols = np.zeros(0x110000, np.min_scalar_type(self.width))
        symbols[alphabet] = np.arange(1, len(alphabet) + 1)
        self.letters = symbols[_folded()]
        states = [int(a[:, [0, 2]].max(initial=0)) + 1 for a in automata]
        bases = np.cumsum([0, *states])
        self.roots = bases[:-1] * self.width
        keys = np.concatenate([(a[:, 0] + b) * self.width + symbols[a[:, 1]] for a, b in zip(automata, bases, strict=False)])
        to = np.concatenate([(a[:, 2] + b) * self.width for a, b in zip(automata, bases, strict=False)])
        if bases[-1] * self.width <= CELLS:
            self.table = np.zeros(int(bases[-1]) * self.width, np.int32)
            self.table[keys] = to
            self.step = self.table.__getitem__
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], 0)
            self.step = self._search

    def _search(self, cells: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, cells)
        return np.where(self.keys[at] == cells, self.to[at], 0)

    def _advance(self, state: np.ndarray, root: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol, and how many phrases ended: the one before it, and the symbol itself if no sample has it."""
        to = self.step(state + symbol)
        fresh = to == 0
        ended = fresh & (state != root)
        to = np.where(fresh, self.step(root + symbol), to)
        unknown = to == 0
        return np.where(unknown, root, to), ended.astype(np.int64) + unknown

    def phrases(self, symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, automata): phrases of each text, given as symbols."""
        per = np.maximum(1, -(-sizes // CHUNK))
        text = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(CHUNK, sizes[text] - number * CHUNK)
        order = np.argsort(-length, kind="stable")
        lane_of = np.empty(len(order), np.int64)
        lane_of[order] = np.arange(len(order))
        begin = ((np.cumsum(sizes) - sizes)[text] + number * CHUNK)[order]
        size, follows = length[order], (number > 0)[order]
        before = np.where(follows, lane_of[np.maximum(order - 1, 0)], -1)
        steps = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # lanes longer than each step
        n_models, n = len(self.roots), np.zeros((len(self.roots), len(order)), np.int64)
        root = np.repeat(self.roots[:, None], len(order), axis=1)
        state = root.copy()
        for t, k in enumerate(steps.tolist()):
            state[:, :k], more = self._advance(state[:, :k], root[:, :k], symbol[begin[:k] + t])
            n[:, :k] += more
        # from the true states: chunk by chunk until nothing changes
        started = root
        while True:
            carry = np.where(before >= 0, state[:, before], root)
            model, lane = np.nonzero(carry != started)
            if not len(lane):
                break
            a, b, r = carry[model, lane], started[model, lane], self.roots[model]
            more, to = np.zeros(len(lane), np.int64), state[model, lane]
            active, t = np.arange(len(lane)), 0
            while len(active):
                over = size[lane[active]] <= t
                to[active[over]] = a[active[over]]
                active = active[~over & (a[active] != b[active])]
                s = symbol[begin[lane[active]] + t]
                a[active], plus = self._advance(a[active], r[active], s)
                b[active], minus = self._advance(b[active], r[active], s)
                more[active] += plus - minus
                t += 1
            n[model, lane] += more
            state[model, lane] = to
            started = carry
        out = np.zeros((len(sizes), n_models), np.int64)
        last = lane_of[np.cumsum(per) - 1]
        np.add.at(out, text[order], n.T)
        return out + (state[:, last] != self.roots[:, None]).T


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[int]]:
    """Code points of the sample of each label: whole texts of at most SAMPLE_DOCS distinct documents of the language, drawn over
    all rows by a hash of id and text, until the next would pass SAMPLE_CHARS in all; longer documents are not drawn. Null
    ids and repeated rows make it no larger."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(key)).collect()}  # a row for each language
    if not counts:
        return {}
    # above the limit by more than the estimate's error, so that the limit below decides
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * SAMPLE_DOCS / n)))), F.col(lang_col))
    draw = (key.bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("draw")
    text, n = F.col(text_col).cast("string"), F.length(text_col)
    drawn = rows.where(n <= SAMPLE_CHARS).select(F.col(lang_col).alias("lang"), draw, text.alias("text")).where(F.col("draw") < share)
    once = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))  # repeated rows meet in their own task
    order = Window.partitionBy("lang").orderBy("draw")
    first = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    whole = first.withColumn("sum", F.sum(F.length("text")).over(order)).where((F.col("sum") <= SAMPLE_CHARS) | (F.col("n") == 1))
    texts: dict[str, list[tuple[float, str]]] = {}
    for r in whole.collect():
        texts.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return {lang: normalized([" ".join(t for _, t in sorted(own))], _folded())[0].tolist() for lang, own in sorted(texts.items())}


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, tuple[int, np.ndarray]]:
    """Sample size and automaton of each label."""
    return {lang: (len(codes), automaton(codes)) for lang, codes in samples(docs, id_col, text_col, lang_col).items()}


class Scorer:
    def __init__(self, models: dict[str, tuple[int, np.ndarray]]):
        self.langs = list(models)
        self.bits = np.array([math.log2(n + 1) for n, _ in models.values()])
        self.parser = Parser([a for _, a in models.values()]) if models else None

    def _some(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        symbols, sizes = normalized(texts, self.parser.letters)
        cost = self.parser.phrases(symbols, sizes) * self.bits
        best = np.argsort(cost, axis=1, kind="stable")
        for own, ranked, size in zip(cost.tolist(), best.tolist(), sizes.tolist(), strict=True):
            if size <= 2:  # spaces alone: no letter
                yield UNKNOWN, 0.0
            elif len(ranked) == 1:
                yield self.langs[0], 1.0
            else:
                yield self.langs[ranked[0]], 1 - own[ranked[0]] / own[ranked[1]]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out, some, total = [], [], 0
        for t in texts:
            some.append(t or "")
            total += len(some[-1])
            if total >= TOGETHER:
                out += self._some(some)
                some, total = [], 0
        return out + list(self._some(some)) if some else out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, held_out, lang_pred, score): each of docs' rows, as one struct of all its columns, and what is said of it.

    ``und`` with score 0 where text is null or has no letter, or nothing was learned. Score: by how much the best language
    costs less than the second. Ties go to the first name. A null id is not held out. Repeated rows stay.
    """
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, train(docs, id_col, text_col, lang_col)))
    src = docs.select(whole_row(), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(*shared.value)
        for b in batches:
            said = scorer(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], schema.names)

    return src.mapInArrow(run, schema)


_SCORERS: dict[str, Scorer] = {}


def scorer_of(name: str, models: dict[str, tuple[int, np.ndarray]]) -> Scorer:
    """One for each worker and training: its tables are built once."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(models)
    return _SCORERS[name]


def op8(documents: DataFrame) -> DataFrame:
    return identify(documents.select("doc_id", "text", "lang")).select("row.doc_id", "held_out", "lang_pred", "score")
