"""Which of many terms stand in a text, in one reading of it: an Aho-Corasick automaton over all terms, built once a worker.

The time for a text follows its length and the terms that it holds, not the number of terms or of the courses that use them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=16)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            found.add_word(t, i)
    if not len(found):
        return None
    found.make_automaton()
    return found


def standing(text: str, terms: tuple[str, ...]) -> set[int]:
    """Places of the terms that stand in a text; terms are distinct, empty ones stand nowhere."""
    automaton = _automaton(terms)
    return {i for _, i in automaton.iter(text)} if automaton and text else set()


def told_by_terms(text: Column, terms: Iterable[str], tell: Callable[[set[int]], list[dict]], kind: pa.DataType, ddl: str) -> Column:
    """array of what tell() makes of the terms of each text; kind and ddl: the type of its elements, for Arrow and for Spark."""
    own = tuple(terms)

    @F.arrow_udf(f"array<{ddl}>")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([tell(standing(t, own)) if t else [] for t in texts.to_pylist()], pa.list_(kind))

    return told(text)
