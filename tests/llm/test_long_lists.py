"""Alignments of pages with very many elements."""

import random

from mizan.llm import wrappers


def test_long_lists_are_aligned_as_short_ones():
    rnd = random.Random(11)
    for names, n in ((3, 600), (40, 700), (900, 520)):
        a, b = ([f"n{rnd.randrange(names)}" for _ in range(n + k)] for k in (0, 9))
        got = [(i, j) for i, j in wrappers.pairs(a, b) if i is not None and j is not None]
        assert got == list(wrappers._by_table(a, b))


def test_rows_of_bits_against_the_table(monkeypatch):
    rnd = random.Random(12)
    for _ in range(2000):
        names = "abcdefgh"[: rnd.randint(1, 8)]
        a, b = (rnd.choices(names + extra, k=rnd.randint(0, 14)) for extra in "xy")
        monkeypatch.setattr(wrappers, "ROW_BITS", rnd.choice((0, 40, 1 << 20)))
        monkeypatch.setattr(wrappers, "FREQUENT", rnd.choice((0, 1, 10)))
        assert list(wrappers._by_rows(a, b)) == list(wrappers._by_table(a, b))


def test_a_page_of_many_elements_is_met_whole():
    """A page has all that another one has, behind elements of the same names; nothing that both have is left out."""
    rnd = random.Random(13)
    names = [f"p.k{k}" for k in range(80)]
    own, before = rnd.choices(names, k=700), rnd.choices(names, k=300)
    element = lambda x: wrappers.Node(x, [wrappers.Node("#", None, hash=rnd.randrange(1 << 40), chars=9)])
    runs = lambda x: [element(k) for k, last in zip(x, [None, *x], strict=False) if k != last]
    short, long = (wrappers.Node("", runs(x)) for x in (own, [*before, "p.mark", *own]))
    one = wrappers.align(short, long)
    assert sum(k.parents == 2 for k in one.kids) == len(short.kids)
    assert all(wrappers.matched(mark_all(one), short))


def mark_all(n):
    for k in wrappers._leaves(n):
        k.keep = True
    return n
