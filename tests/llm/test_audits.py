"""Source divergence, filter interaction and toxicity against brute force, odd rows and held-out accuracy."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from mizan.llm import divergence, filter_audit, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bits int, part string, term string, digest string, fold int, features string, label int"
LABELS = "doc_id long, quality int, toxic int, source string, text string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 9, 1, "x", "y", "z", 3, "f", 8) for r in rows], DOCS)


def odd_rows():
    rnd = random.Random(5)
    stock = ["aa bb cc", "Ein WORT", "", None, "a\x00b c", "één über ÉÉ x", "#tag", "same same same", "\U0001f600", "x" * 3000, "w " * 250, " ".join(f"w{i}q" for i in range(300))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(stock), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "ß", "", None])) for _ in range(150)]
    return [*rows, *rows[:10], (900, "lonely words", "xx", "alone"), (901, "1 2 3", "yy", "s1"), (902, None, "yy", "s2")]


# source divergence


def divergence_by_hand(rows, least):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in seen if seen[t] >= least), key=str.encode)
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        every = sum(counts.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))  # noqa: E731, B023
        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), other.encode()) for other, o in counts.items() if other != s]
            terms = [(share(every, t) - share(c, t), t.encode()) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least, cells", [(30, 1 << 18), (3, 1 << 18), (2, 8)])
def test_divergence_equals_brute_force(spark, monkeypatch, least, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)  # with 8: many chunks
    rnd = random.Random(least)
    vocabulary = ["".join(rnd.choice("abüzé") for _ in range(rnd.randint(1, 3))) for _ in range(90)]
    rows = odd_rows() + [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de"]), rnd.choice(["s1", "s1", "s2", "s3"])) for i in range(300)]
    got = divergence.diverge(docs_of(spark, rows), least)
    found = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == divergence_by_hand(rows, least)


def test_divergence_of_no_documents(spark):
    assert divergence.diverge(docs_of(spark, [])).collect() == []


def test_shares_are_exact():
    rnd = random.Random(1)
    totals = [rnd.randrange(1, 1 << 52) for _ in range(500)]
    counts = [rnd.randrange(t + 1) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]


def test_tasks_hand_on_what_they_counted(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTED", 20)
    rows = odd_rows()
    assert {tuple(r) for r in divergence.diverge(docs_of(spark, rows), 3).select("lang", "source", "part", "item", "value", "rank").collect()} == divergence_by_hand(rows, 3)


# words of long texts


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 50)
    monkeypatch.setattr(words, "CLASS", 200)
    rnd = random.Random(3)
    text = b"".join(rnd.choice([b"ab", b"c", b"long" * 40, b" ", b"\n "]) for _ in range(900))
    gap = re.compile(rb"[\x20\x09-\x0D]")
    assert b"".join(words.pieces(text, gap)) == text
    assert [w for p in words.pieces(text, gap) for w in p.split()] == text.split()
    sets = list(words.distinct(text, gap, bytes.split))
    assert len(sets) > 5 and set().union(*sets) == set(text.split()) and sum(map(len, sets)) == len(set(text.split()))


# filter interaction


def fails_by_hand(rows):
    least = {}
    for i, text, _, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, _, source in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        yield i, source or "", {f for f, x in bad.items() if x}


def test_filter_audit_equals_brute_force(spark):
    rows = odd_rows()
    labels = [(i, i % 2, i % 3, "s", "t") for i in range(30)] + [(4, 1, None, "s", "t"), (4, 0, 1, "s", "t"), (None, 1, 1, None, None), (77, 1, 1, "s", "t")]
    good, toxic = {r[0] for r in labels if r[1] == 1 and r[0] is not None}, {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    judged, want = list(fails_by_hand(rows)), {}
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                failing = sum(letter in f for _, f in own)
                want[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in want.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    got = filter_audit.audit(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = got.collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found} == want and len(found) == len(want)


def test_filter_audit_of_no_documents_and_no_labels(spark, monkeypatch):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs_of(spark, []), none).collect() == []
    monkeypatch.setattr(filter_audit, "PARTS", 1)  # a task hands on its parts one by one
    rows = odd_rows()
    got = filter_audit.audit(docs_of(spark, rows), none).where("filter_order = 'ABCDE' and step = 1").collect()
    assert sum(r["kept"] + r["removed"] for r in got) == len(rows) and not any(r["good_lost"] or r["toxic_lost"] for r in got)


def test_first_failures():
    at = filter_audit.ORDERS.index("CABED")
    assert filter_audit.FIRST.shape == (32, 120)
    assert [filter_audit.FIRST[x, at] for x in (0b00100, 0b00011, 0b01000, 0b10000, 0)] == [0, 1, 4, 3, 5]


# toxicity


def toxic_texts(n, seed=2):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice(("ba", "do", "ki", "lu", "me", "po")) for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    for i in range(n):
        text = [rnd.choice(clean) for _ in range(rnd.randint(20, 120))]
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randint(2, 6) * toxic):  # a word, or a stem with an ending
            text.insert(rnd.randrange(len(text)), rnd.choice(["zudrok", "you zudrok", "grimp" + rnd.choice(clean), "z0drok", "GRIMP" + rnd.choice(clean)]))
        yield i, " ".join(text), int(toxic)


def test_toxicity_finds_held_out_documents(spark):
    rows = list(toxic_texts(900))
    docs = docs_of(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y, "s", "t") for i, _, y in rows], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(y for _, y in held) > 20
    assert sum(s >= 0.5 for s, y in held if y) >= 0.95 * sum(y for _, y in held) and sum(s >= 0.5 for s, y in held if not y) <= 0.01 * len(held)


def test_toxicity_of_odd_rows(spark):
    rows = odd_rows()
    docs = docs_of(spark, rows)
    none = spark.createDataFrame([], LABELS)
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(rows) and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    few = spark.createDataFrame([(i, 0, int(i < 3), None, None) for i in range(20)] + [(1, 0, 0, None, None), (2, 0, None, None, None), (None, 0, 1, None, None)], LABELS)
    got = toxicity.score(docs, few).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.score(docs_of(spark, []), few).collect() == []


def test_toxic_features(monkeypatch):
    lexicon = {"=idiot": (3.0, 4.0), "grimp": (2.0, 3.0)}
    of = lambda t: dict(zip(toxicity.FEATURES, toxicity.Reader(lexicon).features(t), strict=True))
    assert toxicity.plain("1d.i0T") == "idiot" and toxicity.plain("soooo") == "so"
    x = of("You are an IDIOT and a grimpster, 1di0t!")
    assert round(x["hits"]) == round(300 / 8) and x["strongest"] == 3 and x["surest"] == 4 and x["lines"] == 2 and x["near"] == 1 / 3 and x["obfuscated_hits"] == 12.5
    assert of("")["hits"] == 0 == of("")["capitals"] and of("idiot")["near"] == 0
    text = " ".join(random.Random(4).choice(["you", "idiot", "calm", "grimpo"]) for _ in range(500))
    whole = of(text)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert of(text) == whole
