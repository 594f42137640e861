"""All terms of all courses in one reading, against a reading for each course."""

import random

from pyspark.sql import functions as F

from mizan.functions.terms import standing
from mizan.operators import retrieve
from mizan.operators.retrieve import Course

WORDS = ["العقد", "التعويض", "ضرر", "عقد العمل", "الضمان", "اب", "contract", "breach of contract", "court", "damage", "tort", "er", "القانون", "في"]


def courses(rnd, n):
    pick = lambda most: tuple(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, most)))
    return [Course(f"c{i}", keywords=pick(5), priority=pick(4), secondary=pick(2), avoid=pick(3), preferred=("s1",) if i % 2 else ()) for i in range(n)] + [Course("method", "methodological", avoid=("tort",)), Course("bare")]


def cases(spark, rnd, n=120):
    text = lambda: " ".join(rnd.choice([*WORDS, "x", "يوم", "الوقائع", "حيث", "حكمت"]) for _ in range(rnd.randint(0, 25)))
    rows = [(i, rnd.choice([text(), text(), None, ""]), rnd.choice(["s1", "s2", None]), rnd.choice(["7", None]), "c", i) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, text string, source_id string, case_number string, court_name string, indexed_at int")
    return df.withColumn("normalized_text", F.col("text"))


def test_standing():
    rnd = random.Random(1)
    terms = tuple(dict.fromkeys("".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 4))) for _ in range(40)))
    for _ in range(200):
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 15)))
        assert standing(t, terms) == {i for i, x in enumerate(terms) if x and x in t}
    assert standing("abc", ()) == set() and standing("", ("a",)) == set()


def test_scores_of_all_courses(spark):
    rnd = random.Random(2)
    own, df = courses(rnd, 9), cases(spark, rnd)
    got = {(r["id"], r["slug"]): r["match_score"] for r in retrieve.scores_by_course(df, own).collect()}
    want = {}
    for c in own:
        terms = retrieve.retrieval_terms(retrieve.subject_terms(c))
        if terms:
            score = retrieve.match_score(F.col("normalized_text"), terms, F.coalesce(F.col("source_id").isin(*c.preferred), F.lit(False)) if c.preferred else F.lit(False), retrieve.present(F.col("case_number")), retrieve.present(F.col("court_name")))
            want |= {(r["id"], c.slug): r["s"] for r in df.where(retrieve.any_of(F.col("normalized_text"), terms)).select("id", score.alias("s")).collect()}
    assert got == want and len({s for _, s in got}) > 7


def test_relevance_of_all_courses(spark):
    rnd = random.Random(3)
    own, df = courses(rnd, 9), cases(spark, rnd)
    fields = ["score", "accepted", "direct_hits", "priority_hits", "avoid_hits", "matched"]
    got = {(r["id"], r["slug"]): tuple(r[f] for f in fields) for r in retrieve.assess(df, own).collect()}
    plain = df.withColumn("plain", retrieve.normalize_relevance(F.col("text")))
    nothing = {r["id"] for r in df.where("text is null").collect()}
    for c in own:
        for r in plain.select("id", retrieve.relevance(c, F.col("text"), F.col("plain")).alias("r")).collect():
            one = tuple(r["r"][f] for f in fields)
            if r["id"] in nothing and c.mode == "direct":
                one = (8, False, 0, 0, 0, [])  # no text, no concepts
            assert got.pop((r["id"], c.slug)) == one, c
    assert not got


def test_fallback_computes_the_local_side_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("1", "c", "u1", 1), ("2", "c", "u2", 2)], "case_number string, court_name string, url string, pos int")
    local = rows.mapInArrow(counted, rows.schema)
    remote = spark.createDataFrame([("3", "c", "u3", 1)], rows.schema)
    assert [r["case_number"] for r in retrieve.with_fallback(local, lambda: remote, 5, 3).collect()] == ["1", "2", "3"]
    assert seen.value == 2
