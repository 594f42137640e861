"""Retrieval, course relevance, candidate and policy scores, and the choice among candidates.

Courses are few and known to the driver. One automaton over the terms of all courses reads each text once and tells which
courses have terms in it, so scoring is one pass over the cases, whatever the number of courses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import search_form
from ..functions.text import ARABIC_DIGITS, ASCII_DIGITS, LETTER_FORMS, MARKS, PLAIN_FORMS, TATWEEL, hits, normalize_identity, normalize_relevance
from ..functions.terms import told_by_terms
from ..shared import allow_checkpoints, arrow_limits

# Words that say nothing about a course, and those that retrieval terms leave out.
GENERIC_WORDS = frozenset((
    "القانون", "القانوني", "القانونية", "الحكم", "قضية", "القضية", "الدعوى", "المحكمة", "المحاكم", "المقرر", "المادة", "المواد", "الحق", "الحقوق",
    "الاختصاص", "النظام", "النظامية", "المبدأ", "مبدأ", "المبادئ", "العام", "العامة", "عامة", "تنظيم", "تنظيمية", "تطبيق", "تطبيقات", "مسألة",
    "المسألة", "أثر", "اثر", "بيان", "مدى", "حكم", "نزاع", "يتناول", "يرتبط", "يتعلق", "في", "من", "على", "عن", "إلى", "الى", "مع", "أو", "او", "بين",
    "عند",
))
STOPWORDS = frozenset((
    "القانون", "القانوني", "القانونية", "القضية", "قضية", "حكم", "الحكم", "المقرر", "المادة", "المحكمة", "المحاكم", "مناسب", "مناسبة", "يظهر", "بيان",
    "تحليل", "صلة", "موضوع", "موضوعات", "مفهوم", "مفاهيم", "تطبيق", "تطبيقات", "أثر", "اثر", "مدى", "حالة", "حالات", "يناقش", "تصلح", "يمكن", "فيها",
    "عليه", "عنها", "هذه", "ذلك", "التي", "الذي", "على", "إلى", "الى", "عن", "من", "في", "مع", "أو", "او", "بين", "الحق", "الحقوق", "الاختصاص",
    "النظام", "العامة", "العام", "تنظيم",
))
# Phrases of a methodological course, by category with its label, and its retrieval terms.
METHOD_CATEGORIES = {
    "وقائع واضحة": ("الوقائع", "وقائع", "المدعي", "المدعى عليه", "طلب المدعي", "أقام دعواه"),
    "تسبيب قابل للتحليل": ("الأسباب", "حيث", "ولما", "لما كان", "ثبت", "التسبيب", "مستند الحكم"),
    "منطوق أو نتيجة واضحة": ("حكمت", "فحكمت", "قررت", "لذلك", "منطوق الحكم", "الحكم"),
    "بيانات رسمية قابلة للتوثيق": ("رقم القضية", "رقم الدعوى", "رقم الصك", "رقم القرار", "محكمة الاستئناف"),
}
METHOD_TERMS = ("المدعي", "المدعى عليه", "الوقائع", "حيث", "حكمت", "قررت", "رقم القضية", "رقم الدعوى")
MAX_TERMS, MAX_MATCHED = 40, 8
#: The most recent rows that are scored, of the limit and absolutely.
RECALL_FACTOR, RECALL_LEAST, RECALL_CAP = 16, 40, 600
WEIGHTS = {"subject_relevance": 40, "legal_issue_clarity": 20, "reasoning_quality": 15, "academic_commentary_value": 15, "source_pdf_quality": 10}


@dataclass(frozen=True)
class Course:
    slug: str
    mode: str = "direct"
    keywords: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    preferred: tuple[str, ...] = field(default=())


def plain_term(term: str) -> str:
    """N1 of one term, see functions.text."""
    out = re.sub(MARKS, "", term.translate(str.maketrans(ARABIC_DIGITS, ASCII_DIGITS))).replace(TATWEEL, "")
    out = out.translate(str.maketrans(LETTER_FORMS, PLAIN_FORMS))
    return " ".join(re.sub(r"[^0-9A-Za-z؀-ۿ/\- ]+", " ", out).split()).lower()


def retrieval_terms(terms: list[str]) -> list[str]:
    """Plain forms of two characters or more, each once, in order."""
    return [t for t in dict.fromkeys(map(plain_term, terms)) if len(t) >= 2]


def subject_terms(course: Course) -> list[str]:
    """A course's phrases, then the telling words of its keywords and priority topics; at most MAX_TERMS."""
    if course.mode == "methodological":
        return list(METHOD_TERMS)
    words = (w for p in (*course.keywords, *course.priority) for w in plain_term(p).split())
    telling = (w for w in words if len(w) >= 4 and w not in STOPWORDS and not w.isdigit())
    first: dict[str, str] = {}
    for term in (*course.keywords, *course.priority, *course.secondary, *telling):
        if len(plain := plain_term(term)) >= 2:
            first.setdefault(plain, term.strip())
    return list(first.values())[:MAX_TERMS]


def match_score(text: Column, terms: list[str] | Column, preferred: Column, has_number: Column, has_court: Column) -> Column:
    """Earlier terms weigh more, phrases five more; known source, number and court add. terms: plain forms."""
    own = F.array(*map(F.lit, terms)) if isinstance(terms, list) else terms
    weighted = F.transform(own, lambda t, i: F.when(F.contains(text, t), F.greatest(F.lit(1), 14 - F.least(i, F.lit(13))) + F.when(F.contains(t, F.lit(" ")), 5).otherwise(0)).otherwise(0))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return (total + F.when(preferred, 14).otherwise(0) + F.when(has_number, 4).otherwise(0) + F.when(has_court, 3).otherwise(0)).cast("int")


def term_scores(text: Column, courses: list[Course]) -> Column:
    """array<struct<slug, own>> of the courses that have a term in a text: what their terms add to match_score. text: N1."""
    users: dict[str, list[tuple[str, int]]] = {}
    for c in courses:
        for i, t in enumerate(retrieval_terms(subject_terms(c))):
            users.setdefault(t, []).append((c.slug, max(1, 14 - min(i, 13)) + 5 * (" " in t)))
    by_place = list(users.values())

    def tell(found: set[int]) -> list[dict]:
        own: dict[str, int] = {}
        for i in found:
            for slug, weight in by_place[i]:
                own[slug] = own.get(slug, 0) + weight
        return [{"slug": s, "own": w} for s, w in own.items()]

    return told_by_terms(text, users, tell, pa.struct([("slug", pa.string()), ("own", pa.int32())]), "struct<slug: string, own: int>")


def scores_by_course(cases: DataFrame, courses: list[Course]) -> DataFrame:
    """(…, slug, match_score) of each case and course that has a term in it, by ``normalized_text``."""
    arrow_limits(cases.sparkSession)
    known = F.coalesce(*(F.when(F.col("slug") == c.slug, F.col("source_id").isin(*c.preferred)) for c in courses if c.preferred), F.lit(False))
    more = F.when(known, 14).otherwise(0) + F.when(present(F.col("case_number")), 4).otherwise(0) + F.when(present(F.col("court_name")), 3).otherwise(0)
    told = cases.withColumn("__x", F.explode(term_scores(F.col("normalized_text"), courses)))
    return told.select(*cases.columns, F.col("__x.slug").alias("slug"), F.col("__x.own").alias("__own")).withColumn("match_score", (F.col("__own") + more).cast("int")).drop("__own")


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def any_of(text: Column, terms: list[str]) -> Column:
    """True if any of the terms stands in a text, in one reading of it."""
    return F.regexp_like(text, F.lit("|".join(map(re.escape, terms)))) if terms else F.lit(False)


def recall(limit: int) -> int:
    """How many of the most recent matches are scored."""
    return max(RECALL_LEAST, min(limit * RECALL_FACTOR, RECALL_CAP))


def search(cases: DataFrame, terms: list[str], preferred: tuple[str, ...] = (), limit: int = 20, recall_cap: int | None = None, text: Column | None = None) -> DataFrame:
    """Cases (…, normalized_text, source_id, case_number, court_name, indexed_at, catalog_key) with any of the terms, the best
    ``limit`` by match score, then by recency and key. Only the ``recall_cap`` most recent are scored.

    text: where the plain text is not stored but computed, how; it then is computed once for each case, and again only for
    those that are scored."""
    plain = retrieval_terms(terms)
    cap = recall_cap or recall(limit)
    if not plain:
        return cases.limit(0).withColumn("match_score", F.lit(0))
    text = F.col("normalized_text") if text is None else text
    recent = cases.where(any_of(text, plain[:MAX_TERMS])).orderBy(F.col("indexed_at").desc(), "catalog_key").limit(cap)
    known = F.col("source_id").isin(*preferred) if preferred else F.lit(False)
    score = match_score(text, plain, known, present(F.col("case_number")), present(F.col("court_name")))
    return recent.withColumn("match_score", score).orderBy(F.col("match_score").desc(), F.col("indexed_at").desc(), "catalog_key").limit(max(1, limit))


def _concept(term: str) -> dict:
    plain = search_form(term, digits=False)
    tokens = list(dict.fromkeys(w for w in plain.split() if len(w) >= 3 and w not in GENERIC_WORDS and not w.isdigit()))
    return {"term": term, "phrase": plain, "tokens": tokens}


def concept_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """Terms whose concept stands in a text (N3): the phrase itself if any of its words says something; else its only
    telling word, of five characters or more; else two of its telling words."""
    out = []
    for c in map(_concept, terms):
        if not c["phrase"] or not c["tokens"]:
            continue
        whole = F.contains(text, F.lit(c["phrase"]))
        if len(c["tokens"]) == 1:
            part = F.contains(text, F.lit(c["tokens"][0])) if len(c["tokens"][0]) >= 5 else F.lit(False)
        else:
            part = F.size(hits(text, F.array(*map(F.lit, c["tokens"])))) >= 2
        out.append(F.when(whole | part, F.lit(c["term"])))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


RELEVANCE = "struct<score: int, accepted: boolean, direct_hits: int, priority_hits: int, avoid_hits: int, matched: array<string>>"
_RELEVANCE = pa.struct([("slug", pa.string()), ("direct", pa.list_(pa.string())), ("priority", pa.list_(pa.string())), ("avoid", pa.int32())])


def concepts_by_course(plain: Column, courses: list[Course]) -> Column:
    """array<struct<slug, direct, priority, avoid>> of the courses that have a concept in a text (N3): the hits of keywords and
    priority topics in their order, and the number of concepts to avoid; concepts count as in concept_hits."""
    places: dict[str, int] = {}
    concepts: list[tuple] = []  # (place of the phrase, places of words, words that must stand, [(course, role, order, term)])
    by_term: dict[str, int] = {}
    for c in courses:
        for role, terms in enumerate((c.keywords, c.priority, c.avoid)):
            for order, term in enumerate(terms):
                if term not in by_term:
                    told = _concept(term)
                    if not told["phrase"] or not told["tokens"]:
                        continue
                    words = [places.setdefault(t, len(places)) for t in told["tokens"]]
                    need = 2 if len(words) > 1 else 1 if len(told["tokens"][0]) >= 5 else 9
                    by_term[term] = len(concepts)
                    concepts.append((places.setdefault(told["phrase"], len(places)), words, need, []))
                concepts[by_term[term]][3].append((c.slug, role, order, term))
    touched: dict[int, list[int]] = {}
    for k, (phrase, words, _, _) in enumerate(concepts):
        for place in {phrase, *words}:
            touched.setdefault(place, []).append(k)

    def tell(found: set[int]) -> list[dict]:
        hit = {k for place in found for k in touched[place]}
        own: dict[str, tuple[list, list, list]] = {}
        for phrase, words, need, users in (concepts[k] for k in hit):
            if phrase in found or sum(w in found for w in words) >= need:
                for slug, role, order, term in users:
                    own.setdefault(slug, ([], [], []))[role].append((order, term))
        return [{"slug": s, "direct": [t for _, t in sorted(d)], "priority": [t for _, t in sorted(p)], "avoid": len(a)} for s, (d, p, a) in own.items()]

    return told_by_terms(plain, places, tell, _RELEVANCE, "struct<slug: string, direct: array<string>, priority: array<string>, avoid: int>")


def _relevance(score: Column, accepted: Column, n: Column, priority: Column, avoid: Column, found: Column) -> Column:
    return F.struct(
        score.cast("int").alias("score"), accepted.alias("accepted"), n.cast("int").alias("direct_hits"), priority.cast("int").alias("priority_hits"), avoid.cast("int").alias("avoid_hits"), found.alias("matched")
    )


def _by_concepts(direct: Column, first: Column, avoid: Column) -> Column:
    """Relevance of a direct course."""
    n, priority = F.size(direct), F.size(first)
    found = F.slice(F.array_distinct(F.concat(direct, first)), 1, MAX_MATCHED)
    score = F.greatest(F.lit(0), F.least(F.lit(40), 8 + n * 11 + priority * 5) - avoid * 8)
    return _relevance(score, ((n >= 1) | (priority >= 2)) & (score >= 18), n, priority, avoid, found)


def _by_method(course: Course, text: Column, plain: Column) -> Column:
    """Relevance of a methodological course."""
    avoid = F.size(concept_hits(plain, course.avoid))
    labels = [F.when(F.size(hits(plain, F.array(*(F.lit(search_form(p, digits=False)) for p in phrases)))) > 0, F.lit(label)) for label, phrases in METHOD_CATEGORIES.items()]
    found = F.array_compact(F.array(*labels))
    n, length = F.size(found), F.length(text)
    tier = F.when(length >= 5000, 13).when(length >= 2500, 10).when(length >= 1200, 6).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(40), 9 + n * 5 + tier) - avoid * 8)
    return _relevance(score, (n >= 3) & (length >= 1200) & (score >= 24), n, F.lit(0), avoid, found)


def relevance(course: Course, text: Column, plain: Column) -> Column:
    """struct<score, accepted, direct_hits, priority_hits, avoid_hits, matched>; plain: text by N3, computed once a case."""
    if course.mode == "methodological":
        return _by_method(course, text, plain)
    return _by_concepts(concept_hits(plain, course.keywords), concept_hits(plain, course.priority), F.size(concept_hits(plain, course.avoid)))


def assess(cases: DataFrame, courses: list[Course], text: str = "text") -> DataFrame:
    """A row for each case and course, with ``slug`` and the relevance fields; all direct courses are told by one reading."""
    arrow_limits(cases.sparkSession)
    direct, method = ([c for c in courses if (c.mode == "methodological") == m] for m in (False, True))
    plain = cases.withColumn("__plain", normalize_relevance(F.col(text)))
    every = F.array(*(F.struct(F.lit(c.slug).alias("slug"), _by_method(c, F.col(text), F.col("__plain")).alias("r")) for c in method)) if method else None
    if direct:
        plain = plain.withColumn("__told", concepts_by_course(F.col("__plain"), direct))
        told = F.transform("__told", lambda x: F.struct(x["slug"].alias("slug"), _by_concepts(x["direct"], x["priority"], x["avoid"]).alias("r")))
        none = F.array().cast("array<string>")
        silent = F.array_except(F.array(*(F.lit(c.slug) for c in direct)), F.transform("__told", lambda x: x["slug"]))
        rest = F.transform(silent, lambda s: F.struct(s.alias("slug"), _by_concepts(none, none, F.lit(0)).alias("r")))
        kind = f"array<struct<slug: string, r: {RELEVANCE}>>"
        both = F.concat(told.cast(kind), rest.cast(kind))
        every = both if every is None else F.concat(both, every.cast(kind))
    return plain.withColumn("__x", F.explode(every)).select(*cases.columns, "__x.slug", "__x.r.*")


def candidate_scores(relevance_score: Column, matched: Column, text: Column, number: Column, score: Column) -> dict[str, Column]:
    """Clarity, reasoning, commentary value and the estimate of a candidate."""
    clarity = F.when(present(number), 18).otherwise(14)
    reasoning = F.when(F.length(text) >= 1800, 13).otherwise(10)
    commentary = F.least(F.lit(15), 9 + F.size(matched) * 2 + F.floor(score / 30)).cast("int")
    estimate = F.least(F.lit(96), relevance_score + clarity + reasoning + commentary + 10).cast("int")
    return {"clarity": clarity, "reasoning": reasoning, "commentary": commentary, "estimated": estimate}


def candidates(cases: DataFrame, course: Course, excluded: DataFrame, limit: int) -> DataFrame:
    """Search, exclusion, relevance gate and scores of one course: the best ``limit`` in the order of the search."""
    found = search(cases, subject_terms(course), course.preferred, max(limit * 8, RECALL_LEAST))
    left = not_excluded(found, excluded)
    plain = left.where(F.length("pdf_sha256") == 64).withColumn("__plain", normalize_relevance(F.col("text")))
    judged = plain.withColumn("r", relevance(course, F.col("text"), F.col("__plain"))).where("r.accepted").drop("__plain")
    scores = candidate_scores(F.col("r.score"), F.col("r.matched"), F.col("text"), F.col("case_number"), F.col("match_score"))
    topics = F.array_join(F.slice("r.matched", 1, 3), "، ")
    out = judged.select("*", F.col("r.score").alias("subject_relevance"), topics.alias("topics"), *(c.alias(n) for n, c in scores.items())).drop("r")
    return out.orderBy(F.col("match_score").desc(), F.col("indexed_at").desc(), "catalog_key").limit(limit)


def candidates_by_course(cases: DataFrame, courses: list[Course], excluded: DataFrame, limit: int) -> DataFrame:
    """(slug, …): ``candidates`` of every course in one reading of the cases.

    A case is dealt to the courses whose terms it has; of each course the most recent are kept, ranked within tasks before
    they are shuffled, so what the courses share is small whatever the number of cases.
    """
    wanted = max(limit * 8, RECALL_LEAST)
    pick = lambda make: F.coalesce(*(F.when(F.col("slug") == c.slug, make(c)) for c in courses))
    best = lambda df, most, *order: df.withColumn("__rn", F.row_number().over(Window.partitionBy("slug").orderBy(*order))).where(F.col("__rn") <= most).drop("__rn")
    recency, ranked = (F.col("indexed_at").desc(), "catalog_key"), (F.col("match_score").desc(), F.col("indexed_at").desc(), "catalog_key")
    recent = best(scores_by_course(cases, courses), recall(wanted), *recency)
    left = not_excluded(best(recent, wanted, *ranked), excluded)
    plain = left.where(F.length("pdf_sha256") == 64).withColumn("__plain", normalize_relevance(F.col("text")))
    judged = plain.withColumn("r", pick(lambda c: relevance(c, F.col("text"), F.col("__plain")))).where("r.accepted").drop("__plain")
    return best(judged.withColumn("subject_relevance", F.col("r.score")).drop("r"), limit, *ranked)


def not_excluded(cases: DataFrame, excluded: DataFrame) -> DataFrame:
    """Cases whose number and court are not, both, those of an excluded case that has both."""
    keys = excluded.where(present(F.col("case_number")) & present(F.col("court_name"))).select(normalize_identity(F.col("case_number")).alias("__n"), normalize_identity(F.col("court_name")).alias("__c")).distinct()
    return cases.join(keys, (normalize_identity(cases["case_number"]) == keys["__n"]) & (normalize_identity(cases["court_name"]) == keys["__c"]), "left_anti")


def policy_score(estimated: Column, parts: dict[str, Column], official: Column, weights: dict[str, int] = WEIGHTS) -> dict[str, Column]:
    """Each component as given or as its share of the estimate (halves to even), within 0 and its weight; and the total."""
    share = F.least(F.lit(100), F.greatest(F.lit(0), estimated))
    out = {}
    for name, most in weights.items():
        if name == "source_pdf_quality":
            out[name] = F.when(official, most).otherwise(0)
        else:
            given = F.coalesce(parts.get(name, F.lit(None)).cast("int"), F.bround(F.lit(most) * share / F.lit(100.0), 0).cast("int"))
            out[name] = F.least(F.lit(most), F.greatest(F.lit(0), given))
    total = out["source_pdf_quality"]
    for name in list(weights)[:-1]:
        total = total + out[name]
    return out | {"total": F.least(F.lit(100), total)}


def select_candidates(ranked: DataFrame, group: str, score: str, tie: str, accept: int = 90, display: int = 3, margin: int = 5, require_margin: bool = True) -> DataFrame:
    """(group, mode, selected, visible): auto if the top score is high enough and far enough ahead, else manual."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    top = ranked.select(group, tie, score, F.row_number().over(order).alias("rn"), F.lead(score).over(order).alias("second"), F.count("*").over(Window.partitionBy(group)).alias("n")).where("rn = 1")
    ahead = F.col("second").isNull() | (F.col(score) - F.col("second") >= margin) | F.lit(not require_margin)
    auto = (F.col(score) >= accept) & ahead
    return top.select(
        group, F.when(auto, "auto").otherwise("manual").alias("mode"), F.when(auto, F.col(tie)).alias("selected"), F.when(auto, 1).otherwise(F.least(F.lit(max(display, 1)), F.col("n"))).cast("int").alias("visible")
    )


def merged(local: DataFrame, remote: DataFrame, limit: int) -> DataFrame:
    """Local, then remote rows (case_number, court_name, url, pos), each identity once, the first ``limit``."""
    both = local.withColumn("__source", F.lit(0)).unionByName(remote.withColumn("__source", F.lit(1)))
    key = [normalize_identity(F.col("case_number")), normalize_identity(F.col("court_name")), F.col("url")]
    first = both.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy("__source", "pos"))).where("__rn = 1")
    return first.orderBy("__source", "pos").limit(limit).drop("__rn", "__source")


class RemoteFailure(Exception):
    """The remote side could not answer."""


def with_fallback(local: DataFrame, remote: Callable[[], DataFrame], limit: int, minimum: int) -> DataFrame:
    """Local candidates; with too few of them, merged with what remote() gives. If that fails for want of an answer, the local
    ones if there are any. Other errors are no failure of the remote side and go up. The local rows are computed once."""
    allow_checkpoints(local.sparkSession)
    local = local.checkpoint()
    if local.limit(min(limit, minimum)).count() >= min(limit, minimum):
        return local.orderBy("pos").limit(limit)
    try:
        found = remote()
    except (RemoteFailure, OSError):
        if local.isEmpty():
            raise
        return local.orderBy("pos").limit(limit)
    return merged(local, found, limit)
