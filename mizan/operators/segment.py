"""From page texts to cases: best page text, case boundaries and ranges, range refinement, verification.

Pages are rows (doc_id, page_no from 1, text); those with headers also ``number``, the case number of the page's header or
null. All steps of a document share one exchange on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import judgment_number, labelled_numbers, normalize_case_number, primary_header
from ..functions.text import ARABIC_DIGITS, SPACE, key_of, normalize_arabic, normalize_signals, number_tokens, squeeze, strip, tokens_match

# Words that show structure in a page's text, and those that show a page is part of a judgment.
STRUCTURE = (
    "رقم القضية", "رقم الدعوى", "الدعوى", "رقم الصك", "الصك", "محكمة الدرجة الاولى", "محكمة الاستئناف", "رقم القرار", "قرار التصديق",
    "الموضوعات", "السند الشرعي", "السند النظامي", "ملخص القضية", "ملخص الدعوى", "المدعي", "المدعى عليه", "الحكم",
)
JUDGMENT = ("المدعي", "المدعى", "المحكمة", "القاضي", "القايض", "الحكم", "القرار", "الدعوى")
MIN_START, MIN_TAIL, MIN_CASE, MAX_CASE, PARSER_VERSION, MAX_PAGES = 100, 120, 350, 18_000, 6, 20


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def text_quality(text: Column, plain: Column, signals: tuple[str, ...] = STRUCTURE) -> Column:
    """Structure words weigh most, then script letters, numbers and length; broken characters cost. plain: text by N4."""
    found = F.size(F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(plain, s)))
    letters = F.regexp_count(text, F.lit(r"[؀-ۿ]"))
    groups = F.regexp_count(text, F.lit(rf"[0-9{ARABIC_DIGITS}]{{3,}}"))
    broken = F.regexp_count(text, F.lit("�"))
    third = lambda c, most, by: F.floor(F.least(c, F.lit(most)) / by)
    score = found * 220 + third(letters, 6000, 3) + F.least(groups, F.lit(20)) * 15 + third(F.length(plain), 8000, 8) - broken * 40
    return F.when(plain == "", 0).otherwise(score).cast("int")


def best_pages(pages: DataFrame, signals: tuple[str, ...] = STRUCTURE) -> DataFrame:
    """pages with engine_rank -> one text for each (doc_id, page_no): the best score, the lower rank on ties, '' if none."""
    usable = pages.select("doc_id", "page_no", "engine_rank", F.coalesce(strip(F.col("text")), F.lit("")).alias("text"))
    scored = usable.withColumn("plain", normalize_signals(F.col("text")))
    scored = scored.withColumn("quality", F.when(F.col("text") == "", -1_000_000).otherwise(text_quality(F.col("text"), F.col("plain"), signals)))
    best = F.max_by(F.struct("text", "quality", "engine_rank"), F.struct("quality", -F.col("engine_rank")))
    return scored.groupBy("doc_id", "page_no").agg(best.alias("b")).select("doc_id", "page_no", "b.text", "b.quality", "b.engine_rank")


def bounded_text(pages: DataFrame, max_chars: int, sep: str = "\n\n") -> DataFrame:
    """(doc_id, text): non-empty pages in order until their characters reach the bound, the last one cut there."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    kept = pages.where(F.length(F.trim("text")) > 0).select("doc_id", "page_no", F.trim("text").alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = kept.withColumn("room", F.lit(max_chars) - before).where("room > 0").withColumn("text", F.expr("substring(text, 1, cast(room as int))"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return cut.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), sep).alias("text"))


def with_headers(pages: DataFrame) -> DataFrame:
    return pages.withColumn("header", primary_header("text")).withColumn("number", F.col("header.case_number"))


def case_starts(pages: DataFrame, min_start: int = MIN_START) -> DataFrame:
    """pages with number -> eligible pages whose number is not that of the eligible page before."""
    eligible = pages.where((F.length("text") >= min_start) & F.col("number").isNotNull())
    before = F.lag("number").over(Window.partitionBy("doc_id").orderBy("page_no"))
    return eligible.withColumn("before", before).where(~F.col("number").eqNullSafe(F.col("before"))).drop("before")


def case_ranges(pages: DataFrame, min_start: int = MIN_START, min_tail: int = MIN_TAIL) -> DataFrame:
    """(doc_id, number, page_start, page_end, text): from each start to the page before the next one, without short pages
    at the end; texts joined by newlines."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    eligible = F.when((F.length("text") >= min_start) & F.col("number").isNotNull(), F.col("number"))
    before = F.last(eligible, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = eligible.isNotNull() & ~eligible.eqNullSafe(F.col("before"))
    dealt = pages.withColumn("before", before).withColumn("page_start", F.when(start, F.col("page_no")))
    dealt = dealt.withColumn("page_start", F.last("page_start", ignorenulls=True).over(order)).where("page_start is not null")
    long = (F.col("page_no") == F.col("page_start")) | (F.length(strip(F.col("text"))) >= min_tail)
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    cases = dealt.groupBy("doc_id", "page_start").agg(
        F.max(F.when(F.col("page_no") == F.col("page_start"), F.col("number"))).alias("number"), F.max(F.when(long, F.col("page_no"))).alias("page_end"), parts.alias("parts")
    )
    within = F.filter("parts", lambda p: p["page_no"] <= F.col("page_end"))
    return cases.select("doc_id", "number", "page_start", "page_end", F.array_join(F.transform(within, lambda p: p["text"]), "\n").alias("text"))


def running_cases(pages: DataFrame, min_start: int = MIN_START, min_tail: int = MIN_TAIL, max_chars: int = MAX_CASE) -> DataFrame:
    """case_ranges with texts cut to max_chars, as a table function over the pages of a document in order: it holds the running
    case alone, so memory does not follow the number of pages. Blanks before a case's text do not count."""
    kinds = dict(pages.dtypes)

    class Running:
        def __init__(self):
            self.before = self.case = None

        def eval(self, row):
            text, page = row["text"], row["page_no"]
            if row["number"] is not None:
                if row["number"] != self.before:
                    yield from self.terminate()
                    self.case = [row["doc_id"], row["number"], page, page, "", ""]  # its text, and what short pages may add
                self.before = row["number"]
            if self.case is None or text is None:
                return
            case = self.case
            room = max_chars - len(case[4]) - len(case[5])
            if room > 0:
                case[5] += ("\n" + text)[:room] if case[4] or case[5] else row["lead"][:room] if row["lead"] is not None else text[:room]
            if page == case[2] or row["long"]:
                case[3], case[4], case[5] = page, case[4] + case[5], ""

        def terminate(self):
            if self.case is not None:
                yield tuple(self.case[:5])
                self.case = None

    told = F.udtf(Running, returnType=f"doc_id {kinds['doc_id']}, number string, page_start {kinds['page_no']}, page_end {kinds['page_no']}, text string")
    eligible = F.when(F.length("text") >= min_start, F.col("number"))
    lead = F.when(F.col("text").rlike(f"^{SPACE}"), F.substring(F.regexp_replace("text", f"^{SPACE}+", ""), 1, max_chars))
    own = pages.select("doc_id", "page_no", eligible.alias("number"), F.substring("text", 1, max_chars).alias("text"), lead.alias("lead"), (F.length(strip(F.col("text"))) >= min_tail).alias("long"))
    return told(own.asTable().partitionBy("doc_id").orderBy("page_no"))


def admitted(cases: DataFrame, min_chars: int = MIN_CASE, max_chars: int = MAX_CASE, version: int = PARSER_VERSION) -> DataFrame:
    """Cases of enough text that say the number of their header, cut to the most; with key and search text. cases carry url."""
    long = cases.withColumn("text", strip(F.col("text"))).where(F.length("text") >= min_chars)
    kept = long.where(judgment_number("text") == F.col("number"))
    key = key_of(F.col("url"), F.col("number"), F.col("page_start"), F.col("page_end"), F.lit(f"v{version}"))
    kept = kept.withColumn("catalog_key", key).withColumn("text", F.substring("text", 1, max_chars))
    return kept.withColumn("normalized_text", normalize_arabic(F.col("text")))


def decorative(text: Column) -> Column:
    """Short pages, and fairly short ones without a word of a judgment."""
    short = lambda plain: (F.length(plain) < 220) | ((F.length(plain) < 420) & ~_any(plain, JUDGMENT))
    return F.exists(F.array(squeeze(text)), short)  # the plain text is computed once


def _trimmed(hints: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Ends moved back over decorative pages, never before the start. Texts stay where they are: only numbers of pages move."""
    stay = pages.where(~decorative(F.col("text"))).select(F.col("doc_id").alias("__doc"), "page_no")
    inside = hints.join(stay.hint("merge"), (F.col("doc_id") == F.col("__doc")) & F.col("page_no").between(F.col("page_start"), F.col("page_end")), "left")
    return inside.groupBy(*keys, "number", "page_start").agg(F.greatest("page_start", F.max("page_no")).alias("page_end"))


def _header_runs(pages: DataFrame) -> DataFrame:
    """(doc_id, number, page_start, other): pages where another header number begins, and where the next one does."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    headed = pages.where("number is not null").select("doc_id", "page_no", "number").withColumn("before", F.lag("number").over(order))
    starts = headed.where(~F.col("number").eqNullSafe(F.col("before")))
    return starts.select("doc_id", "number", F.col("page_no").alias("page_start"), F.lead("page_no").over(order).alias("other"))


def refine_ranges(hints: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """hints (doc_id, hint_start, hint_end, expected) over pages with number -> (…, number, page_start, page_end).

    The expected number's first page near the hint; else the header nearest to the hint's start, in the hint first. The end
    is before the next other number; without one the hint's end or the page limit, and never before the start. Hints
    without a header near them give no row.
    """
    keys = ["doc_id", "hint_start", "hint_end", "expected"]
    total = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    # pages are many where a table of documents is small, so none of their joins is a broadcast
    seen = hints.join(total.hint("merge"), "doc_id").where("hint_start >= 1 and hint_end >= hint_start and hint_start <= total")
    seen = seen.withColumn("clamped", F.least("hint_end", "total"))
    near = seen.join(pages.where("number is not null").select("doc_id", "page_no", "number").hint("merge"), "doc_id").where(
        F.col("page_no").between(F.greatest(F.lit(1), F.col("hint_start") - 2), F.least(F.col("total"), F.greatest(F.col("clamped") + 3, F.col("hint_start") + max_pages + 2)))
    )
    far = F.abs(F.col("page_no") - F.col("hint_start"))
    rank = F.when(F.col("number") == F.col("expected"), F.struct(F.lit(0).alias("c"), F.col("page_no").alias("d"), F.col("page_no").alias("p"), "number"))
    rank = rank.when(F.col("page_no").between(F.col("hint_start"), F.col("clamped")), F.struct(F.lit(1).alias("c"), far.alias("d"), F.col("page_no").alias("p"), "number"))
    rank = rank.otherwise(F.struct(F.lit(2).alias("c"), far.alias("d"), F.col("page_no").alias("p"), "number"))
    headers = F.collect_list(F.struct("page_no", "number"))
    chosen = near.groupBy(*keys, "total", "clamped").agg(F.min(rank).alias("best"), headers.alias("headers"))
    later = F.array_min(F.transform(F.filter("headers", lambda h: (h["page_no"] > F.col("best.p")) & (h["number"] != F.col("best.number"))), lambda h: h["page_no"]))
    end = F.coalesce(later - 1, F.least(F.col("total"), F.col("best.p") + F.greatest(F.lit(1), F.lit(max_pages)) - 1, F.col("clamped")))
    ranges = chosen.select(*keys, F.col("best.number").alias("number"), F.col("best.p").alias("page_start"), F.greatest(F.col("best.p"), end).alias("page_end"))
    return _trimmed(ranges, pages, keys)


def locate(wanted: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """wanted (doc_id, expected) over pages with number -> the expected case's pages; no row where no header has it."""
    total = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    runs = wanted.join(_header_runs(pages).withColumnRenamed("number", "expected").hint("merge"), ["doc_id", "expected"])
    first = runs.groupBy("doc_id", "expected").agg(F.min(F.struct("page_start", "other")).alias("r")).select("doc_id", "expected", "r.*")
    ends = first.join(total.hint("merge"), "doc_id")
    end = F.least(F.col("total"), F.col("page_start") + F.greatest(F.lit(1), F.lit(max_pages)) - 1, F.coalesce(F.col("other") - 1, F.col("total")))
    return _trimmed(ends.select("doc_id", "expected", F.col("expected").alias("number"), "page_start", end.alias("page_end")), pages, ["doc_id", "expected"])


def verify_single_case(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text, expected) -> (doc_id, expected, verified): whether all pages are of the expected case.

    Headers decide if there are any: the first page's must be the expected one and no other may differ. Else the labelled
    numbers must hold it, and without those one page its last groups of digits.
    """
    read = pages.withColumn("number", primary_header("text")["case_number"]).withColumn("wanted", normalize_case_number("expected"))
    read = read.withColumn("labels", labelled_numbers(F.substring("text", 1, 8000))).withColumn("tokens", tokens_match(F.col("text"), number_tokens(F.col("expected"))))
    facts = read.groupBy("doc_id", "expected", "wanted").agg(
        F.min_by("number", "page_no").alias("first"), F.count("number").alias("headers"), F.every(F.coalesce(F.col("number") == F.col("wanted"), F.lit(True))).alias("all_same"),
        F.flatten(F.collect_list("labels")).alias("labels"), F.bool_or("tokens").alias("tokens"),
    )
    by_header = (F.col("first") == F.col("wanted")) & F.col("all_same")
    verdict = F.when(F.col("wanted").isNull(), False).when(F.col("headers") > 0, F.coalesce(by_header, F.lit(False)))
    verdict = verdict.when(F.size("labels") > 0, F.array_contains("labels", F.col("wanted"))).otherwise(F.coalesce("tokens", F.lit(False)))
    return facts.select("doc_id", "expected", verdict.alias("verified"))


def ordered_numbers(pages: DataFrame) -> DataFrame:
    """(doc_id, numbers): header numbers in page order, each once."""
    own = F.array_sort(F.collect_list(F.struct("page_no", "number")))
    return pages.where("number is not null").groupBy("doc_id").agg(F.array_distinct(F.transform(own, lambda x: x["number"])).alias("numbers"))


def is_compilation(pages: DataFrame, threshold: int = 60) -> DataFrame:
    """(doc_id, compilation): many pages, or more than one case."""
    facts = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"), F.size(F.collect_set("number")).alias("cases"))
    return facts.select("doc_id", ((F.col("n") > threshold) | (F.col("cases") > 1)).alias("compilation"))


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first..last, from 1, both included; documents that end before ``last`` are left out."""
    if first < 1 or last < first:
        raise ValueError("a range starts at page 1 or later and does not end before it starts")
    long = pages.groupBy("doc_id").agg(F.max("page_no").alias("n")).where(F.col("n") >= last).select("doc_id")
    return pages.where(F.col("page_no").between(first, last)).join(long, "doc_id", "left_semi")
