"""Text normalizers and small text functions, as Column -> Column.

The seven normalizers differ on purpose; each serves one comparison. Those that need NFKC take it from one vectorized
function, which sees only texts beyond ASCII; the rest of each is built in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits, marks and letter forms of Arabic script.
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
TATWEEL = "ـ"
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MARKS = r"[ؗ-ًؚ-ْٰۖ-ۭ]"
SEARCH_MARKS = r"[ً-ْـ]"
LETTER_FORMS, PLAIN_FORMS = "أإآىؤئ", "ااايوي"
TA_MARBUTA, HA = "ة", "ه"
#: White space as Python and the publishers' texts have it; \s of Java is ASCII only.
SPACE = r"[\s\x1C-\x1F\x85   -     　]"
#: The same, character by character, for translations.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c, re.ASCII))
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
# Court name patterns, words of which each needs one, words that no title has, and the titles of cases without one.
COURT_PATTERNS = (
    r"((?:المحكمة|محكمة)\s+(?:العامة|الجزائية|التجارية|الإدارية|العمالية|الأحوال\s+الشخصية|الاستئناف)[^\n]{0,90})",
    r"((?:الدائرة|دائرة)\s+(?:الإدارية|التجارية|الجزائية)[^\n]{0,90})",
    r"((?:لجنة|اللجنة)\s+(?:الفصل|الاستئنافية)[^\n]{0,110})",
)
COURT_WORDS = ("محكمة", "دائرة", "لجنة")
NOT_IN_TITLES = ("مجموعه الاحكام", "وزاره العدل", "بسم الله", "رقم القضيه", "رقم الدعوى", "رقم الصك", "رقم القرار")
TITLE_OF_NUMBER, TITLE_OF_NONE = "قضية رقم ", "حكم قضائي منشور"
ARTICLE = r"(?:المادة|المواد)\s*(?:رقم\s*)?[\(\)\[\]{}:/\-، ]{0,8}([0-9٠-٩۰-۹]{1,4})"
EDGE = " .،:-"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC and case folding; null stays null."""
    return values.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def folded(c: Column) -> Column:
    """NFKC and case folding; a text of ASCII alone needs lower case only, and does not pass through the vectorized function."""
    return F.coalesce(nfkc(F.when(F.octet_length(c) > F.length(c), c)), F.lower(c))


def spaced(c: Column, kept: str) -> Column:
    """Arabic script and these ASCII characters stay; runs of others become one space, none at the ends.

    ASCII is translated, the rest told by two ranges: one class of all that goes costs five times as much."""
    gone = "".join(x for x in map(chr, range(128)) if x not in kept and x != " ")
    out = F.regexp_replace(F.translate(c, gone, " " * len(gone)), r"[\x{80}-\x{5FF}\x{700}-\x{10FFFF}]+", " ")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, ASCII_DIGITS)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends; what lies between them is not looked at."""
    return F.btrim(c, F.lit(SPACES))


def strip_edges(c: Column) -> Column:
    """Without the punctuation that labels leave at either end."""
    return F.btrim(c, F.lit(EDGE))


def plain_letters(c: Column, ta_marbuta: bool = False) -> Column:
    extra = (TA_MARBUTA, HA) if ta_marbuta else ("", "")
    return F.translate(c, LETTER_FORMS + extra[0], PLAIN_FORMS + extra[1])


#: Marks and tatweel are deleted: they have no counterpart.
_N1_FROM = ARABIC_DIGITS + LETTER_FORMS + TATWEEL + "".join(map(chr, (*range(0x617, 0x61B), *range(0x64B, 0x653), 0x670, *range(0x6D6, 0x6EE))))
_N1_TO = ASCII_DIGITS + PLAIN_FORMS


def normalize_arabic(c: Column) -> Column:
    """N1, of the stored search text: ASCII digits, no marks, plain letters, only letters, digits, / and -, lower case."""
    plain = F.when(F.regexp_like(c, F.lit(r"[\u0600-\u06FF]")), F.translate(c, _N1_FROM, _N1_TO)).otherwise(c)
    return F.lower(spaced(plain, f"{LETTERS}{LETTERS.upper()}{DIGITS}/-"))


def _folded(c: Column, digits: bool) -> Column:
    """Letters and digits of a folded text in their plain forms; runs of others are one space."""
    given, plain = LETTER_FORMS + TA_MARBUTA + (ARABIC_DIGITS if digits else ""), PLAIN_FORMS + HA + (ASCII_DIGITS if digits else "")
    out = folded(c)
    out = F.when(F.regexp_like(out, F.lit(r"[\u0600-\u06FF]")), F.regexp_replace(F.translate(out, given + TATWEEL, plain), SEARCH_MARKS, "")).otherwise(out)
    return spaced(out, LETTERS + DIGITS)


def normalize_search(c: Column) -> Column:
    """N2, of header markers."""
    return _folded(c, digits=True)


def normalize_relevance(c: Column) -> Column:
    """N3, of course relevance: as N2, digits as they are."""
    return _folded(c, digits=False)


def normalize_signals(c: Column) -> Column:
    """N4, of page quality."""
    return _folded(c, digits=False)


def normalize_compact(c: Column) -> Column:
    """N5, of case number tokens: no white space at all. White space is deleted as the digits are told, in one reading."""
    return F.lower(F.translate(c, ARABIC_DIGITS + SPACES, ASCII_DIGITS))


#: All of ASCII that goes is deleted: it has no counterpart.
_N6_FROM = ARABIC_DIGITS + LETTER_FORMS + TATWEEL + "".join(x for x in map(chr, range(128)) if x not in LETTERS + DIGITS)
_N6_TO = ASCII_DIGITS + PLAIN_FORMS


def normalize_metadata(c: Column) -> Column:
    """N6, of rendered documents: letters and digits only. As in spaced() ASCII is translated; what else goes is looked for only
    in texts beyond ASCII."""
    plain = F.translate(F.lower(c), _N6_FROM, _N6_TO)
    return F.when(F.octet_length(c) > F.length(c), F.regexp_replace(plain, r"[\x{80}-\x{5FF}\x{700}-\x{10FFFF}]+", "")).otherwise(plain)


def normalize_identity(c: Column) -> Column:
    """N7, of case and court identities; null is the empty identity."""
    return F.replace(normalize_arabic(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))


def hits(text: Column, terms: Column) -> Column:
    """Terms of an array that stand in text."""
    return F.filter(terms, lambda t: F.contains(text, t))


def split_lines(c: Column) -> Column:
    """Lines as Python's splitlines has them, but that a last line end leaves an empty last line."""
    return F.split(c, LINE_END, -1)


def detect_court(c: Column) -> Column:
    """The first court pattern that matches in the first 8,000 characters, at most 180 of it."""
    sample = F.substring(c, 1, 8000)
    worded = F.exists(F.array(*map(F.lit, COURT_WORDS)), lambda w: F.contains(sample, w))

    def found(read: Column) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(read, p.replace(r"\s", SPACE), 1), F.lit("")) for p in COURT_PATTERNS))

    # a text without any of the words is not read by the patterns, and the others are squeezed once
    court = F.get(F.transform(F.array(squeeze(F.when(worded, sample))), found), F.lit(0))
    return F.substring(strip_edges(court), 1, 180)


def detect_year(c: Column) -> Column:
    """The first 14xx year of the first 7,000 characters, else null (a text never fails for having one)."""
    return F.nullif(F.regexp_extract(ascii_digits(F.substring(c, 1, 7000)), "14[0-9]{2}", 0), F.lit(""))


def make_title(c: Column, number: Column) -> Column:
    """The first line of 12 to 180 characters with six letters and no label in it."""
    candidates = F.transform(split_lines(F.substring(c, 1, 7000)), lambda x: strip_edges(squeeze(x)))

    def fits(x: Column) -> Column:
        plain = normalize_arabic(x)
        labels = [F.contains(plain, F.lit(w)) for w in NOT_IN_TITLES]
        any_label = labels[0]
        for more in labels[1:]:
            any_label = any_label | more
        return F.length(x).between(12, 180) & ~any_label & (F.regexp_count(x, F.lit(r"\p{L}")) >= 6)

    fallback = F.when(number.isNotNull(), F.concat(F.lit(TITLE_OF_NUMBER), number)).otherwise(F.lit(TITLE_OF_NONE))
    return F.coalesce(F.get(F.filter(candidates, fits), F.lit(0)), fallback)


def article_numbers(c: Column, pattern: str = ARTICLE) -> Column:
    """Distinct article numbers that a text cites, as ASCII digits without leading zeros."""
    found = F.regexp_extract_all(c, F.lit(pattern.replace(r"\s", SPACE)), F.lit(1))
    plain = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.ltrim(ascii_digits(x), F.lit("0")), "^$", "0")))
    if pattern != ARTICLE:
        return plain
    words = F.contains(c, F.lit("المادة")) | F.contains(c, F.lit("المواد"))
    return F.when(~words, F.array().cast("array<string>")).otherwise(plain)


def number_tokens(c: Column) -> Column:
    """The last three groups of three digits or more of a case number."""
    groups = F.regexp_extract_all(ascii_digits(c), F.lit("[0-9]{3,}"), F.lit(0))
    return F.slice(groups, F.greatest(F.lit(1), F.size(groups) - 2), F.lit(3))


def tokens_match(text: Column, tokens: Column) -> Column:
    plain = normalize_compact(text)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(plain, t))


def safe_filename(c: Column, longest: int = 80, empty: str = "case") -> Column:
    """Letters of any script, digits, _ and -; other runs become one -; null and what is left empty get a name."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\-\u0600-\u06FF]+", "-")
    return F.coalesce(F.nullif(F.substring(F.btrim(plain, F.lit("-_")), 1, longest), F.lit("")), F.lit(empty))


def human_size(n: Column) -> Column:
    def shown(unit: int, name: str) -> Column:
        """One decimal, halves to even: format_string would round them up."""
        tenths, rest = F.floor(n.cast("long") * 10 / F.lit(unit)), n.cast("long") * 10 % unit * 2
        tenths = tenths + F.when((rest > unit) | ((rest == unit) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    kb, mb = shown(1024, "KB"), shown(1024 * 1024, "MB")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(mb)


def short_reason(message: Column, kind: Column, longest: int = 140) -> Column:
    """The head of an error's message, its kind if it has none."""
    said = F.coalesce(strip(message), F.lit(""))
    return F.when(said == "", kind).otherwise(F.substring(said, 1, longest))


def key_of(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def per_row(kind: T.DataType) -> Callable:
    """A vectorized function of one text column whose body sees one text; null gives null."""

    def wrap(f: Callable) -> Callable:
        if isinstance(kind, T.StructType):

            @F.pandas_udf(kind)
            def structs(values: pd.Series) -> pd.DataFrame:
                rows = [(f(t) if t is not None else None) or (None,) * len(kind.names) for t in values]
                return pd.DataFrame(rows, columns=kind.names, dtype=object)

            return structs

        @F.pandas_udf(kind)
        def plain(values: pd.Series) -> pd.Series:
            return pd.Series([f(t) if t is not None else None for t in values], dtype=object)

        return plain

    return wrap
