"""Personal data with built-in functions only.

Regular expressions propose spans, checks of their digits confirm them (parts of addresses, Luhn for cards, mod 97 and the
length of the country for bank accounts), and words nearby move the score up or down. E-mail, ip, card and phone spans
that pass their checks are all reported, with their score; the other kinds are reported where the score reaches THRESHOLD:

* ``iban``: passes alone, but not beside words that say it is no real one, unless others say that it is;
* ``amex``: 15 digits that pass Luhn, and ``ssn``: nine digits in groups of three, two and four: pass only beside words for it;
* ``tel``: a phone number without a country code, likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import digest, joined, labelled, matches, ordered

#: A local part is read whole from its start (or from where the last match ended), so no character is read twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Letters and digits of an account number by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_BY_LENGTH = "|".join(f"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values())))
#: As many letters and digits as the country has, so what follows is never swallowed.
IBAN = rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH})(?![A-Za-z0-9])"
AMEX = r"(?<![0-9.,-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9.-])"
SSN = r"(?<![0-9.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
#: Not the end of a number with a country code, which is a phone.
TEL = r"(?<![0-9+.()-])(?<!\+[0-9]{1,3}[\x20-]{1,2})(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}(?:[\x20-]?[0-9]{2,5}){1,2}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "amex", "ssn", "tel")
#: What a confirmed span of a kind scores, and from which score the kinds that the method adds are reported.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "amex": 0.4, "ssn": 0.3, "tel": 0.3}
THRESHOLD = 0.5
#: Words within REACH characters before a span, or after it, that add to its score, and words that take from it.
CONTEXT = {
    "email": "mail|contact", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax", "iban": r"iban|\bbank|account|transfer|konto|compte|cuenta",
    "amex": "amex|american express|card|credit|payment", "ssn": "ssn|social security|tax id|taxpayer", "tel": r"phone|\bcall|\btel\b|telefon|mobile|fax|teléfono|téléphone",
}
AGAINST = r"example|sample|dummy|fictitious|invalid|\btest|order|invoice|isbn|serial|version|\bref\b|article no"
ADDS, TAKES, REACH = 0.3, 0.3, 40
#: Longest digit string that the regular expression's small parts are read as a number.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass the Luhn check."""
    back = F.reverse(number)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number passes the check of its two digits."""
    compact = F.translate(account, " ", "")
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    value = lambda i: F.conv(F.substring(moved, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: (acc * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97) == 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, and a column for each of KINDS): arrays of spans (s, e, m, score). Null text: empty. Null ids and
    repeated rows stay."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    some_digit = F.regexp_like(t, F.lit("[0-9]"))
    email = matches(t, EMAIL, F.contains(t, F.lit("@")))
    ip = F.filter(matches(t, IP, some_digit), lambda x: x["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(matches(t, CARD, some_digit), lambda x: F.length(digits(x["m"])).between(16, 19) & F.when(F.length(digits(x["m"])).between(16, 19), luhn(digits(x["m"]))).otherwise(False))
    phone = F.filter(matches(t, PHONE, F.contains(t, F.lit("+"))), lambda x: F.length(digits(x["m"])).between(8, 15))
    iban = F.filter(matches(t, IBAN, some_digit), lambda x: mod97(x["m"]))
    amex = F.filter(matches(t, AMEX, some_digit), lambda x: luhn(digits(x["m"])))
    ssn, tel = matches(t, SSN, F.contains(t, F.lit("-"))), matches(t, TEL, some_digit)
    spans = dict(zip(KINDS, (email, ip, card, phone, iban, amex, ssn, tel), strict=True))
    found = src.select("doc_id", "text", *(x.alias(k) for k, x in spans.items()))

    def scored(kind: str) -> Column:
        def one(x: Column) -> Column:
            before = F.substring(t, F.greatest(F.lit(1), x["s"] + 1 - REACH), F.least(F.lit(REACH), x["s"]))
            near = F.lower(F.concat_ws(" ", before, F.substring(t, x["e"] + 1, F.lit(REACH))))
            adds = F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), ADDS).otherwise(0.0)
            takes = F.when(F.regexp_like(near, F.lit(AGAINST)), TAKES).otherwise(0.0)
            score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(BASE_SCORE[kind]) + adds - takes)), 2)
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), score.alias("score"))

        out = F.transform(kind, one)
        return out if kind in KINDS[:4] else F.filter(out, lambda x: x["score"] >= THRESHOLD)

    return found.select("doc_id", "text", *(scored(k).alias(k) for k in KINDS))


def op6(documents: DataFrame) -> DataFrame:
    """The contract's digest; scores are those of the spans, in their order."""
    found = scan(documents)
    kinds = [labelled(F.col(k), k, i, "score") for i, k in enumerate(KINDS)]
    out = found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(digest(F.concat(*kinds[:4]), True), 256).alias("base_sha256"), ordered(F.concat(*kinds), True).alias("all")
    )
    return out.select(*(c for c in out.columns if c != "all"), joined("all").alias("spans"), F.array_join(F.transform("all", lambda x: x["score"].cast("string")), ",").alias("scores"))
