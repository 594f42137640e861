"""Secret scans with built-in functions only.

Fixed shapes (assignments, access keys, long hex) are regular expressions. Beside them, every long token is scored by two
character Markov models, of random strings and of ordinary identifiers: where the log-likelihood ratio per character says
random, the token is a span of kind ``markov``.

Both models learn from labelled samples. Random: strings drawn in the usual alphabets, and the values that the fixed shapes
find in the sample's documents. Ordinary: their words, alone and joined as identifiers are, and drawn numbers. Seven tenths of
the samples train the models; on the rest the threshold is fitted. Only counts come to the driver: of pairs of characters,
and of scores by hundredths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .spans import digest, labelled, matches

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
#: A run of 24 or more; a match starts where a run does, so each character is looked at once.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Tokens that the models score: all long ones.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bounds of the labelled sample: documents, whose whole texts count, and drawn strings of each alphabet.
SAMPLE_DOCS, DRAWN = 400, 2000
#: Tasks that score the sample, at most.
SAMPLE_TASKS = 64
#: Samples by a hash: this many tenths train the models, the others fit the threshold.
TRAIN_TENTHS = 7
#: A false alarm weighs as much as so many missed secrets, each of its class's samples.
ALARM_COST = 20
KINDS = ("assign", "access", "hex", "markov")


def _sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text) of at most SAMPLE_DOCS distinct documents, the first by a hash of id and text."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    rows = docs.where(F.col(text_col).isNotNull()).select(h.alias("h"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.approx_count_distinct("h")).first()[0]
    limit = int(-(1 << 63) + min(1.0, 2 * SAMPLE_DOCS / max(1, total)) * ((1 << 64) - 1))  # by more than the estimate's error
    few = rows.where(F.col("h") <= min(limit, (1 << 63) - 1))
    last = few.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    return few.where(F.col("h") <= (last if last is not None else 0)).dropDuplicates(["h"]).select("text")


def labelled_samples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sample, random, tenth)."""
    spark: SparkSession = docs.sparkSession
    seed = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(seed))
    letters = F.translate(code, "0123456789+/=", "")
    strings = F.array(F.substring(seed, 1, 40), F.translate(code, "=", ""), F.translate(code, "+/=", "-_"), F.upper(F.substring(F.translate(code, "+/=", ""), 1, 24)), letters, F.lower(letters))
    drawn = spark.range(DRAWN).select(F.explode(strings).alias("sample"), F.lit(True).alias("random"))
    numbers = spark.range(DRAWN).select(F.lpad(F.abs(F.xxhash64("id") % F.lit(10**18)).cast("string"), 18, "0").alias("sample"), F.lit(False).alias("random"))
    texts = _sampled(docs, id_col, text_col)
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    secret = texts.select(F.explode(F.filter(values, lambda v: F.length(v).between(20, 200) & v.rlike("[0-9]"))).alias("sample"), F.lit(True).alias("random"))
    # words that the models are there to judge are no labelled identifiers
    words = texts.select(F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.length(w).between(2, 15) & (~w.rlike("[0-9]{3}") | w.rlike("^[0-9]+$"))).alias("w"))
    after = lambda w, i, n: F.coalesce(F.get("w", i + n), F.lit("x"))
    joined = [
        F.transform("w", lambda w, i: F.concat_ws("_", w, after(w, i, 1), after(w, i, 2))),
        F.transform("w", lambda w, i: F.concat_ws("-", w, after(w, i, 1), F.lit("1"))),
        F.transform("w", lambda w, i: F.concat_ws("/", F.lit(""), w, after(w, i, 1), after(w, i, 2))),
        F.transform("w", lambda w, i: F.concat(w, F.initcap(after(w, i, 1)), F.initcap(after(w, i, 2)), F.lit("2"))),
    ]
    plain = words.select(F.explode(F.concat("w", *joined)).alias("sample"), F.lit(False).alias("random"))
    every = drawn.union(numbers).union(secret).union(plain).where(F.length("sample") > 1)
    return every.withColumn("tenth", F.pmod(F.xxhash64("sample"), F.lit(10)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over identifier, of a character after another; place: 68 * first + second. Without
    documents the identifier model knows numbers alone. A character after itself says nothing: ruler lines are in no word."""
    n = len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2)))
    grams = samples.where(F.col("tenth") < TRAIN_TENTHS).select("random", F.explode(pairs).alias("g")).groupBy("random", "g").count()
    coded = grams.select("random", at(F.substring("g", 1, 1)).alias("a"), at(F.substring("g", 2, 1)).alias("b"), "count").where("a >= 0 and b >= 0")
    counts = {(r["random"], r["a"] * n + r["b"]): r["count"] for r in coded.collect()}  # two rows for each pair of the alphabet
    model = {}
    for kind in (True, False):
        for a in range(n):
            row = [counts.get((kind, a * n + b), 0) + 0.5 for b in range(n)]
            for b in range(n):
                model[kind, a * n + b] = math.log(row[b] / sum(row))
    return [round(model[True, p] - model[False, p], 4) if p // n != p % n else 0.0 for p in range(n * n)]


def threshold(samples: DataFrame, table: list[float]) -> tuple[float, float, float]:
    """(mean ratio from which a token counts as random, share of random samples that it finds, share of ordinary ones that it
    takes for random), on the long samples that train no model."""
    held = samples.where((F.col("tenth") >= TRAIN_TENTHS) & F.col("sample").rlike(f"^{TOKEN}$"))
    scored = held.select("random", F.round(ratio(F.col("sample"), table), 2).alias("r")).groupBy("random", "r").count().collect()  # by hundredths
    totals = {k: max(1, sum(x["count"] for x in scored if x["random"] == k)) for k in (True, False)}
    found, alarms, best = 0, 0, (math.inf, 0.0, 0.0, 0.0)
    by_score: dict[float, list] = {}
    for x in scored:
        by_score.setdefault(x["r"], []).append(x)
    for r in sorted(by_score, reverse=True):
        found += sum(x["count"] for x in by_score[r] if x["random"])
        alarms += sum(x["count"] for x in by_score[r] if not x["random"])
        recall, alarm = found / totals[True], alarms / totals[False]
        best = min(best, (1 - recall + ALARM_COST * alarm, r, recall, alarm))
    return best[1:]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's pairs."""
    n = len(ALPHABET)
    llr = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded once
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(llr, at(i) * n + at(i + 1)))
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(doc_id, text, assign, access, hex, markov): arrays of spans (s, e, m) in code points. Null text: empty.

    Null ids and repeated rows stay. A markov span that lies in one of the others is left out. least: the threshold, if it
    is not to be fitted.
    """
    # few bytes, but much to score: dealt to tasks by count, not by size
    tasks = min(SAMPLE_TASKS, docs.sparkSession.sparkContext.defaultParallelism)
    samples = saved(labelled_samples(docs, id_col, text_col).repartition(tasks), "secret-samples")
    table = train(samples)
    least = threshold(samples, table)[0] if least is None else least
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    assign = F.filter(matches(t, ASSIGN, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    found = src.select(
        "doc_id", "text", assign.alias("assign"), matches(t, ACCESS, F.contains(t, F.lit("AKIA"))).alias("access"), matches(t, HEX).alias("hex"), matches(t, TOKEN).alias("tokens")
    )
    base = F.concat("assign", "access", "hex")
    alone = F.filter("tokens", lambda x: (ratio(x["m"], table) >= least) & ~F.exists(base, lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"])))
    return found.select("doc_id", "text", "assign", "access", "hex", alone.alias("markov"))


def op5(documents: DataFrame) -> DataFrame:
    found = scan(documents)
    kinds = [labelled(F.col(k), k, i) for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(digest(F.concat(*kinds[:3]), False), 256).alias("base_sha256"), digest(F.concat(*kinds), False).alias("spans")
    )
