"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm import decontam, langid, linededup, packing, simhash
from mizan.llm.common import saved, scratch, table, whole_row
from mizan.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the predicted one. Those without a letter go."""
    out = langid.identify(docs).where(F.col("lang_pred") != langid.UNKNOWN)
    return out.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document whose every line with words goes is a copy and goes whole."""
    rows = docs.select(whole_row(), "doc_id", "text")
    out = linededup.dedup_lines(rows).where((F.col("n_kept") > 0) | (F.col("n_lines") == 0))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(whole_row(), F.col("doc_id").alias("key_id"), F.xxhash64(F.col("text").cast("string")).alias("key_text"))


def _chosen(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """docs whose id and text are among the chosen (doc_id, text_key), by a left_semi or left_anti join."""
    left, right = _keyed(docs), chosen.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    return left.join(right, left["key_id"].eqNullSafe(right["d"]) & (left["key_text"] == right["k"]), how)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; of rows repeated with id and text one."""
    found = saved(simhash.near_duplicates(docs, "doc_id", "text").where("stays").select("doc_id", "text_key"), "stays")
    left = _chosen(docs, found, "left_semi")
    if not found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["key_id", "key_text"])
    return left.select("row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go whole."""
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _chosen(docs, found.where("contaminated"), "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("packed", packed)]

#: Automata, fingerprints and packing plans have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote on its way goes when it is done, the tables of the stages when all are."""
    docs = table(spark, sf_dir, "documents")
    with scratch() as keep:
        for name, stage in STAGES[:-1]:
            with scratch() as keep_stage:
                docs = keep_stage(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = keep(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
    return docs
