import random

import corpus_pipeline as pipeline
from mizan.llm import packing
from mizan.llm.queries import oracle_sql, queries

from .test_ops import prose, vocabulary


def tables(spark, path):
    rnd = random.Random(41)
    parts = {"en": ("tion", "the", "ing", "and", "er", "st"), "fr": ("eaux", "que", "ment", "les", "ou", "oi")}
    words = {k: vocabulary(rnd, 500, v) for k, v in parts.items()}
    clean = [(rnd.choice(list(parts)), i) for i in range(60)]
    rows = [(i, "\n".join(prose(rnd, words[k], rnd.randint(15, 40)) for _ in range(3)), k, "s", 0) for k, i in clean]
    item = prose(rnd, words["en"], 30)
    rows += [(100, rows[3][1], "en", "s", 0), (101, "123 456", None, "s", 0), (102, None, "en", "s", 0), (103, prose(rnd, words["en"], 20) + " " + item, "en", "s", 0)]
    near = rows[5][1].split()
    near[4] = "qqqq"
    rows += [(104, "\n".join([rows[7][1].split("\n")[0], "a fresh line that nobody else has in any text at all"]), "en", "s", 0), (105, "   \n" + " ".join(near).replace(" ", "  "), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    rows = tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    every = {r[0] for r in rows}
    assert seen["language"] == every - {101, 102}
    assert seen["lines"] == seen["language"] - {100}
    kept = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/lines").collect()}
    assert kept[104].startswith("a fresh line") and kept[0] == rows[0][1]
    assert seen["near_copies"] >= set(range(60)) | {103, 104}
    assert seen["benchmark_free"] == seen["near_copies"] - {103}
    assert seen["packed"] == seen["benchmark_free"]
    total = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= packing.SIZE
    assert pipeline.run(spark, path).count() == docs.count()


CLASHING = ("score", "held_out", "lang_pred", "n_lines", "n_kept", "row", "key_id", "key_text", "d", "k", "text_key", "__key", "component_id", "hash")


def test_stages_with_extra_columns_and_no_rows(spark, tmp_path):
    """Columns of any name go through as they are; an empty table stays one; the last stage takes both."""
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in CLASHING))
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, path)
            assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
            now.write.parquet(f"{path}/{name}-{rows is docs}")
            now = spark.read.parquet(f"{path}/{name}-{rows is docs}")
        assert all(r[c] == f"{c}{r['doc_id']}" for r in now.collect() for c in CLASHING)
        assert (now.count() > 0) == (rows is docs)
        assert pipeline.packed(spark, now, path).select("doc_id").distinct().count() == now.count()


def test_stages_keep_one_of_repeated_rows(spark, tmp_path):
    """Rows repeated with id and text, null ids and ties: one stays, with its own columns."""
    path = str(tmp_path)
    tables(spark, path)
    text = "The same words stand in each of these rows and nobody can tell them apart."
    rows = [(7, text, "en", "a", 0), (7, text, "en", "b", 0), (None, text, "en", "c", 0), (None, "Another text that no other row has at all, long enough to be kept.", None, None, None), (9, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_copies(spark, docs, path).collect()
    assert sum(r["text"] == text for r in kept) == 1 and next(r["doc_id"] for r in kept if r["text"] == text) == 7
    assert {r["text"] for r in kept} == {text, rows[3][1], None}
    assert pipeline.benchmark_free(spark, docs, path).count() == len(rows)
    out = pipeline.lines(spark, docs, path).collect()
    assert len(out) >= 3 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)


def test_run_leaves_nothing_but_its_result(spark, tmp_path):
    from mizan.llm import common

    path = str(tmp_path)
    tables(spark, path)
    before = set(common._LIVE)
    out = pipeline.run(spark, path)
    assert len(set(common._LIVE) - before) == 1 and out.count() > 0


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(names)
