"""What a task holds must not follow the size of its input."""

import pyarrow.parquet as pq

from mizan import shared
from mizan.llm import decontam


def test_a_reader_of_postings_holds_few_shards(spark, monkeypatch):
    monkeypatch.setattr(shared, "BATCH_BYTES", 1 << 20)
    docs = spark.createDataFrame([(i,) for i in range(24)], "doc_id long").coalesce(1)
    docs = docs.selectExpr("doc_id", "array_join(transform(sequence(1, 130000), x -> concat('w', x * 24 + doc_id)), ' ') AS text")
    every, _ = decontam.find(docs, spark.createDataFrame([("b", "w24 w48 w72")], "item_id string, text string"))
    groups = [m.row_group(g) for f in every.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 12
    assert max(g.total_byte_size for g in groups) < 24 << 20
