"""What the review of round 4 found: blocks of the count matrix that a reader can hold."""

import pyarrow.parquet as pq

from tidewright.llm import resampling


def test_a_row_group_of_the_count_matrix_is_bounded_whatever_a_task_reads(spark):
    words = 1_500  # of their own in each document, so some 2,600 entries
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, {words}), k -> concat('w', id * {words} + k))) AS text")
    matrix = resampling.count_matrix(docs, "doc_id")
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in matrix.inputFiles()]
    entries = [m.row_group(g).column(matrix.columns.index("buckets")).num_values for m in groups for g in range(m.num_row_groups)]
    blocks = matrix.selectExpr("size(ids) AS n", "size(buckets) AS n_entries", "row_start[n] = size(buckets) AS whole").collect()
    assert sum(b["n"] for b in blocks) == 1500 and all(b["whole"] for b in blocks)
    assert sum(entries) == sum(b["n_entries"] for b in blocks) > 1 << 21 >= max(entries) and max(b["n_entries"] for b in blocks) <= 1 << 16
