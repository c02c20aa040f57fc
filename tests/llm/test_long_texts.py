"""Very long texts: time and memory in proportion to their length."""

import time

import pytest
from pyspark.sql import functions as F

from leadtime.llm.line_dedup import line_dedup, without_lines


@pytest.mark.parametrize("gone", [[], [0], [4], [0, 1, 2, 3, 4], [1, 3], [2, 0]])
def test_lines_left(spark, gone):
    parts = ["a", "", "b", "a", "é"]
    df = spark.createDataFrame([(parts, gone)], "parts array<string>, gone array<int>")
    assert df.select(without_lines(F.col("parts"), F.col("gone")).alias("x")).first()["x"] == [p for i, p in enumerate(parts) if i not in gone]


def test_a_million_equal_lines(spark):
    line = "one line of a long log"
    times_of = F.when(F.col("id") == 0, 1).otherwise(1_000_000)
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit(line), times_of), "\n").alias("text"))
    began = time.time()
    found = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert time.time() - began < 60
    assert (found[0]["text"], found[0]["n_removed"], found[1]["text"], found[1]["n_removed"]) == (line, 0, "", 1_000_000)
