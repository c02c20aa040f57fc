"""Documents without an id and different texts of one id, through the operators and the stages of the pipeline."""

import random
from collections import Counter

import corpus_pipeline as cp
from leadtime.llm.decontaminate import contaminated

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_copies(spark):
    copy, edited = prose(1, 90), prose(1, 90) + " end"
    rows = [(1, prose(2)), (1, copy), (None, edited), (None, prose(3)), (2, copy), (None, prose(3)), (4, prose(4)), (4, prose(4))]
    want = Counter([(1, prose(2)), (1, copy), (None, prose(3)), (4, prose(4))])
    assert left(cp.dedup_near(spark, frame(spark, rows), "")) == want


def test_leaks(spark, tmp_path):
    item = prose(7, 12)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose(1)), (1, prose(2) + " " + item), (None, item + " " + prose(3)), (None, prose(4))]
    assert left(cp.decontaminate(spark, frame(spark, rows), str(tmp_path))) == Counter([rows[0], rows[3]])
    found = contaminated(frame(spark, rows), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert {r.doc_id for r in found} == {1, None}


def test_lines(spark):
    rows = [(1, "a first line\nan own line"), (2, "x\ny"), (2, "a first line\nanother line"), (None, "kept\na first line"), (None, "mine\nyours"), (3, "p"), (3, "p")]
    want = Counter([(1, "a first line\nan own line"), (2, "x\ny"), (2, "another line"), (None, "kept"), (None, "mine\nyours"), (3, "p"), (3, "")])
    assert left(cp.dedup_lines(spark, frame(spark, rows), "")) == want


def test_mix_keeps_what_it_takes(spark):
    rows = [(1, prose(1, 10)), (1, prose(2, 20)), (None, prose(3, 30)), (None, prose(4, 40)), (None, prose(4, 40))]
    got = cp.mix(spark, frame(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert all(r.size == len(r.text.split()) == r.taken for r in got)


def test_language_of_each_row(spark):
    rows = [(1, prose(1)), (1, "12 34"), (None, "56 !"), (None, prose(2))]
    assert left(cp.identify_language(spark, frame(spark, rows), "")) == Counter([rows[0], rows[3]])
