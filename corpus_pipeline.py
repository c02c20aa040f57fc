"""A corpus pipeline: five operators in a row, each on all that the one before kept.

Every stage treats each row as a document of its own: null and repeated ids are told apart by a key made for the
stage (see ``row_keys``), so one row's fate never is another's. Long texts are handled whole. An empty table gives an
empty table. Columns beside ``doc_id text lang source n_chars`` are carried along; those whose names a stage uses itself
are kept by it, but for the four that the mix adds, which replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtime.llm.common import row_keys, stage
from leadtime.llm.decontaminate import contaminated
from leadtime.llm.line_dedup import line_dedup
from leadtime.llm.minhash_dedup import near_duplicates
from leadtime.llm.mixing import mix_sources
from leadtime.llm.unigram import language_id
from leadtime.sources.staging import tidied

#: A text whose language has less than this posterior is rejected.
MIN_LANGUAGE_SCORE = 0.5


def without(docs: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """The documents but those of ``keys``. Staged, so that the planner knows the size and broadcasts keys only if few."""
    return docs.join(stage(keys.select(key).distinct(), name), key, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those of no clear language."""
    rows, key = row_keys(docs)
    found = language_id(rows, docs.select(F.col("doc_id").alias(key), "text", "lang"), id_col=key)
    return without(rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_LANGUAGE_SCORE)), key, "rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document stays even if none of its lines does."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup(docs, carry=others)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    rows, key = row_keys(docs)
    return without(rows, near_duplicates(rows, id_col=key).where(~F.col("kept")), key, "near").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows, key = row_keys(docs)
    return without(rows, contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key), key, "leaks").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their size and how many words of them it takes; such columns of the input are replaced."""
    columns = ("size", "source_size", "target", "taken")
    others = tuple(c for c in docs.columns if c not in columns)
    found = mix_sources(docs, carry=others).where("taken > 0")
    return found.select(*[F.col("carried").getField(c).alias(c) for c in others], *columns)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
]

#: Language ID is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` after all stages. What a stage has staged on the way goes when its result is staged, and so does the result before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with tidied(spark):
            docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
