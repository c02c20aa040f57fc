"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, stage

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: A word for matching: a run of letters and digits, in lower case.
TOKEN = r"[\p{L}\p{N}]+"
#: From so many rows of sketches on, documents' shingles pass a filter of bits before they meet them.
FILTER_FROM = 200_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def hashed_shingles(words: Column, sizes: list[int]) -> Column:
    """Hashes of each run of g words, for each g of ``sizes``."""

    def runs(g: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - g + 1)
        return F.when(F.size(words) >= g, F.transform(starts, lambda i: F.xxhash64(F.lit(g), *[F.element_at(words, i + j) for j in range(g)]))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[runs(g) for g in sizes])


def exact_shingles(words: Column, g: Column) -> Column:
    """The distinct runs of g words themselves, joined by spaces."""
    return F.when(F.size(words) >= g, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - g + 1), lambda i: F.concat_ws(" ", F.slice(words, i, g))))).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, containment: float) -> DataFrame:
    """item_id, shingle: the sketch of each item, the least of its shingle hashes.

    Items fall into partitions of doubling size. A document that holds the wanted share of an item's n
    shingles misses n - ceil(share * n) of them, so if a sketch holds one more than the largest item of its
    partition may miss, one of its shingles is in the document for sure: no item is lost.
    """
    n = F.size("hashes")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    width = F.least(n, (upper - F.ceil(upper * containment - 1e-9) + 1).cast("int"))
    return items.where(n > 0).select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), width)).alias("shingle"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    shingle_words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``containment`` of the distinct shingles.

    Columns: id, item_id, n_shingles (of the item), n_shared, containment. Words are runs of letters and
    digits in lower case, shingles are ``shingle_words`` of them in a row; an item with fewer words is one
    shingle of all its words. Items and documents without words (null, empty) match nothing. Rows that repeat
    an id (null ids are one such id) count as one document with the words of each. Other columns are ignored.

    The sketches are read from a staged table, so the planner knows their size and broadcasts them only if they
    are below its limit. Beyond FILTER_FROM rows, shingles that a filter of bits of bounded size rules out are left
    out first, so that a join by shuffles moves few of the corpus. Candidates are verified on the shingles themselves,
    not on hashes.
    """
    tests = stage(
        items.select(F.col(item_id_col).alias("item_id"), tokens(F.col(item_text_col)).alias("item_words"))
        .where(F.size("item_words") > 0)
        .withColumn("g", F.least(F.size("item_words"), F.lit(shingle_words))),
        "items",
    )
    sizes = sorted(r["g"] for r in tests.select("g").distinct().collect())  # at most shingle_words values
    if not sizes:
        return docs.join(tests.limit(0), F.lit(False)).select(F.col(id_col), "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    by_size = [tests.where(F.col("g") == g).select("item_id", F.array_distinct(hashed_shingles(F.col("item_words"), [g])).alias("hashes")) for g in sizes]
    hashed = by_size[0]
    for more in by_size[1:]:
        hashed = hashed.unionByName(more)
    sketches = stage(item_sketches(hashed, containment), "sketches")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    probes = base.select("id", tokens(F.col("text")).alias("words")).select("id", F.explode(hashed_shingles(F.col("words"), sizes)).alias("shingle"))
    if sketches.count() > FILTER_FROM:
        probes = maybe_in(probes, F.col("shingle"), sketches.select("shingle"), "likely").where("likely").drop("likely")
    candidates = stage(probes.join(sketches, "shingle").select("id", "item_id").distinct(), "candidates")
    wanted = candidates.join(tests.select("item_id", "g", exact_shingles(F.col("item_words"), F.col("g")).alias("item_shingles")), "item_id")
    found_ids = stage(candidates.select(F.col("id").alias("found_id")).distinct(), "suspects")
    suspects = base.join(found_ids, F.col("id").eqNullSafe(F.col("found_id")), "left_semi").select("id", tokens(F.col("text")).alias("words"))
    wanted = wanted.withColumnRenamed("id", "wanted_id")
    both = suspects.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id"))).select("id", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"), F.array_intersect("item_shingles", exact_shingles(F.col("words"), F.col("g"))).alias("shared"))
    shared = F.size(F.array_distinct(F.flatten(F.collect_set("shared")))).cast("long")
    found = both.groupBy("id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), shared.alias("n_shared"))
    return found.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9)).select(
        F.col("id").alias(id_col), "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )
