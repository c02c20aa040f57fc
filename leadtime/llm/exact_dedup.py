"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, squeeze, stage


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space has become one space. Null counts as
    empty, and empty texts are equal to each other. Of equal texts the smallest id stays; rows that repeat the
    same id are members of the group like others and are all marked kept. A null id never stays while a
    group has another one. Other columns of ``docs`` are ignored.

    Groups are built from staged digests, so no text is shuffled for them; the aggregate combines inside map tasks, and
    a group of any size reaches its reducer as one row per task. Bytes are compared in groups of two and more: a
    bitmap of a fixed size lets (almost) no other text through, and the smallest and the largest text of a hash are the same
    exactly if all its members are. Groups in which the bytes differ (a hash collision) are grouped again by hash
    and text. The groups are joined back by hash with an exchange on either side, so that adaptive execution can
    split a hot group.
    """
    base = docs.select(F.col(id_col).alias("id"), squeeze(F.col(text_col)).alias("text"))
    digests = stage(base.select("id", content_hash(F.col("text")).alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    groups = stage(digests.groupBy("hash").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    repeated = groups.where("group_size > 1").select(F.xxhash64("hash").alias("key"))
    hashed = base.withColumn("hash", content_hash(F.col("text")))
    texts = maybe_in(hashed, F.xxhash64("hash"), repeated, "repeated").where("repeated")
    mixed = stage(texts.groupBy("hash").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("hash"), "mixed")
    out = digests.join(groups, "hash").select("id", "keep_id", "group_size", "sha", "hash")
    if not mixed.isEmpty():
        members = hashed.join(mixed, "hash")
        parts = members.groupBy("hash", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = members.join(parts, ["hash", "text"]).select("id", "keep_id", "group_size", F.unhex(F.sha2("text", 256)).alias("sha"), "hash")
        out = out.join(mixed, "hash", "left_anti").unionByName(apart)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
