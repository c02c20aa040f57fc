"""Line dedup: a deletion-neighbourhood join over hashed variants of lines, earliest occurrence kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, row_keys, stage

#: Lines from this length on may differ by one edit; shorter ones must be equal.
MIN_NEAR_CHARS = 20
#: Parts of a line; variants leave out characters of the parts whose surroundings two lines share.
SEGMENTS = 16


def half_keys(line: Column, length: Column) -> Column:
    """Hashes of the first and last halves of a line, for its own length and the length one below.

    One edit leaves one half of the shorter of two lines untouched, so two lines within one edit share a key.
    """
    cuts = F.array_distinct(F.array(F.floor(length / 2), F.floor((length - 1) / 2)))
    first = F.transform(cuts, lambda c: F.xxhash64(F.lit("first"), F.substring(line, F.lit(1), c.cast("int"))))
    last = F.transform(cuts, lambda c: F.xxhash64(F.lit("last"), F.substring(line, (length - c + 1).cast("int"), c.cast("int"))))
    return F.concat(first, last)


def segments(texts: DataFrame) -> DataFrame:
    """line_id, first, around, body, size: each of SEGMENTS segments of the lines of (line_id, first, line, length).

    ``around`` is a hash of all but the segment, and ``body`` the segment's ``size`` characters. Segments are laid out
    for a line's length and for the length one below, so that lines one insertion apart agree on them: two
    lines within one edit share the surroundings of the segment that holds it.
    """
    length, total, before = F.col("length"), F.col("total"), F.col("before")
    totals = texts.select("*", F.explode(F.array(length, length - 1)).alias("total"))
    widths = totals.withColumn("width", F.greatest(F.lit(1), F.ceil(total / SEGMENTS)).cast("int"))
    placed = widths.select("*", F.explode(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.col("width"))).alias("before"))
    cut = placed.withColumn("after", F.greatest(F.lit(0), total - before - F.col("width"))).withColumn("size", length - before - F.col("after"))
    around = F.xxhash64("total", "before", F.substring("line", F.lit(1), before), F.lit("|"), F.substring("line", length - F.col("after") + 1, F.col("after")))
    return cut.select("line_id", "first", around.alias("around"), F.substring("line", before + 1, F.col("size")).alias("body"), "size")


def variants(shared_segments: DataFrame) -> DataFrame:
    """The variants of lines with at most one character of one segment left out, as (line_id, first, kind, key).

    They are the line itself ("whole"), and the line without character i of the segment. The key of the latter
    comes twice: with i ("at"), which it shares with just those lines that differ from it only in this character,
    and without i ("less"), which it shares with the line that lacks this character.
    """
    size, body = F.col("size"), F.col("body")
    whole = shared_segments.select("line_id", "first", F.lit("whole").alias("kind"), F.xxhash64("around", "body").alias("key"))
    each = shared_segments.where("size > 0").select("line_id", "first", "around", "body", "size", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    less = each.select("line_id", "first", "around", "i", F.concat(F.substring(body, F.lit(1), F.col("i")), F.substring(body, F.col("i") + 2, size - F.col("i") - 1)).alias("rest"))
    kinds = F.explode(F.array(F.struct(F.lit("at").alias("kind"), F.xxhash64("around", "i", "rest").alias("key")), F.struct(F.lit("less").alias("kind"), F.xxhash64("around", "rest").alias("key")))).alias("v")
    return whole.unionByName(less.select("line_id", "first", kinds).select("line_id", "first", "v.kind", "v.key"))


def clean_line(line: Column) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.btrim(line, F.lit(" \t\r\v\f"))


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def text_lines(docs: DataFrame) -> DataFrame:
    """id, line_no (from 0), line (as compared) of each line of (id, text) that is not empty."""
    parts = docs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return parts.select("id", "line_no", clean_line(F.col("raw")).alias("line")).where("line <> ''")


def near_duplicates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """line_id of the distinct lines that are one edit from a line that occurs earlier.

    ``distinct`` has (line_id, first, keys), with null keys for lines that only equal ones can match. Lines without
    any partner for a half have gone first, which the pigeonhole principle allows, then segments whose
    surroundings no other line has. Only the texts of lines with a partner are read again, from documents that
    a filter of bounded size tells. Within a key the earliest line is
    the only partner that matters, so a window minimum gives one candidate per line and key, and no pairs of a
    group are made; the number of distinct lines that can share a variant is bounded by the alphabet.
    """
    keyed = distinct.where("keys is not null").select("line_id", "first", F.xxhash64("line_id").alias("short_id"), F.explode(F.array_distinct("keys")).alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("short_id").alias("a"), F.max("short_id").alias("b")).where("a <> b").select("key"), "shared")
    left = stage(keyed.join(shared, "key", "left_semi").select("line_id", "first").distinct(), "paired")
    firsts = stage(left.select(F.xxhash64("first.id").alias("key")).distinct(), "firsts")
    texts = stage(
        text_lines(maybe_in(docs, F.xxhash64("id"), firsts, "maybe").where("maybe"))
        .withColumn("line_id", line_id(F.col("line")))
        .join(left, "line_id")
        .where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
        .dropDuplicates(["line_id"])
        .select("line_id", "line", "first", F.length("line").alias("length")),
        "texts",
    )
    cut = stage(segments(texts.repartition("line_id")), "segments")
    short_id = F.xxhash64("line_id")
    common = cut.groupBy("around").agg(F.min(short_id).alias("a"), F.max(short_id).alias("b")).where("a <> b").select("around")
    spread = variants(cut.join(stage(common, "common"), "around", "left_semi"))
    # "whole" meets "less", and "at" meets "at".
    sided = spread.withColumn("swap", F.col("kind") == "at")
    by_key = Window.partitionBy("swap", "key")
    me = F.struct("first", "line_id")

    def least(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, me)).over(by_key)

    other = F.when(F.col("kind") == "whole", least("less")).when(F.col("kind") == "less", least("whole")).otherwise(least("at"))
    pairs = sided.withColumn("other", other).where(F.col("other.first") < F.col("first")).select("line_id", F.col("other.line_id").alias("other_id")).distinct()
    t = texts.select("line_id", "line")
    o = texts.select(F.col("line_id").alias("other_id"), F.col("line").alias("other_line"))
    near = F.levenshtein("line", "other_line", 1)
    return pairs.join(t, "line_id").join(o, "other_id").where(near.between(0, 1)).select("line_id").distinct()


def without_lines(parts: Column, gone: Column) -> Column:
    """The lines but those whose numbers are in ``gone``, in time in proportion to the lines: a digit for each line says whether it goes."""
    bounds = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.size(parts)))
    runs = F.zip_with(F.slice(bounds, 1, F.size(gone) + 1), F.slice(bounds, 2, F.size(gone) + 1), lambda a, b: F.repeat(F.lit("0"), b - a - 1))
    lines = F.arrays_zip(parts.alias("line"), F.split(F.array_join(runs, "1"), "").alias("goes"))
    return F.transform(F.filter(lines, lambda x: x["goes"] == "0"), lambda x: x["line"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near_chars: int = MIN_NEAR_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, text (its kept lines), n_lines, n_removed, and with ``carry`` those columns as a struct ``carried``.

    Lines are what "\\n" separates, compared without white space at their ends, equal ones by the md5 of their bytes. The corpus is read in the
    order of (id, line number). A line goes if an earlier line of the corpus is equal, or if both have at least
    ``min_near_chars`` characters and are one edit (a character put in, taken out or changed) apart, whether
    the earlier one stays or not. Empty lines always stay. The kept lines are joined by "\\n" again. Null and
    empty texts give an empty text with no line removed. Rows that repeat an id, or have none, are documents of
    their own, in an order by their content, ids that are null last. Other columns are ignored.
    """
    docs, key_col = row_keys(docs, id_col)
    base = docs.select(F.col(key_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length = F.length("line")
    keys = F.when(length >= min_near_chars, half_keys(F.col("line"), length))
    places = stage(text_lines(base).select("id", "line_no", line_id(F.col("line")).alias("line_id"), keys.alias("keys")), "lines")
    distinct = stage(places.groupBy("line_id").agg(F.min(F.struct("id", "line_no")).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n")), "distinct")
    near = stage(near_duplicates(base, distinct), "near")
    marked = distinct.join(near.withColumn("near", F.lit(True)), "line_id", "left").where("n > 1 or near").select("line_id", "first", F.coalesce("near", F.lit(False)).alias("near"))
    here = F.struct("id", "line_no")
    gone = places.join(stage(marked, "marked"), "line_id").where(F.col("near") | ~here.eqNullSafe(F.col("first"))).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    left = docs.select(F.col(key_col).alias("id"), F.col(id_col).alias("own_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("parts"), *([F.struct(*carry).alias("carried")] if carry else []))
    joined = left.alias("d").join(gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")), "left").select("d.own_id", *(["d.carried"] if carry else []), "parts", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("parts")).otherwise(without_lines(F.col("parts"), F.col("gone")))
    return joined.select(
        F.col("own_id").alias(id_col),
        F.array_join(kept, "\n").alias(text_col),
        F.when((F.size("parts") == 1) & (F.col("parts")[0] == ""), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        *(["carried"] if carry else []),
    )
