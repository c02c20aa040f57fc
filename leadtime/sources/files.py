"""Readers for measurement files, audits and hand-off tables. Formats are read as text and typed late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, times
from .staging import delete, exists, replace, staged

# File suffixes, the seven sample columns, sentinels and the range of samples.
SUFFIXES = "*.{[tT][xX][tT],[dD][aA][tT],[cC][sS][vV]}"
SAMPLE_COLUMNS = ("year", "month", "day", "hour", "minute", "second", "value")
SAMPLE_SENTINELS = (9.99, 99.99, 999.99, 9999.99, 999.9, 9999.9, 99999.9)
SAMPLE_LIMIT = 120.0


def discover(spark: SparkSession, folder: str, suffixes: str = SUFFIXES) -> DataFrame:
    """path, name, size of the files below a folder with a known suffix, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def whole_texts(spark: SparkSession, folder: str, suffixes: str = SUFFIXES) -> DataFrame:
    """source_file (its path), text, with its lines ended by \\n: a file is one row, so its header is found where it is read."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def whole_files(spark: SparkSession, folder: str, suffixes: str = SUFFIXES) -> DataFrame:
    """source_file, all (its lines)."""
    return whole_texts(spark, folder, suffixes).select("source_file", F.split("text", "\n").alias("all"))


def lines(files: DataFrame, *carried: str) -> DataFrame:
    """source_file, the carried columns, line_no (from 1), value of each line that is not blank."""
    parts = files.select("source_file", *carried, F.posexplode("all").alias("line_no", "value"))
    return parts.select("source_file", *carried, (F.col("line_no") + 1).alias("line_no"), "value").where(F.trim("value") != "")


def first_line(condition) -> Column:
    """The number (from 1) of the first line that meets a condition; null if none does."""
    return F.nullif(F.array_position(F.transform("all", condition), F.lit(True)), F.lit(0)).cast("int")


def complete(files: DataFrame, bad: Column) -> DataFrame:
    """The files; one that lacks columns is an error."""
    return files.where(F.assert_true(~bad, F.concat(F.lit("missing columns in "), F.col("source_file"))).isNull())


def samples(fields: Column) -> list[Column]:
    """time, value and missing flag from the fields of a line; a line with a bad time has a null time."""
    part = {name: clean.number(F.get(fields, F.lit(i))) for i, name in enumerate(SAMPLE_COLUMNS)}
    text = F.get(fields, F.lit(6))
    x = part["value"]
    ok = (F.abs(x) <= SAMPLE_LIMIT) & ~clean.repeated_nines(text) & ~clean.in_list(x, list(SAMPLE_SENTINELS))
    at = times.from_parts(part["year"], part["month"], part["day"], part["hour"], part["minute"], part["second"])
    return [at.alias("time"), *clean.masked(x, ok, "value")]


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, line_no, time, value, value_missing_flag from white-space separated files without header.

    What follows "#" is a comment, fields past the seventh don't count, and rows without a valid time go; rows
    with a bad value stay.
    """
    rows = lines(whole_files(spark, folder)).withColumn("value", F.trim(F.regexp_replace("value", "#.*$", ""))).where("value <> ''")
    fields = F.split("value", r"\s+")
    return rows.select("source_file", "line_no", *samples(fields)).where("time is not null")


def read_samples_csv(spark: SparkSession, folder: str, aliases: tuple[str, ...] = ("value", "gic", "gic_a")) -> DataFrame:
    """The same from comma-separated files, each with or without a header; a header names the columns in any order.

    A first line is a header if it has the word year, second or an alias of value. A file whose header lacks a
    column is an error.
    """
    files = whole_files(spark, folder).withColumn("head_no", first_line(lambda x: F.trim(x) != ""))
    names = F.transform(F.split(F.lower(F.get("all", F.col("head_no") - 1)), ","), lambda x: F.trim(x))
    has = F.coalesce(F.exists(names, lambda x: x.isin("year", "second", *aliases)), F.lit(False))
    value_at = F.coalesce(*[F.when(F.array_position(names, a) > 0, F.array_position(names, a)) for a in aliases])
    places = F.array(*[F.nullif(F.array_position(names, c), F.lit(0)) for c in SAMPLE_COLUMNS[:-1]], value_at)
    files = complete(files.withColumn("has", has).withColumn("named", places), F.col("has") & F.exists("named", lambda p: p.isNull()))
    plain = F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))
    rows = lines(files.withColumn("places", F.when(F.col("has"), F.col("named")).otherwise(plain)), "head_no", "has", "places")
    data = rows.where(~F.col("has") | (F.col("line_no") > F.col("head_no")))
    cells = F.split("value", ",")
    ordered = data.withColumn("cells", F.transform("places", lambda p: F.trim(F.get(cells, (p - 1).cast("int")))))
    return ordered.select("source_file", "line_no", *samples(F.col("cells"))).where("time is not null")


def read_header_ascii(spark: SparkSession, folder: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """source_file, line_no, time, and the wanted columns as text, from files whose header is found by its words.

    The header is the first line with the words year, doy and millisecs; data begin two lines below; lines with more
    fields than the header are skipped, and so are files without a header. ``wanted`` maps header words to column names;
    a file whose header lacks one of them is an error. Without ``wanted`` all columns but the times come as one
    map ``cells`` from header word to text.
    """

    def words(line: Column) -> Column:
        return F.split(F.trim(line), r"\s+")

    times_of = ("year", "doy", "millisecs")
    keys = [*times_of, *[k.lower() for k in wanted or ()]]
    # The first such line ends the search, and what is above it isn't split into lines.
    header = r"(?dim)^" + "".join(rf"(?=(?:.*\s)?{w}(?:\s|$))".replace(r"\s", r"[ \t\x0B\f]") for w in times_of) + ".*"
    files = whole_texts(spark, folder).withColumn("cut", F.split("text", header, 2)).where(F.size("cut") == 2).withColumn("named", words(F.regexp_extract("text", header, 0)))
    files = files.withColumn("head", F.transform("named", lambda x: F.lower(x)))
    if wanted:
        files = complete(files, ~F.forall(F.array(*[F.lit(k.lower()) for k in wanted]), lambda k: F.array_contains("head", k)))
    above, below = F.get("cut", F.lit(0)), F.get("cut", F.lit(1))
    places = F.array(*[(F.nullif(F.array_position("head", F.lit(k)), F.lit(0)) - 1).cast("int") for k in keys])
    files = files.select("source_file", "named", (F.length(above) - F.length(F.replace(above, F.lit("\n"))) + 1).alias("head_no"), places.alias("places"), F.size("head").alias("width"), below.alias("below"))
    # A line is split and timed where it is made, so that no filter does it again.
    split = F.transform(F.split("below", "\n"), words)
    cells = F.transform(split, lambda x: F.struct(x.alias("words"), F.transform(F.slice("places", 1, len(times_of)), lambda k: clean.number(F.get(x, k))).alias("at")))
    rows = F.transform(cells, lambda x: F.struct(x["words"].alias("words"), times.from_day_of_year(*[F.get(x["at"], F.lit(i)) for i in range(len(times_of))]).alias("time")))
    data = files.select("source_file", "named", "head_no", "places", "width", F.posexplode(rows).alias("below_head", "row")).select("*", "row.words", "row.time")
    data = data.where((F.col("below_head") >= 2) & (F.size("words") <= F.col("width"))).withColumn("line_no", F.col("head_no") + F.col("below_head"))

    def cell(name: str) -> Column:
        return F.get("words", F.get("places", F.lit(keys.index(name.lower()))))

    if wanted:
        others = [cell(k).alias(v) for k, v in wanted.items()]
    else:
        pairs = F.transform("named", lambda name, i: F.struct(name.alias("key"), F.get("words", i).alias("value")))
        others = [F.map_from_entries(F.filter(pairs, lambda x: ~F.lower(x["key"]).isin(*times_of))).alias("cells")]
    return data.where("time is not null").select("source_file", "line_no", "time", *others)


def read_preamble(spark: SparkSession, folder: str, skip: int, columns: list[str], keep_bad_times: bool = False) -> DataFrame:
    """source_file, line_no, time, columns as text, from delimited files after ``skip`` lines and a header.

    The delimiter is the comma or tab, whichever the header has more of; the time column is the first whose name holds
    epoch, time or date. Rows with a bad time go, unless they are kept (with a null time) to be counted.
    """
    head_no = F.array_position(F.transform("all", lambda x, i: (i >= skip) & (F.trim(x) != "")), F.lit(True)).cast("int")
    files = whole_files(spark, folder).withColumn("head_no", head_no).where("head_no > 0").withColumn("head", F.get("all", F.col("head_no") - 1))
    tabs = F.length(F.regexp_replace("head", "[^\t]", "")) > F.length(F.regexp_replace("head", "[^,]", ""))
    named = files.withColumn("d", F.when(tabs, "\t").otherwise(",")).withColumn("names", F.transform(F.split(F.lower("head"), F.col("d")), lambda x: F.trim(x)))
    data = lines(named, "head_no", "d", "names").where(F.col("line_no") > F.col("head_no")).withColumn("cells", F.split("value", F.col("d")))
    time_name = F.get(F.filter("names", lambda n: n.rlike("epoch|time|date")), F.lit(0))

    def cell(name: Column) -> Column:
        return F.trim(F.get("cells", (F.nullif(F.array_position("names", name), F.lit(0)) - 1).cast("int")))

    out = data.select("source_file", "line_no", times.from_iso(cell(time_name)).alias("time"), *[cell(F.lit(c.lower())).alias(c) for c in columns])
    return out if keep_bad_times else out.where("time is not null")


def file_audit(rows: DataFrame, value_flag: str) -> DataFrame:
    """Per file of read samples: rows, missing values, first and last time, repeated times, and whether all times are of the date in its name."""
    name = F.element_at(F.split("source_file", "/"), -1)
    grouped = rows.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), F.sum(value_flag).alias("n_missing"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), (F.count("*") - F.countDistinct("time")).alias("n_repeated")
    )
    date = times.date_in_name(name)
    match = (F.to_date("first_time") == date) & (F.to_date("last_time") == date)
    return grouped.withColumn("date_matches", F.when(date.isNotNull(), match))


def keep_last_file(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same keys, the one of the last file (by name), and there of the last line; with their number."""
    from ..operators.spine import dedup_keep_last

    return dedup_keep_last(df, keys, F.col("source_file"), F.col("line_no"))


def write_if_incomplete(df: DataFrame, path: str, required: list[str], expected_rows: int | None = None) -> DataFrame:
    """The table at ``path`` if it has the columns (and rows), else written from ``df``. The row count comes from file footers."""
    spark = df.sparkSession
    if exists(spark, path):
        there = spark.read.parquet(path)
        if set(required) <= set(there.columns) and (expected_rows is None or there.count() == expected_rows):
            return there
    replace(df, path)
    return spark.read.schema(df.schema).parquet(path)


MANIFEST = "path string, length bigint, modified timestamp, day string"


def rebuild_by_day(spark: SparkSession, source: str, product: str, build: Callable[[list[str]], DataFrame], day_pattern: str) -> list[str]:
    """Brings a table of days at ``product`` up to date with the files below ``source``; the days that were rebuilt or taken out.

    The first group of ``day_pattern`` in a file's path is its day; files without one are left out. A manifest beside the
    table has the path, length and time of each file that went into it. Days with a file that is new, changed or gone are touched: ``build``
    makes the rows of their files (with a column ``day``), which replace the partitions of these days and no others. The manifest
    follows last, so a run that breaks off is made good by the next one.
    """
    manifest = f"{product.rstrip('/')}.manifest"
    day = F.regexp_extract("path", day_pattern, 1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", F.col("modificationTime").alias("modified"))
    now = staged(listed.withColumn("day", day).where("day <> ''"), "listing")
    known = spark.read.schema(MANIFEST).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], MANIFEST)
    same = ["path", "length", "modified"]
    touched = staged(now.join(known, same, "left_anti").select("day").union(known.join(now, same, "left_anti").select("day")).distinct(), "touched")
    days = sorted(r["day"] for r in touched.collect())  # one row per day
    if days:
        paths = [r["path"] for r in now.join(touched, "day", "left_semi").select("path").collect()]  # as many as are read next
        if paths:
            build(paths).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(product)
        there = {r["day"] for r in now.select("day").distinct().collect()}
        for gone in sorted(set(days) - there):
            delete(spark, f"{product.rstrip('/')}/day={gone}")
        replace(now, manifest)
    return days


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report table as CSV with header, or as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path) if form == "csv" else writer.json(path)
