"""Queries on readers, writers and streams. The files are written from the driver tables by Spark, then read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, times
from ..sources import files
from ..sources.staging import delete, shared_folder
from ..streaming import resample as streams
from . import standins as s


def event_lines(spark, sf_dir, separator: str) -> DataFrame:
    ev = s.table(spark, sf_dir, "events")
    second = F.date_format("ts", "s.SSSSSS")
    parts = [F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), second, F.col("value").cast("string")]
    return ev.select("event_type", "event_id", F.concat_ws(separator, *parts).alias("line"))


def by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.datediff(F.col("time").cast("date"), F.lit(s.FIRST_DAY)).alias("k")).agg(
        F.count("*").alias("n"), F.sum("value_missing_flag").alias("n_missing"), F.round(F.sum("value"), 4).alias("total")
    )


def src_discover(spark, sf_dir):
    folder = shared_folder(spark, "discover")
    years = s.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("line"))
    years.repartition("year").write.partitionBy("year").text(folder)
    return files.discover(spark, folder).groupBy(F.lower(F.regexp_extract("name", r"\.(\w+)$", 1)).alias("suffix")).agg(F.count("*").alias("n_files"))


def src_samples_text(spark, sf_dir):
    folder = shared_folder(spark, "samples")
    event_lines(spark, sf_dir, "  ").select("event_type", F.concat("line", F.when(F.col("event_id") % 3 == 0, "  7 # note").otherwise("")).alias("line")).write.partitionBy("event_type").text(folder)
    return by_day(files.read_samples(spark, folder))


def src_samples_csv(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    event_lines(spark, sf_dir, ",").where("event_id % 2 = 0").select("line").write.text(f"{folder}/plain")
    ev = s.table(spark, sf_dir, "events").where("event_id % 2 = 1")
    named = ev.select(
        F.date_format("ts", "s.SSSSSS").alias("second"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
        F.minute("ts").alias("minute"), F.col("value").alias("gic_a"),
    )
    named.write.option("header", "true").csv(f"{folder}/named")
    return by_day(files.read_samples_csv(spark, folder))


#: Lines in each of the files that are written whole.
FILE_LINES = 10_000


def write_whole_files(rows: DataFrame, order: str, head: str, folder: str) -> None:
    """(order, line) rows as files of about FILE_LINES lines each: the head, then lines in order. The number of files grows with the rows."""
    n = max(4, -(-rows.count() // FILE_LINES))
    texts = rows.groupBy(F.pmod(F.xxhash64(order), F.lit(n)).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    texts.select("part", F.concat(F.lit(head), F.col("body")).alias("text")).write.partitionBy("part").text(folder)


def src_ascii_header(spark, sf_dir):
    folder = shared_folder(spark, "ascii")
    o = s.table(spark, sf_dir, "orders")
    line = F.concat_ws(" ", F.year("o_orderdate"), F.dayofyear("o_orderdate"), F.col("o_custkey") % 86400 * 1000, F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 11 == 0, "1 2 3").otherwise("5"))
    write_whole_files(o.select("o_orderkey", line.alias("line")), "o_orderkey", "some notes\nYear DOY Millisecs B Np\n- - - nT cc\n", folder)
    out = files.read_header_ascii(spark, folder, {"B": "b", "Np": "density"})
    return out.groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(clean.number(F.col("b"))), 2).alias("b"), F.sum(clean.number(F.col("density"))).alias("density"))


def src_preamble_delim(spark, sf_dir):
    folder = shared_folder(spark, "preamble")
    e = s.table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    rows = e.select("event_id", F.concat_ws("\t", F.col("user_id").cast("string"), stamp, F.col("value").cast("string")).alias("line"))
    write_whole_files(rows, "event_id", "note 1\nnote 2\nnote, 3\nuser\tEpoch_time\tB_total\n", folder)
    out = files.read_preamble(spark, folder, 3, ["user", "B_total"])
    return out.groupBy(F.hour("time").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum(clean.number(F.col("B_total"))), 4).alias("total"), F.sum(clean.number(F.col("user"))).alias("users"))


def src_product_keep_last(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("line_no"), "o_totalprice")
    both = o.withColumn("source_file", F.lit("f1.txt")).unionByName(o.where("line_no % 3 = 0").withColumn("source_file", F.lit("f2.txt")))
    return files.keep_last_file(both, ["o_custkey"])


def product_reuse(spark, sf_dir):
    """Written once; the second call finds it complete, the third finds too few rows and writes again."""
    folder = shared_folder(spark, "product")
    o = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    half = files.write_if_incomplete(o.where("o_orderkey % 2 = 0"), f"{folder}/t", ["o_orderkey"])
    n_half = half.count()
    again = files.write_if_incomplete(o, f"{folder}/t", ["o_orderkey"], n_half).count()
    full = files.write_if_incomplete(o, f"{folder}/t", ["o_orderkey", "o_totalprice"], o.count())
    return full.agg(F.count("*").alias("n_rows"), F.lit(n_half).cast("bigint").alias("n_half"), F.lit(again).cast("bigint").alias("n_again"))


def src_report(spark, sf_dir):
    """Reports written as CSV and as JSON lines, read back and compared."""
    folder = shared_folder(spark, "report")
    table = s.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    files.write_report(table, f"{folder}/csv")
    files.write_report(table, f"{folder}/json", "json")
    a = spark.read.schema(table.schema).option("header", "true").csv(f"{folder}/csv")
    return a.intersect(spark.read.schema(table.schema).json(f"{folder}/json"))


def drained(spark, sf_dir, folder: str, result: Callable[[DataFrame], DataFrame], mode: str, landings: int = 4) -> None:
    """The events land in the order of their times, each landing as files of all tasks; after each, the stream drains what is new."""
    ev = s.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("source_file"))
    first, last = F.lit(s.START).cast("timestamp_ntz"), F.lit(s.END).cast("timestamp_ntz")
    part = F.greatest(F.lit(0), F.least(F.floor(F.timestamp_diff("HOUR", first, F.col("ts")) * landings / F.timestamp_diff("HOUR", first, last)), F.lit(landings - 1)))
    for k in range(landings):
        ev.where(part == k).write.mode("append").parquet(f"{folder}/in")
        streams.drain(result(spark.readStream.schema(ev.schema).parquet(f"{folder}/in")), folder, mode)


def newest(spark, folder: str) -> DataFrame:
    """The rows of the last batch."""
    out = spark.read.parquet(f"{folder}/out")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def stream_resample(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    drained(spark, sf_dir, folder, lambda stream: streams.stream_resample(stream, "event_type", "ts", "value", "event_id"), "append")
    hour = F.floor((times.micros(F.col("start")) - times.micros(F.lit(s.START).cast("timestamp_ntz"))) / 3_600_000_000)
    return streams.resampled(spark, folder, "event_type", "value").select(F.col("event_type").alias("series"), hour.alias("h"), "value")


def stream_file_audit(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    drained(spark, sf_dir, folder, lambda stream: streams.stream_file_audit(stream, "value"), "complete")
    return newest(spark, folder)


def product_by_day(spark, sf_dir):
    """A table of days made from files of days, then again after one day's files have changed and another's are gone: only these are rebuilt."""
    folder = shared_folder(spark, "days")
    ev = s.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), "event_id", "value")
    ev.write.partitionBy("day").parquet(f"{folder}/in")

    def build(paths: list[str]) -> DataFrame:
        return spark.read.option("basePath", f"{folder}/in").schema("event_id bigint, value double, day string").parquet(*paths).groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    first = files.rebuild_by_day(spark, f"{folder}/in", f"{folder}/out", build, r"day=(\d{8})")
    days = ev.select("day").distinct().orderBy("day").limit(2)
    changed, gone = (r["day"] for r in days.collect())
    ev.where(F.col("day") == changed).select("event_id", (F.col("value") * 2).alias("value")).write.mode("overwrite").parquet(f"{folder}/in/day={changed}")
    delete(spark, f"{folder}/in/day={gone}")
    second = files.rebuild_by_day(spark, f"{folder}/in", f"{folder}/out", build, r"day=(\d{8})")
    table = spark.read.schema("n bigint, total double, day string").parquet(f"{folder}/out")
    return table.select("day", "n", F.round("total", 4).alias("total"), F.col("day").isin(second).alias("rebuilt"), F.lit(len(first)).cast("bigint").alias("n_first"))


QUERIES = {
    f.__name__: f
    for f in (src_discover, src_samples_text, src_samples_csv, src_ascii_header, src_preamble_delim, src_product_keep_last, product_reuse, product_by_day, src_report, stream_resample, stream_file_audit)
}

_NINE = r"regexp_full_match(CAST(value AS VARCHAR), '[+-]?9+(\.9+)?(e[+-]?\d+)?') AND len(regexp_replace(CAST(value AS VARCHAR), '[^9]', '', 'g')) >= 3"
_SAMPLES = f"""SELECT CAST(date_diff('day', DATE '{s.FIRST_DAY}', CAST(ts AS DATE)) AS BIGINT) AS k, count(*) AS n, count(*) FILTER (NOT ok) AS n_missing, round(sum(value) FILTER (ok), 4) AS total
FROM (SELECT *, abs(value) <= 120 AND NOT list_bool_or([abs(abs(value) - z) <= 1e-6 FOR z IN [9.99, 99.99, 999.99, 9999.99, 999.9, 9999.9, 99999.9]]) AND NOT ({_NINE}) AS ok FROM events) GROUP BY 1"""

ORACLE = {
    "src_discover": "SELECT 'txt' AS suffix, count(DISTINCT year(o_orderdate)) AS n_files FROM orders",
    "src_samples_text": _SAMPLES,
    "src_samples_csv": _SAMPLES,
    "src_ascii_header": "SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS b, 5e0 * count(*) AS density FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1",
    "src_preamble_delim": "SELECT hour(ts) AS hour, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(user_id) AS DOUBLE) AS users FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "src_product_keep_last": """WITH b AS (SELECT o_custkey, o_orderkey AS line_no, o_totalprice, 'f1.txt' AS source_file FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'f2.txt' FROM orders WHERE o_orderkey % 3 = 0)
SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY source_file DESC, line_no DESC) = 1""",
    "product_reuse": "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 2 = 0) AS n_half, count(*) FILTER (o_orderkey % 2 = 0) AS n_again FROM orders",
    "product_by_day": """WITH e AS (SELECT strftime(ts, '%Y%m%d') AS day, value FROM events), d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n_first FROM (SELECT DISTINCT day FROM e))
SELECT day, count(*) AS n, round(sum(value) * CASE WHEN k = 1 THEN 2 ELSE 1 END, 4) AS total, k = 1 AS rebuilt, n_first FROM e JOIN d USING (day) WHERE k <> 2 GROUP BY day, k, n_first""",
    "src_report": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "stream_resample": f"""SELECT event_type AS series, CAST(date_diff('hour', TIMESTAMP '{s.START}', date_trunc('hour', ts)) AS BIGINT) AS h, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY abs(value) DESC, event_id) = 1""",
    "stream_file_audit": "SELECT 'f' || CAST(event_id % 5 AS VARCHAR) AS source_file, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_missing FROM events GROUP BY 1",
}
