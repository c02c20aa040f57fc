"""What the document operators share: staged tables, word patterns, a bounded membership filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder

#: A run of white space, and a word: what lies between such runs.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches of texts have about so many bytes at most; one longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet (with row groups of about ``block_bytes``) in the shared folder and read it back.

    This cuts lineage the way ``checkpoint()`` does, keeps column pruning, and tells the planner the true
    size. A lost executor costs nothing, as no part of the table lives on one. The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"stage-{name}")
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A filter of :func:`maybe_in` has 2**MAX_BITS bits at most.
MAX_BITS = 26


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get to BATCH_BYTES each, so that long texts don't fill their memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # as it is when nobody has set it
        spark.conf.set(key, str(BATCH_BYTES))


def row_keys(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows, and the name of a column that is never null and different for each of them.

    That is ``id_col`` itself if no id is null or repeated. Otherwise it is a new text column: the id in an order
    that texts keep (null last), a hash of the row, and a number that tells equal rows apart. The rows are staged
    with it, so it stays the same wherever they are read again.
    """
    if docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    name = "row_key"
    while name in docs.columns:
        name += "_"
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    ordered = F.lpad(F.hex(F.col(id_col).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.concat(F.lit("0"), F.col(id_col).cast("string"))
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in docs.columns]).cast("binary"))
    key = F.concat_ws("\x00", F.coalesce(ordered, F.lit("~")), row, F.monotonically_increasing_id().cast("string"))
    return stage(docs.withColumn(name, key), "keyed"), name


def squeeze(text: Column) -> Column:
    """Null as empty, and each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_back(doc_id: Column, parts: int) -> Column:
    """crc32 of the id, written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def bitmap(keys: Column | str, df: DataFrame, bits: int) -> bytes:
    """A bit for each ``key mod 2**bits`` that occurs, as 2**bits / 8 bytes.

    The result has a fixed size whatever the input, so it can be broadcast. A set bit says "perhaps here",
    a clear one says "surely not", so dropping rows by it loses none.
    """
    slot = F.pmod(F.col(keys) if isinstance(keys, str) else keys, F.lit(1 << bits)).cast("long")
    blocks = (
        df.select(slot.alias("_slot"))
        .groupBy(F.shiftright("_slot", 15).alias("_block"))
        .agg(F.bitmap_construct_agg(F.pmod("_slot", F.lit(1 << 15))).alias("_bits"))
    )
    out = bytearray(1 << (bits - 3))
    for row in blocks.toLocalIterator():
        out[row["_block"] << 12 : (row["_block"] + 1) << 12] = row["_bits"]
    return bytes(out)


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds whether ``key`` may be in ``keys`` (one column of hashes, staged): true for all that are, and for few others.

    A bit stands for each key modulo a power of two, 16 times the number of keys up to 2**MAX_BITS. The bits are a table of
    blocks of 4 KB, of 2**MAX_BITS bits (8 MB) in all at most, so it can be broadcast whatever the input.
    """
    bits = min(MAX_BITS, max(16, (16 * keys.count()).bit_length()))
    size = F.lit(1 << bits)
    slot = F.pmod(F.col(keys.columns[0]), size).cast("long")
    blocks = keys.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 15).alias("_block")).agg(F.bitmap_construct_agg(F.pmod("_slot", F.lit(1 << 15))).alias("_bits"))
    own = df.withColumn("_slot", F.pmod(key, size).cast("long")).withColumn("_block", F.shiftright("_slot", 15))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(F.pmod("_slot", F.lit(1 << 15)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod("_slot", F.lit(8)).cast("int")) == 1, F.lit(False))
    return own.join(F.broadcast(stage(blocks, "blocks")), "_block", "left").select(*df.columns, there.alias(name))
