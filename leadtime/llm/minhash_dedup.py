"""Near-duplicate documents by b-bit MinHash: bands give candidates, packed low bits an estimate, full sets the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, row_keys, small_batches, stage
from .graph import components
from .textbytes import WORD_BASE, Words, lowered, mix, pieces, powers, shingles

#: Hash functions; the first ones make BANDS of ROWS. A pair at similarity 0.8 shares no band with probability
#: (1 - 0.8**4)**32 = 5e-8.
HASHES, BANDS, ROWS = 256, 32, 4
#: Low bits of each minimum that the packed signature keeps.
BITS = 4
#: A pair is verified unless its estimated similarity is so far below the threshold: 4.6 standard deviations of 0.026.
SLACK = 0.12
#: Rounds in which a band's documents are compared with one of them, before the pairs that are left.
STAR_ROUNDS = 2
#: A shingle that at most so many of the sets still open hold is rare: its sets may be paired, as their pairs are in proportion to them.
RARE = 64
FILTER_BITS = 24
SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and their offsets. A text of fewer words is one shingle."""
    hashes = words.hashes()
    grams = shingles(hashes, size)
    left = np.repeat(words.doc_off[1:], words.per_doc) - np.arange(len(words))
    starts = np.flatnonzero(left[: len(grams)] >= size)
    doc = words.doc()[starts]
    value = grams[starts]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < size))
    if len(short):
        whole = [shingles(hashes[words.doc_off[d] : words.doc_off[d + 1]], int(words.per_doc[d]), WORD_BASE + np.uint64(2 * words.per_doc[d]))[0] for d in short]
        doc, value = np.r_[doc, short], np.r_[value, np.array(whole, np.uint64)]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(words.per_doc) + 1))


def signatures(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set that is not empty, the least value of each of HASHES functions, as 32 bits."""
    starts = off[:-1][np.diff(off) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        hashed = ((value * (SEEDS[2 * k] | np.uint64(1)) + SEEDS[2 * k + 1]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS minima, which also tells the bands apart."""
    banded = minima[:, : BANDS * ROWS].reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(banded.shape[1], dtype=np.uint64), (len(minima), 1))
    for j in range(ROWS):
        keys = mix(keys * WORD_BASE + banded[:, :, j] + np.uint64(1))
    return keys.astype(np.int64)


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, one bit plane after another, as 64-bit integers."""
    planes = np.concatenate([(minima >> b) & 1 for b in range(BITS)], axis=1).astype(np.uint8)
    return np.packbits(planes, axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """The similarity of two sets from their packed signatures.

    Minima agree in all low bits where no bit plane differs; by chance they do so with probability 2**-BITS.
    """
    words = HASHES // 64
    different = None
    for w in range(words):
        planes = [F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w))) for p in range(BITS)]
        any_plane = planes[0]
        for p in planes[1:]:
            any_plane = any_plane.bitwiseOR(p)
        n = F.bit_count(any_plane)
        different = n if different is None else different + n
    same = 1 - different / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """id, n, set_a, set_b (128 bits of hash of the shingle set), packed, bands of each row of (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches, "text"):
            value, set_off = shingle_sets(Words(lowered(raw), off), size)
            n = np.diff(set_off)
            full = np.flatnonzero(n > 0)
            a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            packed, bands = np.zeros((len(n), HASHES * BITS // 64), np.int64), np.zeros((len(n), BANDS), np.int64)
            if len(full):
                for out, salt in ((a, 1), (b, 2)):
                    spread = mix(value * SEEDS[salt] + SEEDS[salt + 2])
                    out[full] = mix(np.add.reduceat(spread, set_off[:-1][full]) + n[full].astype(np.uint64)).astype(np.int64)
                minima = signatures(value, set_off)
                packed[full], bands[full] = pack(minima), band_keys(minima)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(a), pa.array(b), longs(packed), longs(bands)], names=["id", "n", "set_a", "set_b", "packed", "bands"])

    return docs.mapInArrow(find, f"id {kind}, n bigint, set_a bigint, set_b bigint, packed array<bigint>, bands array<bigint>")


def longs(rows: np.ndarray) -> pa.Array:
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(rows.ravel()))


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, shingles (sorted) of the wanted ids (distinct, not null).

    A bitmap of fixed size drops most other texts before they are moved; the join drops the rest.
    """
    spark = docs.sparkSession
    flags = spark.sparkContext.broadcast(np.frombuffer(bitmap(F.xxhash64("id"), wanted, FILTER_BITS), np.uint8))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            may = (flags.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            for rows, raw, off in pieces(iter([batch.filter(pa.array(may.astype(bool)))]), "text"):
                value, set_off = shingle_sets(Words(lowered(raw), off), size)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(set_off.astype(np.int32)), pa.array(value.astype(np.int64)))], names=["id", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    slots = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("slot"))
    return slots.mapInArrow(find, f"id {kind}, shingles array<bigint>").join(wanted, "id", "left_semi")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A document's set is its distinct runs of ``shingle_words`` words, A-Z lower-cased; with fewer words the whole
    sequence. Documents are linked if their sets' Jaccard similarity is at least ``similarity``;
    ``component_id`` is the smallest id that a document reaches by links, and ``kept`` tells whether that is its
    own. Documents without words are linked with nothing. Rows that repeat an id, or have none, are documents of
    their own, and one row of a group is kept; a null id is never the smallest while there is another. Other
    columns are ignored.

    Documents of equal sets become one class, so that a group of copies is one row from there on. Classes
    that share a band are candidates. In each of some rounds, each band has one class as its hub (the smallest, then
    the one with the fewest shingles of its own), and each class is compared with one hub of its
    bands that is not in its component yet. So a large group of near copies becomes one component by about
    one comparison each. At last the classes whose components still differ are compared by the rare shingles that they share,
    and by their bands where they have few rare ones (see :func:`last_pairs`), so that no component is left apart.
    """
    small_batches(docs.sparkSession)
    docs, key_col = row_keys(docs, id_col)
    if key_col != id_col:
        found = near_duplicates(docs, shingle_words, similarity, key_col, text_col)
        ids = docs.select(key_col, id_col)
        first = ids.select(F.col(key_col).alias("component_id"), F.col(id_col).alias("first_id"))
        named = found.join(ids, key_col).join(first, "component_id")
        return named.select(id_col, "n_shingles", F.col("first_id").alias("component_id"), "kept")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stage(sketch(base, shingle_words), "sketches")
    has_set = F.col("n") > 0
    classes = stage(rows.where(has_set).groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    # One row of each class stands for it.
    reps = rows.where(has_set).join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("id = rep").dropDuplicates(["id"])
    reps = stage(reps.select("id", "n", "packed", "bands"), "reps")
    keyed = reps.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("band")
    members = stage(keyed.join(shared, "band"), "members")
    linked = linked_classes(base, reps, members, shingle_words, similarity)
    found = classes.join(linked, classes["rep"] == linked["node"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    full = stage(found, "components")
    joined = rows.where(has_set).join(full, ["set_a", "set_b"]).select("id", "n", F.coalesce("component", "id").alias("component"))
    out = joined.unionByName(rows.where(~has_set).select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def mixed_bands(rows: DataFrame) -> DataFrame:
    """The rows of bands that still hold more than one component."""
    mixed = rows.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    return rows.join(stage(mixed, "bands"), "band")


def rare_shingles(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingle, held: the shingles of the sets of ``ids`` that at most RARE of them hold, and how many do."""
    spread = stage(sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("shingle")), "spread")
    held = spread.groupBy("shingle").agg(F.count("*").alias("held")).where(F.col("held") <= RARE)
    return spread.join(stage(held, "held"), "shingle").select("id", "shingle", "held")


def last_pairs(open_: DataFrame, rare: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of open classes that may be linked and are not in one component; those that are linked are all among them.

    Two linked sets of n and m shingles share t = ceil(s / (1 + s) * (n + m)) of them at least. With each set's shingles in the
    order of how many sets hold them, both have one of those that they share among their first n - t + 1 and m - t + 1. So sets meet
    by the rare ones of these. A pair that no rare shingle joins shares at most what is not rare: only sets with few enough
    rare ones, and only pairs whose sizes allow it, are compared by their bands.
    """
    percent = round(100 * similarity)
    smallest = open_.groupBy("band").agg(F.min("n").alias("least"))
    nodes = open_.join(smallest, "band").groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.min("least").alias("least"))
    least = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    nodes = nodes.withColumn("prefix", F.col("n") - F.ceil((F.col("n") + least) * percent / (100 + percent)) + 1)
    held = rare.groupBy("id").agg(F.count("*").alias("n_rare"), F.sum(F.when(F.col("held") == 1, 1).otherwise(0)).alias("own"), F.array_sort(F.collect_list(F.when(F.col("held") > 1, F.struct("held", "shingle")))).alias("shared"))
    nodes = nodes.join(held, "id", "left").select("id", "component", "n", "prefix", F.coalesce("n_rare", F.lit(0)).alias("n_rare"), F.coalesce("own", F.lit(0)).alias("own"), "shared")
    nodes = stage(nodes, "nodes")
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - F.col("own")).cast("int"))
    keyed = stage(nodes.where("shared is not null").select("id", "component", "n", F.explode(first.getField("shingle")).alias("shingle")), "prefixes")
    mine, other = keyed.toDF("b", "b_component", "b_n", "shingle"), keyed.toDF("a", "a_component", "a_n", "shingle")
    sized = percent * F.greatest("a_n", "b_n") <= 100 * F.least("a_n", "b_n")
    by_shingle = mine.join(other, "shingle").where((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & sized).select("a", "b")
    few = stage(nodes.where("n_rare < prefix").select("id", "n_rare"), "few")
    left = mixed_bands(open_.join(few, "id")).join(reps.select("id", "bands", "packed"), "id")
    other = left.select(*[F.col(c).alias("a" if c == "id" else f"a_{c}") for c in ("id", "band", "component", "n", "n_rare", "bands", "packed")])
    common = F.least(F.col("n") - F.col("n_rare"), F.col("a_n") - F.col("a_n_rare"))
    likely = (F.col("a") < F.col("id")) & (F.col("component") != F.col("a_component")) & (100 * common >= percent * (F.col("n") + F.col("a_n") - common))
    # Each pair once, in the first of the bands that both share.
    likely = likely & (estimate(F.col("packed"), F.col("a_packed")) >= similarity - SLACK) & (F.get(F.array_intersect("bands", "a_bands"), F.lit(0)) == F.col("band"))
    by_band = left.join(other, (F.col("band") == F.col("a_band")) & likely).select("a", F.col("id").alias("b"))
    return by_shingle.unionByName(by_band)


def linked_classes(base: DataFrame, reps: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """node, component of the classes that have a link.

    In each of STAR_ROUNDS rounds, each band has a hub and each class is compared with one hub. At last the pairs that
    may still be linked are compared.
    """
    wanted = members.select("id").distinct()
    sets = stage(full_sets(base, wanted, size).join(reps.select("id", "n", "packed"), "id").dropDuplicates(["id"]), "sets")
    small = stage(sets.select("id", "n", "packed"), "packed")
    labels = rare = None
    rows = stage(members.join(small.select("id", "n"), "id").select("id", "band", F.col("n").cast("bigint").alias("n")), "rows")
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            now = rows.withColumn("component", F.col("id"))
        else:
            now = rows.join(labels, rows["id"] == labels["node"], "left").select("id", "band", "n", F.coalesce("component", "id").alias("component"))
        open_ = stage(mixed_bands(now).select("id", "band", "n", "component"), "open")
        if open_.isEmpty():
            break
        if rare is None and turn in (1, STAR_ROUNDS):
            rare = stage(rare_shingles(sets, open_.select("id").distinct()), "rare")
            shares = stage(rare.groupBy("id").agg(F.count("*").alias("n_rare")), "shares")
        if turn < STAR_ROUNDS:
            ranked = open_.withColumn("rank", F.lit(0.0))
            if rare is not None:
                ranked = open_.join(shares, "id", "left").select(*open_.columns, (F.coalesce("n_rare", F.lit(0)) / F.col("n")).alias("rank"))
            order = F.struct("rank", "id")
            hubs = stage(ranked.groupBy("band").agg(F.min_by(F.struct("id", "component"), order).alias("hub"), F.min(order).alias("rank")).select("band", "hub.*", "rank").toDF("band", "a", "a_component", "rank"), "hubs")
            offers = open_.join(hubs, "band").where("component <> a_component")
            chosen = offers.groupBy("id").agg(F.min_by("a", "rank").alias("a"))
            pairs = chosen.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        else:
            pairs = last_pairs(open_, rare, reps, similarity)
        new = stage(verified(pairs.distinct(), small, sets, similarity), "links")
        if labels is None:
            labels = stage(components(new), "labels")
        elif not new.isEmpty():
            # What is connected already goes in as one link to its component.
            known = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = stage(components(known.unionByName(new)), "labels")
        rows = open_.drop("component")
    if labels is None:
        return members.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    return labels


def verified(pairs: DataFrame, small: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sizes and packed signatures rule out most others first."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in df.columns])

    likely = pairs.join(named(small, "a"), "a").join(named(small, "b"), "b")
    likely = likely.where((F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-9) & (estimate(F.col("a_packed"), F.col("b_packed")) >= similarity - SLACK))
    likely = stage(likely.select("a", "b"), "likely")
    full = sets.select("id", "n", "shingles")
    both = likely.join(named(full, "a"), "a").join(named(full, "b"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.where(100 * common >= round(100 * similarity) * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")
