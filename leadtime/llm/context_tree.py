"""Language-model scoring by context-tree weighting over bytes, beside a word-unigram base score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_back, small_batches, stage
from .textbytes import Words, lowered, mix, pieces
from .unigram import distinct_words, sums

#: Contexts of up to so many bytes.
DEPTH = 5
#: About so many of the most frequent grams are scored from a broadcast table (16 bytes each), the others in a join.
TOP_GRAMS = 1 << 20
#: About so many of the most frequent words are looked up in a broadcast table, the others in a join.
TOP_WORDS = 262_144
#: The byte after the last word of a text, which is also the context before its first.
END = 10
#: Grams are made, counted and looked up for about so many bytes at a time, whatever the length of a text.
SLICE_BYTES = 1 << 18


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5, by Stirling's series at x + 7."""
    z = x + 7
    product = F.lit(1.0)
    for k in range(7):
        product = product * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a string of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def log_half_sum(a: Column, b: Column) -> Column:
    """ln((e^a + e^b) / 2)."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top)) - math.log(2)


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text as its words, a space between two, END after the last; and the offsets of the texts."""
    gaps = np.zeros(len(words) + len(words.per_doc), np.int64)
    # Words and ends in the order of the texts: a text's end comes after its words.
    end_at = words.doc_off[1:] + np.arange(len(words.per_doc))
    is_end = np.zeros(len(gaps), bool)
    is_end[end_at] = True
    sizes = gaps.copy()
    sizes[~is_end] = words.lengths + 1  # with the space after it, which becomes END after a last word
    sizes[is_end] = (words.per_doc == 0).astype(np.int64)
    off = np.r_[0, np.cumsum(sizes)]
    out = np.full(off[-1], 32, np.uint8)
    of_word = np.ones(len(out), bool)
    of_word[off[1:][sizes > 0] - 1] = False
    out[of_word] = words.data
    doc_off = np.r_[0, off[end_at + 1]]
    out[doc_off[1:] - 1] = END
    return out, doc_off


def grams(data: np.ndarray, doc_off: np.ndarray, depth: int) -> np.ndarray:
    """For each byte, it and the ``depth`` bytes before it in its text as one integer; END stands before a text."""
    out = data.astype(np.int64)
    have = 1
    while have <= depth:
        take = min(have, depth + 1 - have)
        wider = out.copy()
        wider[have:] |= (out[:-have] & ((1 << (8 * take)) - 1)) << (8 * have)
        out, have = wider, have + take
    # The first bytes of a text have seen another one.
    ends = int.from_bytes(bytes([END] * (depth + 1)), "big")
    for k in range(depth):
        at = doc_off[:-1][np.diff(doc_off) > k] + k
        own = (1 << (8 * (k + 1))) - 1
        out[at] = (out[at] & own) | (ends & ~own)
    return out


def gram_slices(data: np.ndarray, doc_off: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """The same in slices of SLICE_BYTES bytes, each with the place of its first."""
    for lo in range(0, len(data), max(SLICE_BYTES, depth)):
        hi = min(lo + max(SLICE_BYTES, depth), len(data))
        since = max(0, lo - depth)
        starts = doc_off[np.searchsorted(doc_off, since) : np.searchsorted(doc_off, hi)]
        yield lo, grams(data[since:hi], np.r_[starts, hi] - since, depth)[lo - since :]


class Tally:
    """Counts of sorted integers, merged when what is pending is about as much as what is held."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        values.sort()
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        self.pending.append((values[first], np.diff(np.r_[first, len(values)])))
        if sum(len(k) for k, _ in self.pending) > len(self.keys):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
        n = np.concatenate([self.n, *(n for _, n in self.pending)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n, self.pending = keys[first], np.add.reduceat(n, first) if len(first) else n, []

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n
        self.__init__()
        return out


class Lookup:
    """Values of non-negative 64-bit keys in an open table at most half full; nan for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.nan)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[at], self.values[at] = keys[left[placed]], values[left[placed]]
            still = np.ones(len(left), bool)
            still[placed] = False
            left, slot = left[still], (slot[still] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.nan)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot_left = (slot[left] + 1) & self.mask
            slot[left] = slot_left
            there = self.keys[slot_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (there >= 0)]
        return out


def tallies(docs: DataFrame, depth: int) -> DataFrame:
    """word, gram, n: how often each word occurs, and how often each byte follows each context of ``depth`` bytes. The other of word and gram is null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def of_grams() -> pa.RecordBatch:
            keys, n = tally.rows()
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], names=["word", "gram", "n"])

        for _, raw, off in pieces(batches, "text"):
            words = Words(lowered(raw), off)
            coded = words.arrow().value_counts()
            yield pa.RecordBatch.from_arrays([coded.field(0).cast(pa.binary()), pa.nulls(len(coded), pa.int64()), coded.field(1)], names=["word", "gram", "n"])
            for _, part in gram_slices(*stream(words), depth):
                tally.add(part)
                if len(tally.keys) > 2_000_000:  # memory stays bounded: the sums are finished by the aggregate
                    yield of_grams()
        yield of_grams()

    return docs.mapInArrow(count, "word binary, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """gram, n: how often each byte follows each context of ``depth`` bytes."""
    return tallies(docs, depth).where("gram is not null").select("gram", "n")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest n, as many as there are down to a level of n, but not more than ``most``.

    Levels are sixteenths of powers of two, so their table is small whatever the counts.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, rows = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        rows += row["count"]
        if rows > most:
            break
        least = row["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


def context_tree(counts: DataFrame, depth: int) -> DataFrame:
    """The levels of :func:`tree_levels` in one table."""
    out, *deeper = tree_levels(counts, depth)
    for level in deeper:
        out = out.unionByName(level)
    return out


def tree_levels(counts: DataFrame, depth: int) -> list[DataFrame]:
    """depth, context, node, n, p for each depth from 0: the weighted tree, with the predicted probability of a 1 at each node.

    A byte is eight binary decisions; ``node`` (1 to 255) is the decision, by the bits before it. Each decision
    has a context tree of its own. Bottom up, a node's weighted probability of its training bits is the mean of
    its KT estimate and of the product of its children's. Top down, the share that a node's own estimate has
    in it is the posterior weight of stopping there. ``p`` mixes the estimates of a node and all nodes above it
    by these weights; the mass that children would have goes to the node itself.
    """
    byte = F.col("gram").bitwiseAND(F.lit(255))
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    split = counts.select(F.shiftright("gram", 8).alias("context"), byte.alias("byte"), "n", bits)
    node = F.expr("(shiftleft(1, k) + shiftright(byte, 8 - k))").cast("int")
    bit = F.expr("shiftright(byte, 7 - k) & 1")
    level = split.groupBy("context", node.alias("node")).agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"))
    level = stage(level.withColumn("own", log_kt(F.col("n0"), F.col("n1"))).withColumn("weighted", F.col("own")), "level")
    levels = [level]
    for d in range(depth - 1, -1, -1):
        above = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        level = level.groupBy(above.alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        level = level.withColumn("own", log_kt(F.col("n0"), F.col("n1")))
        level = stage(level.withColumn("weighted", log_half_sum(F.col("own"), F.col("below"))).drop("below"), "level")
        levels.append(level)
    levels.reverse()
    out = []
    passed = None
    for d, level in enumerate(levels):
        kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
        if passed is None:
            here = level.withColumn("mass", F.lit(1.0)).withColumn("mixed", F.lit(0.0))
        else:
            above = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
            here = level.withColumn("above", above).join(passed, ["above", "node"])
        stop = F.exp(F.col("own") - math.log(2) - F.col("weighted"))
        here = stage(
            here.select(F.lit(d).alias("depth"), "context", "node", (F.col("n0") + F.col("n1")).alias("n"), (F.col("mixed") + F.col("mass") * kt).alias("p"),
                        (F.col("mixed") + F.col("mass") * stop * kt).alias("mixed"), (F.col("mass") * (1 - stop)).alias("mass")),
            "tree",
        )
        passed = here.select(F.col("context").alias("above"), "node", "mass", "mixed")
        out.append(here.select("depth", "context", "node", "n", "p"))
    return out


def gram_parts(wanted: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """gram, gain, missed: what a level of the tree adds to log10 of the probability of each gram's last byte, and the decisions that it has no node for.

    ``wanted`` has grams (distinct) and ``missed``, a bit for each of the byte's eight decisions that is asked for.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    asked = wanted.select("gram", "missed", k).where(F.expr("(shiftright(missed, k) & 1) = 1"))
    asked = asked.select(
        "gram", "k", F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("context"),
        F.expr("cast(shiftleft(1, k) + shiftright(gram & 255, 8 - k) as int)").alias("node"), F.expr("shiftright(gram & 255, 7 - k) & 1").alias("bit"),
    )
    met = asked.join(level.select("context", "node", "p"), ["context", "node"], "left")
    gain = F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    missed = F.sum(F.when(F.col("p").isNull(), F.expr("shiftleft(1, k)")).otherwise(0)).cast("int")
    return met.groupBy("gram").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("gain"), missed.alias("missed"))


def known_gains(seen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """gram, gain of the grams that the tree is made of: the deepest level has all their decisions."""
    return gram_parts(seen.select("gram", F.lit(255).alias("missed")), levels[-1], len(levels) - 1).select("gram", "gain")


def gram_scores(wanted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """gram, gain: log10 of the probability of the last byte of each gram of ``wanted`` (distinct) after the bytes before it.

    Each of the byte's eight decisions takes the deepest context that the tree has for it. Level by level from
    the deepest, all decisions that are open meet the whole level in a join; what finds no node goes on with
    the next shorter context. A decision that no level has is even.
    """
    open_ = wanted.select("gram", F.lit(255).alias("missed"))
    parts = []
    for d in range(len(levels) - 1, -1, -1):
        done = stage(gram_parts(open_, levels[d], d), "gains")
        parts.append(done.select("gram", "gain"))
        open_ = done.where("missed > 0").select("gram", "missed")
    out = open_.select("gram", F.bit_count("missed") * F.lit(math.log10(0.5)))
    for part in parts:
        out = out.unionAll(part)
    return out.toDF("gram", "gain").groupBy("gram").agg(F.sum("gain").alias("gain"))


def gathered(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted grams and their gains, brought to the driver as packed arrays; for a number of grams that is bounded."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pa.array([x.to_numpy().tobytes()], pa.binary()) for x in batch.columns]
            yield pa.RecordBatch.from_arrays(packed, names=["grams", "gains"])

    rows = scores.select("gram", "gain").repartitionByRange("gram").sortWithinPartitions("gram")
    found, gains = bytearray(), bytearray()
    for row in rows.mapInArrow(pack, "grams binary, gains binary").collect():
        found += row["grams"]
        gains += row["gains"]
    return np.frombuffer(bytes(found), np.int64), np.frombuffer(bytes(gains), np.float64)


def lm_scores(
    docs: DataFrame,
    train: DataFrame,
    depth: int = DEPTH,
    top_grams: int = TOP_GRAMS,
    top_words: int = TOP_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are lower-cased (A-Z); tokens are their words and one end. ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens. ``score`` is the log10 probability under context-tree
    weighting of the bytes of the words, a space between two and an end byte; ``bits_per_byte`` is its code
    length. All bytes of ``train`` are counted and all nodes of their tree are used; a context that ``train``
    does not have counts as its longest part that it has. Null and empty texts are just an end. With
    no training rows each bit has probability 1/2. Each row stands for itself, repeated ids too; other columns
    are ignored.

    The counts of the ``top_words`` most frequent words and the gains of the ``top_grams`` most frequent grams are
    broadcast, those of the others are joined, so the joins have no hot keys.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tallied = stage(tallies(train, depth), "tallies")
    counts = tallied.where("gram is null").select("word", F.col("n").alias("c"))
    seen = tallied.where("gram is not null").select("gram", "n")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n_train, distinct = total["n"] + ends, total["v"] + (ends > 0)
    top = most_frequent(counts.withColumnRenamed("c", "n"), top_words).toArrow()
    levels = tree_levels(seen, depth)
    gains = stage(known_gains(seen, levels), "gains")
    frequent = most_frequent(seen, top_grams).select("gram")
    known = pa.chunked_array(top["word"].chunks, top["word"].type).cast(pa.large_binary()).combine_chunks()
    known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
    shared = spark.sparkContext.broadcast((*gathered(gains.join(stage(frequent, "frequent"), "gram")), known, top["n"].to_numpy()))
    least = -math.log10(n_train + distinct + 1)
    of_end = math.log10(ends + 1) + least

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        top_gram, top_gain, known, known_c = shared.value
        table = Lookup(top_gram, top_gain)
        gain = np.log10(known_c + 1.0)
        names = ["row", "id", "word", "gram", "times", "n_bytes", "n_tokens", "n_known", "base_score", "score"]
        for rows, raw, off in pieces(batches, "text"):
            words = Words(lowered(raw), off)
            data, doc_off = stream(words)
            total, rare_gram = np.zeros(len(doc_off) - 1), []
            for lo, of_byte in gram_slices(data, doc_off, depth):
                by_byte = table(of_byte)
                rare = np.flatnonzero(np.isnan(by_byte))
                by_byte[rare] = 0.0
                first, last = np.searchsorted(doc_off, [lo, lo + len(of_byte) - 1], "right") - 1
                total[first : last + 1] += np.add.reduceat(by_byte, np.maximum(doc_off[first : last + 1] - lo, 0))
                rare_gram.append((np.searchsorted(doc_off, rare + lo, "right") - 1, of_byte[rare]))
            distinct, which = distinct_words(words)
            slot = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy()
            of_word = np.where(slot >= 0, gain[slot] if len(gain) else 0.0, 0.0) + least
            tokens = words.per_doc + 1
            n = len(tokens)
            row = rows.column(0).to_numpy()
            # A key that no word has, as it holds a space, and that spreads these rows.
            own = pa.array([b" %d" % r for r in row.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), own, pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int64)), pa.array(np.diff(doc_off)), pa.array(tokens),
                 pa.array(sums((slot >= 0).astype(np.int64)[which], words.doc_off) + (ends > 0)), pa.array(sums(of_word[which], words.doc_off) + of_end), pa.array(total)],
                names=names,
            )

            def others(at: np.ndarray, word: pa.Array, gram: pa.Array, times: np.ndarray) -> pa.RecordBatch:
                zero, none = pa.array(np.zeros(len(at), np.int64)), pa.array(np.zeros(len(at)))
                return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.nulls(len(at), rows.column(1).type), word, gram, pa.array(times), zero, zero, zero, none, none], names=names)

            rare = np.flatnonzero(slot[which] < 0)
            if len(rare):
                key, times = np.unique(words.doc()[rare] * len(distinct) + which[rare], return_counts=True)
                yield others(key // len(distinct), distinct.take(pa.array(key % len(distinct))).cast(pa.binary()), pa.nulls(len(key), pa.int64()), times)
            doc, gram = (np.concatenate(x) for x in zip(*rare_gram))
            if len(gram):
                order = np.lexsort((gram, doc))
                doc, gram = doc[order], gram[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])
                yield others(doc[first], pa.nulls(len(first), pa.binary()), pa.array(gram[first]), np.diff(np.r_[first, len(doc)]))

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    scored = stage(base.mapInArrow(score, f"row bigint, id {kind}, word binary, gram bigint, times bigint, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double"), "scored")
    by_word = scored.where("gram is null").join(counts, "word", "left")
    rare = scored.where("gram is not null").drop("score")
    unseen = stage(rare.select("gram").distinct().join(gains, "gram", "left_anti"), "unseen")
    all_gains = gains if unseen.isEmpty() else gains.unionByName(stage(gram_scores(unseen, levels), "unseen_gains"))
    by_gram = rare.join(all_gains, "gram").withColumn("score", F.col("times") * F.col("gain")).withColumn("c", F.lit(None).cast("long"))
    joined = by_word.unionByName(by_gram.select(*by_word.columns))
    found = F.col("c").isNotNull()
    out = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(found, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.when(found, F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return out.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out_lm_scores(docs: DataFrame, parts: int = 7, part: int = 2, **options) -> DataFrame:
    """Scores for all rows by a model of the rows whose crc32(id) mod ``parts`` is not ``part``; adds ``held_out`` for the others."""
    id_col = options.get("id_col", "doc_id")
    out = lm_scores(docs, docs.where(held_back(F.col(id_col), parts) != part), **options)
    return out.withColumn("held_out", held_back(F.col(id_col), parts) == part)
