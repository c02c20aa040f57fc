"""Substring dedup: maximal repeats from suffix trees of parts of the corpus, dealt by variable-length prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_in, small_batches, stage
from .textbytes import Words, flat, mix, pieces, shingles

#: Words in an anchor: each window has one, the one of its word triples that comes first in a fixed order.
ANCHOR_WORDS = 3
#: Suffixes that a part may have before they are dealt by all words of their windows.
GROUP_ROWS = 200_000
#: The filter of anchors that repeat has 2**FILTER_BITS bits (32 MB), that of anchors with too many suffixes 2**HOT_BITS.
FILTER_BITS, HOT_BITS = 28, 20
#: Whole parts of about so many bytes of words are put in one tree.
TREE_BYTES = 4 << 20
#: A null id counts as greater than all others.
LAST = (1 << 63) - 1


class Windows:
    """The windows of ``size`` consecutive words of the texts of a piece."""

    def __init__(self, words: Words, size: int):
        self.words, self.size = words, size
        self.hashes = words.hashes()
        n = max(0, len(words) - size + 1)
        left = np.repeat(words.doc_off[1:], words.per_doc) - np.arange(len(words))
        self.starts = np.flatnonzero(left[:n] >= size)  # those that end in their text

    def anchors(self) -> np.ndarray:
        """The anchor of each window: the triple with the most bytes, then the least hash. Not negative.

        Windows of the same words have the same anchor, and windows that overlap mostly share theirs. Long
        triples are rarely repeated by chance.
        """
        h = shingles(self.hashes, ANCHOR_WORDS) >> np.uint64(8)
        span = self.words.off[ANCHOR_WORDS:] - self.words.off[: -ANCHOR_WORDS] if len(self.words) >= ANCHOR_WORDS else np.zeros(0, np.int64)
        order = h | ((127 - np.minimum(span, 127)).astype(np.uint64) << np.uint64(56))
        n = max(0, len(self.words) - self.size + 1)
        best = order[:n].copy()
        for j in range(1, self.size - ANCHOR_WORDS + 1):
            np.minimum(best, order[j : j + n], out=best)
        return best[self.starts].astype(np.int64)

    def doc(self) -> np.ndarray:
        return self.words.doc()[self.starts]


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & (8 * len(bits) - 1)
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """key, id: each anchor of each document, once for each run of windows that have it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches, "text"):
            windows = Windows(Words(raw, off), size)
            if len(windows.starts):
                anchor, doc = windows.anchors(), windows.doc()
                first = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(rows.column(0).to_numpy()[doc[first]])], names=["key", "id"])

    return docs.mapInArrow(find, "key bigint, id bigint")


def word_slices(words: Words, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words from each of ``first`` to before each of ``last``, joined by spaces."""
    lengths = words.lengths
    out = np.full(len(words.data) + len(words), 32, np.uint8)
    out[np.arange(len(words.data)) + np.repeat(np.arange(len(words)), lengths)] = words.data
    begin, end = words.off[first] + first, words.off[last] + last - 1
    sizes = end - begin
    off = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    take = np.arange(off[-1]) + np.repeat(begin - off[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(out[take])])


def segment_rows(docs: DataFrame, size: int, repeated: bytes, hot: bytes) -> DataFrame:
    """part, words, id, tag, start, length: the windows that may repeat, as segments, runs of consecutive ones that go to one part.

    A window goes to the part of its anchor, so a segment is the words of a run of windows with one anchor (if the
    anchor is hot, of one window, to the part of all its words). Of equal segments in a batch only those of the
    smallest id go on; in those of other documents all windows are repeats for sure, and are given as ready runs with
    ``length`` > 0, alone in their part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.frombuffer(repeated, np.uint8), np.frombuffer(hot, np.uint8)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = shared.value
        for rows, raw, off in pieces(batches, "text"):
            windows = Windows(Words(raw, off), size)
            if not len(windows.starts):
                continue
            words, anchor = windows.words, windows.anchors()
            maybe = np.flatnonzero(has_bit(bits, anchor))
            if not len(maybe):
                continue
            at, anchor = windows.starts[maybe], anchor[maybe]
            single = has_bit(hot_bits, anchor)
            part = np.where(single, shingles(windows.hashes, size)[at].astype(np.int64), mix(anchor.astype(np.uint64)).astype(np.int64))
            doc = words.doc()[at]
            head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | single[1:] | single[:-1]])
            runs = np.diff(np.r_[head, len(at)])
            first, doc = at[head], doc[head]
            text = word_slices(words, first, first + runs + size - 1)
            ids, tags = rows.column(0).to_numpy()[doc], rows.column(2).to_numpy()[doc]
            start = first - words.doc_off[doc]
            same = text.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            least = np.full(int(same.max()) + 1, LAST)
            np.minimum.at(least, same, ids)
            later = ids > least[same]
            done, open_ = np.flatnonzero(later), np.flatnonzero(~later)
            for kept, alone in ((open_, False), (done, True)):
                some = pa.array([b""] * len(kept), pa.binary()) if alone else text.take(pa.array(kept)).cast(pa.binary())
                to = mix(ids[kept].astype(np.uint64)).astype(np.int64) if alone else part[head][kept]
                length = runs[kept] if alone else np.zeros(len(kept), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(to), some, *map(pa.array, (ids[kept], tags[kept], start[kept], length))], names=["part", "words", "id", "tag", "start", "length"])

    return docs.mapInArrow(find, "part bigint, words binary, id bigint, tag int, start bigint, length bigint")


@dataclass
class DeepNodes:
    """The topmost nodes of a suffix tree at ``size`` words or more below its root, and the suffixes (by their first words) below each.

    ``suffix`` holds all suffixes of ``size`` words or more in the order of their words, ``first`` where each node's begin, ``depth``
    the number of words that all suffixes of a node share (of a leaf, its own).
    """

    suffix: np.ndarray
    first: np.ndarray
    depth: np.ndarray


def deep_nodes(codes: np.ndarray, off: np.ndarray, size: int) -> DeepNodes:
    """The suffix tree of texts of coded words, cut at ``size`` words.

    Suffixes are sorted by doubling: the rank of 2k words from a place follows from the ranks of k words there and k words
    on. The same ranks give the common prefix of two neighbours, by halves. Neighbours that share ``size`` words or more
    are below one node.
    """
    n = len(codes)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    longest = int(left.max(initial=0))

    def on(rank: np.ndarray, k: int) -> np.ndarray:
        """The rank k words on, 0 past the end of the text."""
        out = np.zeros(n, np.int64)
        if k < n:
            out[: n - k] = rank[k:]
        out[left <= k] = 0
        return out

    ranks = [codes.astype(np.int64) + 1]
    width = 1
    while width < longest:
        pair = ranks[-1] * (int(ranks[-1].max(initial=0)) + 1) + on(ranks[-1], width)
        ranks.append(np.unique(pair, return_inverse=True)[1].ravel() + 1)
        width *= 2
    suffix = np.flatnonzero(left >= size)
    suffix = suffix[np.argsort(ranks[-1][suffix], kind="stable")]
    a, b = suffix[:-1], suffix[1:]
    common = np.zeros(len(a), np.int64)
    for rank in reversed(ranks):
        width = 1 << next(k for k, r in enumerate(ranks) if r is rank)
        inside = (common < left[a]) & (common < left[b])
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where(inside & (rank[x] == rank[y]), width, 0)
    common = np.minimum(common, np.minimum(left[a], left[b]))
    first = np.flatnonzero(np.r_[True, common < size]) if len(suffix) else np.zeros(0, np.int64)
    shared = np.r_[common, 0] if len(suffix) else np.zeros(0, np.int64)
    shared[np.r_[first[1:] - 1, len(suffix) - 1] if len(suffix) else []] = np.iinfo(np.int64).max
    depth = np.minimum.reduceat(shared, first) if len(first) else shared
    return DeepNodes(suffix, first, np.minimum(depth, left[suffix[first]]) if len(first) else depth)


def repeats(text: pa.Array, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of segments that also are in a segment of a smaller id: segment, first window, number of windows; and which segments have others."""
    coded = text.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(len(coded.dictionary), LAST)
    np.minimum.at(least, which, ids)
    words = Words(*flat(coded.dictionary.cast(pa.large_string())))
    codes = words.arrow().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    tree = deep_nodes(codes, words.doc_off, size)
    owner = words.doc()[tree.suffix]
    of_node = np.minimum.reduceat(least[owner], tree.first) if len(tree.first) else least[:0]
    of_suffix = np.full(len(words), LAST)
    of_suffix[tree.suffix] = np.repeat(of_node, np.diff(np.r_[tree.first, len(tree.suffix)]))
    # Each segment has the windows of its distinct text.
    n_windows = words.per_doc - size + 1
    segment = np.repeat(np.arange(len(which)), n_windows[which])
    window = np.arange(len(segment)) - np.repeat(np.r_[0, np.cumsum(n_windows[which])[:-1]], n_windows[which])
    gone = of_suffix[words.doc_off[which[segment]] + window] < ids[segment]
    others = np.bincount(segment[~gone], minlength=len(which)) > 0
    segment, window = segment[gone], window[gone]
    head = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)]) if len(segment) else np.zeros(0, np.int64)
    return segment[head], window[head], np.diff(np.r_[head, len(segment)]), others


def repeated_spans(docs: DataFrame, min_words: int, group_rows: int) -> DataFrame:
    """id, tag, spans: array of (start, length), runs of windows whose words also start in a document of smaller id."""
    anchors = anchor_rows(docs, min_words).groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    found = stage(anchors.where("least < most").select("key", "n"), "anchors")
    hot = bitmap("key", found.where(F.col("n") > group_rows), HOT_BITS)
    segments = segment_rows(docs, min_words, bitmap("key", found, FILTER_BITS), hot)

    def in_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["id", "tag", "start", "length"]

        def tree(rows: pa.RecordBatch) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
            """The runs found in some rows, and the rows of which not all windows are in them."""
            ready = rows.column(5).to_numpy() > 0
            given = rows.filter(pa.array(ready))
            out = [pa.RecordBatch.from_arrays([given.column(k) for k in (2, 3, 4, 5)], names=names)] if len(given) else []
            rows = rows.filter(pa.array(~ready))
            if not len(rows):
                return out, rows
            segment, window, length, others = repeats(rows.column(1).cast(pa.large_binary()), rows.column(2).to_numpy(), min_words)
            start = rows.column(4).to_numpy()[segment] + window
            out.append(pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(segment)), rows.column(3).take(pa.array(segment)), pa.array(start), pa.array(length)], names=names))
            return out, rows.filter(pa.array(others))

        def joined_rows() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0).to_numpy()
            if size > TREE_BYTES:
                # Whole parts are done; of the last one, which may go on, a row for each text that is left is held.
                rows = joined_rows()
                last = rows.column(0).to_numpy() == rows.column(0)[len(rows) - 1].as_py()
                out, _ = tree(rows.filter(pa.array(~last)))
                yield from out
                rest = rows.filter(pa.array(last))
                if rest.nbytes > TREE_BYTES or part[0] != rest.column(0)[0].as_py():
                    out, rest = tree(rest)
                    yield from out
                    rest = rest if len(rest) and part[0] == rest.column(0)[0].as_py() else rest.slice(0, 0)
                held, size = ([rest] if len(rest) else []), rest.nbytes
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from tree(joined_rows())[0]

    found_runs = segments.repartition("part").sortWithinPartitions("part").mapInArrow(in_trees, "id bigint, tag int, start bigint, length bigint")
    return found_runs.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def substring_dedup(docs: DataFrame, min_words: int = 13, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text (kept words joined by one space), n_words, n_removed.

    Words are runs of other than white space, unchanged. A word goes if it is covered by a window of
    ``min_words`` words that also starts in a document with a smaller id, judged on the input. Ids are integers;
    a null id counts as greater than all others, and rows that repeat an id count as one document, so they
    don't remove each other's words. Null and empty texts have no words. Other columns are ignored.

    The suffix tree of the corpus is built in parts, and cut at ``min_words`` words: what is below its nodes of that
    depth are repeats, and consecutive ones make up the maximal repeats. Suffixes whose first words are equal must be in one
    part. They are dealt by a part of these words, the anchor (the least of their triples in a fixed order), where few suffixes have it,
    and by all of these words where more than ``group_rows`` do. Suffixes that follow each other mostly have one anchor, so
    they go as one row that holds their words. In a part all suffixes are sorted by their words, common prefixes of
    neighbours give the deep nodes, and the smallest id below a node decides. Two filters keep the parts small and lose
    nothing: if an anchor is in one document only, so are its windows; and of equal rows in a batch one document's go on.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("tag", F.hash("text"))  # tells texts of the same id apart
    spans = repeated_spans(base, min_words, group_rows)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches, "text"):
            words = Words(raw, off)
            lists = rows.column(2)
            per_row = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
            inside = lists.flatten()
            start = inside.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.doc_off[:-1], per_row)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + inside.field(1).to_numpy(zero_copy_only=False) + min_words - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            text, text_off = joined(words, keep)
            kept = np.r_[0, np.cumsum(keep)]
            n_kept = kept[words.doc_off[1:]] - kept[words.doc_off[:-1]]
            out = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(text_off), pa.py_buffer(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), out, pa.array(words.per_doc.astype(np.int64)), pa.array((words.per_doc - n_kept).astype(np.int64))], names=["id", "text", "n_words", "n_removed"])

    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = stage(spans, "spans")
    known = maybe_in(base, F.xxhash64("id"), stage(spans.select(F.xxhash64("id").alias("key")).distinct(), "span_ids"), "maybe")
    joined_rows = known.where("maybe").join(spans, ["id", "tag"], "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    both = joined_rows.unionByName(known.where(~F.col("maybe")).select("id", "text", none.alias("spans")))
    out = both.mapInArrow(remove, "id bigint, text string, n_words bigint, n_removed bigint")
    return out.select(F.nullif("id", F.lit(LAST)).alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed")


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text's kept words joined by spaces, and the offsets of the texts."""
    lengths = words.lengths[keep]
    doc = words.doc()[keep]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    sizes = lengths + ~last  # a space after each word but a text's last
    off = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    out = np.full(off[-1], 32, np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else off[:0], lengths) + np.repeat(off[:-1], lengths)
    out[place] = words.data[np.repeat(keep, words.lengths)]
    ends = np.searchsorted(doc, np.arange(len(words.per_doc)), "right")
    return out, np.r_[0, off[ends]].astype(np.int64)
