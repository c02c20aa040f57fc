"""Alignment of two tokenizers: groups of tokens that cover the same bytes, links of tokens that overlap, counts of linked ids.

Texts are cut into segments where both tokenizers surely begin a token: at a blank between visible characters. A text is its
segments, and a batch aligns each distinct segment once.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, small_batches, stage
from .textbytes import pieces

#: How SentencePiece writes a blank.
MARK = "▁"
#: A task forgets the tokens of segments when it holds so many.
CACHED_SEGMENTS = 1 << 17
#: Texts are aligned in pieces of about so many bytes; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Row groups of staged texts, which the tasks that write them hold.
BLOCK_BYTES = 16 << 20
#: So many segments are encoded as one text, and so many such texts at a time.
JOINED, SLICE = 256, 16
#: Each task has the counts of at most so many pairs, and passes on its own when there are more.
TOP_PAIRS = 1 << 20
EMPTY = np.zeros(0, np.int64)


class Files(NamedTuple):
    """The contents of both tokenizers' files: byte-level BPE in JSON, and a SentencePiece model."""

    a: str
    b: bytes


def read_files(a_path: str | None = None, b_path: str | None = None) -> Files:
    import public_tokenizers

    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return Files(a.read(), b.read())


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible characters of Latin-1 stand for themselves, the other bytes, in order, for those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers: the ids of segments, and the bytes of ids."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        byte = byte_of_character()
        names = {i: name for name, i in self.a.get_vocab().items()}
        self.a_bytes = pa.array([bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.decimals = pa.array([f"{i}{mark}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"], pa.large_binary())
        self.lengths = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.a_bytes, self.b_bytes)]
        #: Whether no piece has a blank after another character, so that none reaches over the beginning of a segment.
        self.cuts = not any(x != MARK and y == MARK for p in pieces for x, y in zip(p, p[1:]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values, self.off = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def ids(self, segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both tokenizers the ids of segments that begin with a blank (which SentencePiece puts in itself), end to end, and their offsets."""
        if len(self.known) > CACHED_SEGMENTS:
            self.forget()
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        plain, odd = [s for s in new if self.cuts and joins(s)], [s for s in new if not (self.cuts and joins(s))]
        self.known.update(zip(chain(plain, odd), range(len(self.known), len(self.known) + len(new))))
        encoders = (lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]), (lambda texts: self.b.encode([t[1:] for t in texts], out_type=int, num_threads=1))
        which = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        out = []
        for k, (encode, length) in enumerate(zip(encoders, self.lengths)):
            runs = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + [[s] for s in odd]
            values, counts = encoded(runs, encode, length)
            self.off[k] = np.r_[self.off[k], self.off[k][-1] + np.cumsum(counts)]
            self.values[k] = np.r_[self.values[k], values]
            out.append((self.values[k][spread(which, self.off[k])], np.r_[0, np.cumsum(np.diff(self.off[k])[which])]))
        return out


def joins(segment: bytes) -> bool:
    """Whether a segment may have others before and after it without a change of its tokens: visible after its blank and at its end."""
    if len(segment) < 2:
        return False
    first, last = segment[1], segment[-1]
    return (32 < first < 127 or 0xC3 <= first <= 0xDF) and (32 < last < 127 or (last >= 0x80 and 0xC3 <= segment[-2] <= 0xDF))


def encoded(runs: list[list[bytes]], encode: Callable[[list[str]], list[list[int]]], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all segments end to end, and how many each has. A run is encoded as one text, or segment by segment if its tokens don't end where its segments do."""
    values, counts = [np.zeros(0, np.int32)], [EMPTY]
    for k in range(0, len(runs), SLICE):
        part = runs[k : k + SLICE]
        for run, ids in zip(part, encode([b"".join(run).decode(errors="replace") for run in part])):
            ids = np.array(ids, np.int32)
            ends, bounds = np.cumsum(length[ids]), np.cumsum([len(s) for s in run])
            at = np.searchsorted(ends, bounds)
            if len(run) > 1 and not (len(ends) and ends[-1] == bounds[-1] and np.array_equal(ends[np.minimum(at, len(ends) - 1)], bounds)):
                alone = encode([s.decode(errors="replace") for s in run])
                values.append(np.fromiter(chain.from_iterable(alone), np.int32))
                counts.append(np.array([len(x) for x in alone], np.int64))
            else:
                values.append(ids)
                counts.append(np.diff(np.r_[-1, at]) if len(run) > 1 else np.array([len(ids)], np.int64))
    return np.concatenate(values), np.concatenate(counts)


def segments(raw: np.ndarray, off: np.ndarray, cuts: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct segments of a blank and each text that isn't empty, which of them each segment is, and the first segment of each text.

    A segment begins at a blank after another character than a blank (or SentencePiece's sign for it) and before a visible one.
    """
    some = off[1:] > off[:-1]
    raw = np.insert(raw, off[:-1][some], 32)
    off = off + np.r_[0, np.cumsum(some)]
    at = np.zeros(0, np.int64)
    if cuts and len(raw) > 2:
        after = raw[2:]
        visible = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF))
        at = np.flatnonzero((raw[1:-1] == 32) & (raw[:-2] != 32) & visible) + 1
        low = at[at >= 3]
        at = np.r_[at[at < 3], low[~((raw[low - 3] == 0xE2) & (raw[low - 2] == 0x96) & (raw[low - 1] == 0x81))]]
    starts = np.union1d(at, off[:-1][some])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(raw)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, off)


class Aligned(NamedTuple):
    """Of each segment: whether both tokenizers give its bytes, tokens, groups and links, the bounds of its links, and its groups."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_off: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    text: pa.Array


def joined(vocab: pa.Array, ids: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes of the ids of each segment, and where each token ends in all of them."""
    tokens = vocab.take(pa.array(ids))
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = tokens.buffers()[2] or pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[off])), data]), ends


def inside(off: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which elements of lists with these offsets are in lists to keep."""
    return np.repeat(keep, np.diff(off))


def align_segments(found: pa.Array, ids: list[tuple[np.ndarray, np.ndarray]], both: Tokenizers) -> Aligned:
    """Tokens of both are put in order of their first bytes; a group ends where a token begins at or after all ends before it.

    ``text`` has the groups of each segment as ``a1,a2|b1;``; links are all pairs of tokens that share a byte.
    """
    flat, off = zip(*ids)
    ok = np.logical_and.reduce([pc.equal(joined(vocab, flat[k], off[k])[0], found).to_numpy(zero_copy_only=False) for k, vocab in enumerate((both.a_bytes, both.b_bytes))]) & (np.diff(off[0]) > 0)
    n = [np.where(ok, np.diff(o), 0) for o in off]
    a, b = (flat[k][inside(off[k], ok)] for k in (0, 1))
    bounds_a, bounds_b = (np.r_[0, np.cumsum(x)] for x in n)
    ends_a, ends_b = joined(both.a_bytes, a, bounds_a)[1], joined(both.b_bytes, b, bounds_b)[1]
    start, end = np.r_[ends_a[:-1], ends_b[:-1]], np.r_[ends_a[1:], ends_b[1:]]
    side, segment = np.repeat([0, 1], [len(a), len(b)]), np.r_[np.repeat(np.arange(len(ok)), n[0]), np.repeat(np.arange(len(ok)), n[1])]
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order]) if len(order) else EMPTY
    new = np.r_[True, start[order][1:] >= reached[:-1]][: len(order)]
    group = np.cumsum(new)
    n_groups = np.bincount(segment[order][new], minlength=len(ok))
    # Links: the tokens of B that end after a token of A begins and begin before it ends.
    low, high = np.searchsorted(ends_b[1:], ends_a[:-1], "right"), np.searchsorted(ends_b[:-1], ends_a[1:], "left")
    per_a = high - low
    to = np.repeat(low - (np.cumsum(per_a) - per_a), per_a) + np.arange(per_a.sum())
    link_off = np.r_[0, np.cumsum(per_a)][bounds_a]
    # Text: inside a group those of A come first.
    written = np.lexsort((start[order], side[order], group))
    ids_in_order, side_in_order, group_in_order, segment_in_order = np.r_[a, b][order][written], side[order][written], group[written], segment[order][written]
    same = np.r_[group_in_order[1:] == group_in_order[:-1], False][: len(order)]
    separator = np.where(same, np.where(np.r_[side_in_order[1:] != side_in_order[:-1], False][: len(order)], 1, 0), 2)
    token_text, token_ends = joined(both.decimals, ids_in_order * 3 + separator, np.array([0, len(order)]))
    text_off = token_ends[np.searchsorted(segment_in_order, np.arange(len(ok) + 1))]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ok), [None, pa.py_buffer(np.ascontiguousarray(text_off)), token_text.buffers()[2] or pa.py_buffer(b"")])
    return Aligned(ok, *n, n_groups, np.diff(link_off), link_off, np.repeat(a, per_a).astype(np.int64), b[to], text)


def aligned_pieces(batches: Iterator[pa.RecordBatch], both: Tokenizers) -> Iterator[tuple[pa.RecordBatch, Aligned, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their distinct segments aligned, which segment comes where, the first one of each text, and which texts have tokens."""
    for rows, raw, off in pieces(batches, "text", PIECE_BYTES):
        found, which, doc_off = segments(raw, off, both.cuts)
        of = align_segments(found, both.ids(found.to_pylist()), both)
        bad = np.r_[0, np.cumsum(~of.ok[which])]
        yield rows, of, which, doc_off, (np.diff(doc_off) > 0) & (np.diff(bad[doc_off]) == 0)


def spread(which: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The elements of the lists ``which``, one after the other, as places in the lists' values."""
    count = np.diff(off)[which]
    return np.repeat(off[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def summed(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[off[1:]] - total[off[:-1]]


def aligned_texts(docs: DataFrame, a_path: str | None, b_path: str | None, key: str, id_col: str, text_col: str) -> DataFrame:
    """_key, id, n_a, n_b, n_groups, n_links, groups, links (each a number: A's id times the size of B's vocabulary, and B's id)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_files(a_path, b_path))
    names = ["_key", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(shared.value)
        for rows, of, which, doc_off, good in aligned_pieces(batches, both):
            per_text = [np.where(good, summed(x[which], doc_off), 0) for x in (of.n_a, of.n_b, of.n_groups, of.n_links)]
            which, doc_off = which[inside(doc_off, good)], np.r_[0, np.cumsum(np.where(good, np.diff(doc_off), 0))]
            links = (of.link_a * len(both.b_bytes) + of.link_b)[spread(which, of.link_off)]
            written = of.text.take(pa.array(which))
            ends = np.frombuffer(written.buffers()[1], np.int64)[: len(which) + 1] if len(which) else np.zeros(1, np.int64)
            text = memoryview(written.buffers()[2] or b"")
            bounds = ends[doc_off].tolist()
            groups = [bytes(text[a : max(a, b - 1)]) for a, b in zip(bounds, bounds[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text[3])].astype(np.int32)), pa.array(links))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[pa.array(x.astype(np.int64)) for x in per_text], pa.array(groups, pa.string()), lists], names=names)
            del rows, of, which, links, written, text, groups, lists
            pa.default_memory_pool().release_unused()

    base = docs.select(F.col(key).alias("_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [base.schema[c].dataType.simpleString() for c in ("_key", "id")]
    return base.mapInArrow(run, f"_key {kinds[0]}, `{id_col}` {kinds[1]}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<bigint>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n: how many links of all texts are the same pair of ids. Tasks add up their own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts = EMPTY, EMPTY
        for batch in batches:
            own, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            links, place = np.unique(np.r_[links, own], return_inverse=True)
            counts = np.bincount(place, np.r_[counts, times], minlength=len(links)).astype(np.int64)
            if len(links) > TOP_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(counts)], names=["link", "n"])
                links, counts = EMPTY, EMPTY
        yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(counts)], names=["link", "n"])

    return aligned.select("links").mapInArrow(run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, top_pairs: int = TOP_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Tokenizer A is byte-level BPE (a JSON file) on a blank and the text, B a SentencePiece model with byte fallback on the text, which
    puts the blank in. Strings of special tokens are plain text. ``groups`` has the ids of both in the groups that are cut where
    both end, as ``a1,a2|b1;a3|b2,b3``. Links are all pairs of overlapping tokens; ``count_sum`` adds up how many links of all documents
    hold the ids of each, ``n_best`` counts those that no id of A is linked more often with the same id of B. Texts that are
    null, empty, or whose bytes a tokenizer does not give back have no tokens, zeros and an empty ``groups``, and no part in the
    counts. Each row stands for itself, repeated and null ids too; other columns are ignored.

    Texts are encoded and aligned once, and staged as groups and links; no text is shuffled. The counts of the most frequent pairs,
    ``top_pairs`` at most, and the highest of each id of B are with every task; the links of rarer pairs meet their counts in a join.
    """
    docs, key = row_keys(docs, id_col)
    spark = docs.sparkSession
    aligned = stage(aligned_texts(docs, a_path, b_path, key, id_col, text_col), "aligned", BLOCK_BYTES)
    size = len(Tokenizers(read_files(a_path, b_path)).b_bytes)
    counts = stage(link_counts(aligned).withColumn("b_id", (F.col("link") % size).cast("int")), "pairs")
    # As many rows as there are powers of two; then the pairs from such a power on, as many as are allowed; then one row per id of B.
    powers = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()
    least, held = (1 << 62), 0
    for power, pairs in sorted(((r["power"], r["pairs"]) for r in powers), reverse=True):
        if held + pairs > top_pairs:
            break
        least, held = 1 << power, held + pairs
    highest = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    top, best = counts.where(F.col("n") >= least).select("link", "n").toArrow(), highest.toArrow()
    by_link = np.argsort(top["link"].to_numpy())
    most = np.zeros(size, np.int64)
    most[best["b_id"].to_numpy()] = best["most"].to_numpy()
    shared = spark.sparkContext.broadcast((np.r_[top["link"].to_numpy()[by_link], -1], np.r_[top["n"].to_numpy()[by_link], 0], most))

    def counted(links: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The links of all rows, their counts (0 for those that are joined), which are their B id's best, and the offsets of rows."""
        known, n, most = shared.value
        flat = links.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(known[:-1], flat)
        count = np.where(known[at] == flat, n[at], 0)
        return flat, count, (count > 0) & (count == most[flat % size]), np.r_[0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)

    kept = aligned.columns[:7]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, count, is_best, off = counted(batch.column(7))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(summed(is_best, off)), pa.array(summed(count, off))], names=[*kept, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, count, _, off = counted(batch.column(1))
            left = np.flatnonzero(count == 0)
            row = np.searchsorted(off, left, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(flat[left])], names=["_key", "link"])

    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    rarer = stage(counts.where(F.col("n") < least).join(stage(highest, "best"), "b_id").select("link", "n", "most"), "rarer")
    links = aligned.select("_key", "links").mapInArrow(rare, f"_key {aligned.schema['_key'].dataType.simpleString()}, link bigint").groupBy("_key", "link").agg(F.count("*").alias("times"))
    each = links.join(rarer, "link").groupBy("_key").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = aligned.mapInArrow(scored, f"{kinds}, n_best bigint, count_sum bigint").join(stage(each, "rare"), "_key", "left")
    more = [(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return both.select(id_col, "n_a", "n_b", "n_groups", "n_links", *more, "groups")
