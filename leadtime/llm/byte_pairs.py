"""Byte-level BPE: texts to token ids with their places, and back."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import small_batches
from .pretokens import class_table, pretoken_starts
from .textbytes import pieces

#: Words up to so many bytes are merged by a plain search for the next pair, longer ones by a heap.
PLAIN_BYTES = 200
#: A task forgets the words it has merged when it holds so many.
CACHED_WORDS = 1 << 19
NONE = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids: a line has the bytes in base64 and the rank."""
    with open(path or default_ranks(), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """The ids of words: of all neighbours that make up a token, those of the least rank (of equal ones the first) merge, until none do."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, list[int]] = {}

    def ids(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for word in words:
            found = self.known.get(word)
            if found is None:
                found = self.known[word] = self.merged(word)
            out.append(found)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return out

    def merged(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        bounds = self.plain(word) if len(word) <= PLAIN_BYTES else self.by_heap(word)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def plain(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == NONE:
                break
            i = pairs.index(least)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(word[bounds[i] : bounds[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], NONE)
        return bounds

    def by_heap(self, word: bytes) -> list[int]:
        """In time n log n for words of any length, such as a text without blanks."""
        rank, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # the token that begins at i ends at after[i]
        pairs = [rank(word[i : i + 2], NONE) for i in range(n - 1)] + [NONE]
        heap = [(r, i) for i, r in enumerate(pairs) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if pairs[i] != r:
                continue  # merged or changed since
            gone = after[i]
            after[i] = after[gone]
            pairs[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    end = after[after[k]] if after[k] < n else n + 1
                    pairs[k] = rank(word[k:end], NONE) if end <= n else NONE
                    if pairs[k] != NONE:
                        heapq.heappush(heap, (pairs[k], k))
        bounds, i = [0], 0
        while i < n:
            i = after[i]
            bounds.append(i)
        return bounds


def safe_ranges(raw: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of a long text of about ``most`` bytes: a pre-token begins at ASCII white space after another ASCII character, whatever comes before."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(white[1:] & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
    bounds = [0]
    while (k := int(np.searchsorted(at, bounds[-1] + most))) < len(at):
        bounds.append(int(at[k]))
    return list(zip(bounds, [*bounds[1:], len(raw)]))


def token_arrays(raw: np.ndarray, off: np.ndarray, merger: Merger, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all tokens of the texts, and how many each text has."""
    starts = pretoken_starts(raw, off, table)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = slices.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = merger.ids(coded.dictionary.to_pylist())
    size = np.array([len(x) for x in found], np.int64)
    values = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
    count = size[which]
    end = np.cumsum(count)
    place = np.repeat((np.cumsum(size) - size)[which] - (end - count), count) + np.arange(end[-1])
    upto = np.r_[0, end][np.searchsorted(starts, off)]
    return values[place], np.diff(upto)


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array of int), ends (array of int: the byte of the text at which each token ends).

    Texts are cut into pre-tokens by a scan over the classes of their characters (see :mod:`.pretokens`), each distinct pre-token
    of a batch is merged once by the ranks of the file, and a task keeps what it has merged. There are no special tokens: their
    strings are plain text. Null and empty texts have no tokens. Each row stands for itself, repeated and null ids too; other
    columns are ignored. Texts of any length are gone through in ranges of some MB; a single run of letters takes time n log n.
    There is no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), class_table()))  # a vocabulary and a byte per code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = shared.value
        merger = Merger(ranks)
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        length[list(ranks.values())] = [len(t) for t in ranks]
        for rows, raw, off in pieces(batches, "text"):
            if len(raw) > 2 * textbytes.PIECE_BYTES:  # one long text
                parts = [token_arrays(raw[a:b], np.array([0, b - a]), merger, table)[0] for a, b in safe_ranges(raw, textbytes.PIECE_BYTES)]
                ids = np.concatenate(parts)
                per_text = np.diff(np.searchsorted(np.cumsum(length[ids]), off, "right"))
            else:
                ids, per_text = token_arrays(raw, off, merger, table)
            bounds = np.r_[0, np.cumsum(per_text)]
            ends = np.cumsum(length[ids]) - np.repeat(off[:-1], per_text)
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=[id_col, "ids", "ends"])

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(run, f"`{id_col}` {base.schema['id'].dataType.simpleString()}, ids array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``bytes``: the bytes of the tokens of each row of ``ids`` and ``ends``.

    Null counts as no tokens. Ids that aren't in the vocabulary, or whose lengths differ from ``ends``, are an error: they are of another vocabulary.
    """
    small_batches(encoded.sparkSession)
    ranks = read_ranks(ranks_path)
    by_id = {i: t for t, i in ranks.items()}
    shared = encoded.sparkSession.sparkContext.broadcast([by_id.get(i) for i in range(max(by_id) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            ids, ends = (batch.column(batch.schema.names.index(c)) for c in ("ids", "ends"))
            flat, offsets = ids.flatten(), np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            tokens = vocab.take(flat)
            if tokens.null_count:
                raise ValueError("ids that aren't in the vocabulary")
            end = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
            bounds = end[offsets]
            if not np.array_equal(end[1:] - np.repeat(bounds[:-1], np.diff(offsets)), ends.flatten().to_numpy(zero_copy_only=False)):
                raise ValueError("ends are not those of these ids")
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(np.ascontiguousarray(bounds)), tokens.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], out.cast(pa.binary())], names=[*keep, "bytes"])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids", "ends").mapInArrow(run, f"{kinds}, bytes binary")
