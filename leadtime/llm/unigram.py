"""Token counts and language ID with unigram piece models over a fixed public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_back, small_batches
from .textbytes import Words, pieces
from .trie import Pieces, Trie

#: How the vocabulary marks the beginning of a word.
WORD_MARK = "▁".encode()
#: Integer scores have so many steps per unit of natural logarithm, so sums and ties are exact.
STEPS = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> Pieces:
    """The pieces of a SentencePiece model in the order of their ids, without control and byte entries, then missing bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    ids = range(model.get_piece_size())
    return Pieces([model.id_to_piece(i).encode() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def rank_scores(vocab: Pieces) -> np.ndarray:
    """Integer log-probabilities that fall with the rank of a piece (Zipf's law); bytes come after all pieces."""
    rank = np.arange(1, len(vocab) + 1, dtype=np.float64)
    p = 1 / rank
    return np.round(np.log(p / p.sum()) * STEPS).astype(np.int64)


def distinct_words(words: Words) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and, for each word, which of them it is."""
    coded = words.arrow().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sums(values: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    """The sum of the values (one for each word) of each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[doc_off[1:]] - total[doc_off[:-1]]


def token_counts(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens, n_bytes.

    A pre-token is a word (a run of other than white space) after the word mark; its tokens are the pieces of
    its best segmentation under a unigram model over the vocabulary, with scores by rank; bytes outside the
    vocabulary are tokens of one byte. The distinct pre-tokens of each batch are put in a trie, prefixes are
    scored once, and each terminal holds its count. Null and empty texts have no tokens. Each row stands for
    itself, repeated ids too; other columns are ignored. There is no shuffle.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, rank_scores(vocab)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, scores = shared.value
        for rows, raw, off in pieces(batches, "text"):
            words = Words(raw, off)
            distinct, which = distinct_words(words)
            tokens = Trie(distinct, WORD_MARK).best(vocab, scores).tokens()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words.per_doc.astype(np.int64)), pa.array(sums(tokens[which], words.doc_off)), pa.array(np.diff(off))],
                names=[id_col, "n_words", "n_tokens", "n_bytes"],
            )

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(count, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, n_bytes bigint")


def piece_model(
    labelled: DataFrame, vocab: Pieces, max_docs_per_language: int, smoothing: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """The languages (by code point) and, for each piece, a row of its log-probability in each language.

    At most about ``max_docs_per_language`` documents of a language count, chosen by the md5 of their ids where
    they are read, so no text is moved. Piece counts come from the best segmentation by rank scores, plus
    ``smoothing`` for each piece.
    """
    spark = labelled.sparkSession
    named = labelled.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    # One row for each language, as many as the model has columns.
    per_language = {r["lang"]: r["rows"] for r in named.where("lang is not null").groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    langs = sorted(per_language)
    if not langs:
        return [], np.zeros((len(vocab), 0))
    share = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    bound = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, max_docs_per_language / per_language[lang])]), F.col("lang"))
    sample = named.where("lang is not null").where(share < bound)
    shared = spark.sparkContext.broadcast((vocab, rank_scores(vocab)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, scores = shared.value
        for rows, raw, off in pieces(batches, "text"):
            words = Words(raw, off)
            distinct, which = distinct_words(words)
            best = Trie(distinct, WORD_MARK).best(vocab, scores)
            langs = rows.column(0).dictionary_encode()
            lang_of = langs.indices.to_numpy(zero_copy_only=False)[words.doc()] if len(words) else np.zeros(0, np.int64)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                counts = best.piece_counts(np.bincount(which[lang_of == k], minlength=len(distinct)).astype(np.float64), len(vocab))
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "piece", "n"])

    rows = sample.select("lang", "text")
    # One row for each language and piece of the fixed vocabulary.
    counted = rows.mapInArrow(count, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    table = np.full((len(vocab), len(langs)), smoothing)
    if len(counted):
        column = {x: i for i, x in enumerate(langs)}
        table[counted["piece"].to_numpy(), [column[x] for x in counted["lang"].to_pylist()]] += counted["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True))


def language_id(
    docs: DataFrame,
    train: DataFrame,
    vocabulary_path: str | None = None,
    max_docs_per_language: int = 2000,
    smoothing: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document of ``docs``: id, lang_pred, score.

    ``train`` has labelled texts; a bounded sample of it gives each language's piece probabilities. A text's
    probability in a language is the product over its words of the sum over all segmentations into pieces,
    by the forward algorithm, run once for each prefix of the distinct words of a batch. ``lang_pred`` is the
    language of the highest posterior under equal priors (of equal ones the first by code point), ``score``
    this posterior. Texts that are null or have no letter get "und" and 0, as does every text if no training
    row has a language. Each row stands for itself; other columns are ignored. There is no shuffle but that of
    the piece counts.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary(vocabulary_path)
    langs, log_p = piece_model(train, vocab, max_docs_per_language, smoothing, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, langs, log_p))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, langs, log_p = shared.value
        for rows, raw, off in pieces(batches, "text"):
            lettered = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if langs:
                words = Words(raw, off)
                distinct, which = distinct_words(words)
                total = sums(Trie(distinct, WORD_MARK).forward(vocab, log_p)[which], words.doc_off)
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                lettered = np.zeros(len(lettered), bool)
                best, score = np.zeros(len(lettered), np.int64), np.zeros(len(lettered))
            names = np.array([*langs, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(names[np.where(lettered, best, len(langs))], pa.string()), pa.array(np.where(lettered, score, 0.0))],
                names=[id_col, "lang_pred", "score"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out_language_id(docs: DataFrame, parts: int = 5, **options) -> DataFrame:
    """Language ID that learns from the rows whose crc32(id) mod ``parts`` is not 0; adds ``held_out`` for the others."""
    id_col = options.get("id_col", "doc_id")
    out = language_id(docs, docs.where(held_back(F.col(id_col), parts) != 0), **options)
    return out.withColumn("held_out", held_back(F.col(id_col), parts) == 0)
