"""Byte-level BPE against the tokenizer library, and back to the bytes."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from leadtime.llm import byte_pairs
from leadtime.llm import queries as q
from leadtime.llm.byte_pairs import Merger, decode, encode, read_ranks, safe_ranges, token_arrays
from leadtime.llm.pretokens import class_table

SCHEMA = "doc_id bigint, text string, ids string, ends int, bytes int, id string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)


def encoded(texts):
    ids, per_text = token_arrays(*batch(texts), Merger(read_ranks()), class_table())
    bounds = np.r_[0, np.cumsum(per_text)]
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_all_boundaries(library):
    rng = random.Random(1)
    alphabet = "ab'stremvld 12 \n\t é中 　.,!SR\U0001f600٣\x85\x1c"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(5000)]
    texts += ["", "'s", "''s", " 's", "'re've'll'd", "  ", "a  ", "a \n b", "x'sabc'", "'", "'r", "'l"]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_each_code_point(library):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}." for c in (*range(0, 0xD800, 7), *range(0xE000, 0x30000, 11))]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("length", [1, 2, 7, 199, 200, 201, 900])
@pytest.mark.parametrize("alphabet", ["a", "ab", "thein", "aé中"])
def test_long_words(library, length, alphabet):
    word = "".join(random.Random(length).choices(alphabet, k=length))
    merger = Merger(read_ranks())
    assert merger.merged(word.encode()) == library.encode_ordinary(word)
    if length > 1:
        bounds = merger.by_heap(word.encode())
        assert [word.encode()[a:b] for a, b in zip(bounds, bounds[1:])] == [library.decode_single_token_bytes(i) for i in library.encode_ordinary(word)]


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHED_WORDS", 3)
    merger = Merger(read_ranks())
    for _ in range(3):
        assert merger.ids([b" one", b" twofold", b"threes", b" foursome"]) == [library.encode_ordinary(w) for w in (" one", " twofold", "threes", " foursome")]
    assert len(merger.known) <= 4


def test_ranges_of_a_long_text(library):
    rng = random.Random(3)
    text = "".join(rng.choices(["ab", " ", "\n", "é", "'s", "12", "  "], k=4000))
    raw = batch([text])[0]
    ranges = safe_ranges(raw, 100)
    assert len(ranges) > 10 and ranges[0][0] == 0 and ranges[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum((library.encode_ordinary(bytes(raw[a:b]).decode()) for a, b in ranges), []) == library.encode_ordinary(text)


def rows(texts):
    return [(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)]


def check(spark, library, texts):
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = encode(docs)
    assert found.columns == ["doc_id", "ids", "ends"]
    back = {r["doc_id"]: bytes(r["bytes"]) for r in decode(found).collect()}
    for r in found.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert r["ends"] == np.cumsum([len(library.decode_single_token_bytes(i)) for i in r["ids"]]).tolist()
        assert back[r["doc_id"]] == text.encode()


TEXTS = [None, "", "   ", "it's  fine\n\n", "<|endoftext|> is text", "é" * 900, "naïve 中文 text 123 're"]


def test_whole_texts(spark, library):
    check(spark, library, [*TEXTS, "lorem ipsum dolor's " * 3000])


def test_text_longer_than_two_pieces(spark, library):
    check(spark, library, ["wörd and 1234 's\n" * 520_000, "short", None])


def test_empty_table_and_repeated_ids(spark, library):
    assert encode(spark.createDataFrame([], SCHEMA)).collect() == []
    assert decode(encode(spark.createDataFrame([], SCHEMA))).collect() == []
    twice = spark.createDataFrame([(None, "a b", "", 0, 0, ""), (1, "a b", "", 0, 0, ""), (1, "a b", "", 0, 0, "")], SCHEMA)
    assert sorted(((r["doc_id"] or 0, r["ids"]) for r in encode(twice).collect())) == [(0, library.encode_ordinary("a b")), *[(1, library.encode_ordinary("a b"))] * 2]


def test_other_vocabulary_is_an_error(spark):
    other = encode(spark.createDataFrame(rows(["naïve 中文"]), SCHEMA), P.path("byte_bpe_50k.tiktoken"))
    with pytest.raises(Exception, match="ends are not those"):
        decode(other).collect()


def test_query(spark, library, tmp_path):
    spark.createDataFrame(rows(TEXTS), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in q.op11_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == want
