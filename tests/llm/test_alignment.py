"""Alignment of two tokenizers against plain loops over the tokens of whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leadtime.llm import queries as q
from leadtime.llm.alignment import Tokenizers, align, aligned_texts, link_counts, read_files

SCHEMA = "doc_id bigint, text string, groups string, a_id int, n bigint"
CHARS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
CHARS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in CHARS)}


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(library, text):
    """(id, first byte, end) of each token of both, or nothing."""
    if not text:
        return [], []
    a, b = library
    of_a = a.encode(" " + text, add_special_tokens=False)
    parts = [[(i, bytes(CHARS[c] for c in t)) for i, t in zip(of_a.ids, of_a.tokens)]]
    names = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    parts.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names])
    if any(b"".join(x for _, x in part) != (" " + text).encode() for part in parts):
        return [], []
    out = []
    for part in parts:
        end, found = 0, []
        for i, x in part:
            found.append((i, end, end + len(x)))
            end += len(x)
        out.append(found)
    return out


def plain(library, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text."""
    split, links, count = [], [], Counter()
    for text in texts:
        a, b = tokens(library, text)
        split.append((a, b))
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        count.update(links[-1])
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    out = []
    for (a, b), own in zip(split, links):
        both = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for low, high in zip([0, *both], both):
            groups.append("|".join(",".join(str(x[0]) for x in part if low <= x[1] < high) for part in (a, b)))
        out.append((len(a), len(b), len(groups), len(own), sum(count[x] == highest[x[1]] for x in own), sum(count[x] for x in own), ";".join(groups)))
    return out, count


def corpus():
    rng = random.Random(4)
    alphabet = ["the", "naïve", "été", " ", " ", "  ", "\n", "\t", "'s", "12", "中文", "▁", "　", "\xa0", "<s>", "<|endoftext|>", "\U0001f600", ".", "é", "x" * 30, "<0x0A>", "\x00", "ﬁ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(400)]
    return [*texts, None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "end 　 x", "word " * 3000, "▁", "▁ a", "a ▁ b", texts[3], texts[3]]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("top_pairs", [1 << 20, 40, 0])
def test_by_plain_loops(spark, library, top_pairs):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    want, _ = plain(library, texts)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align(docs, top_pairs=top_pairs).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert sum(1 for w in want if w[0]) > 200 and sum(1 for w in want if not w[0]) > 20


def test_pair_counts(spark, library):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    found = link_counts(aligned_texts(docs, None, None, "doc_id", "doc_id", "text")).collect()
    assert {divmod(r["link"], 32_000): r["n"] for r in found} == plain(library, texts)[1]


def test_segments_of_invented_prose(library):
    both = Tokenizers(read_files())
    assert both.cuts
    text = " Èenai èauxque. It's 12 o'clock, naïve"
    parts = [" Èenai èauxque.", " It's", " 12", " o'clock,", " naïve"]
    for _ in range(2):
        (a, a_off), (b, b_off) = both.ids([p.encode() for p in parts])
        assert a.tolist() == library[0].encode(text, add_special_tokens=False).ids and len(a_off) == len(b_off) == 6
        assert b.tolist() == library[1].encode(text[1:])


def test_empty_table_repeated_and_null_ids(spark, library):
    assert align(spark.createDataFrame([], SCHEMA)).collect() == []
    texts = ["some words", "some words", "other words", "some words"]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip([1, 1, None, None], texts)], SCHEMA)
    for top_pairs in (100, 0):
        found = sorted(tuple(r[c] for c in COLUMNS) for r in align(docs, top_pairs=top_pairs).collect())
        assert found == sorted(plain(library, texts)[0])


def test_long_text(spark, library):
    texts = ["long prose, again and again " * 300_000, "short"]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in align(docs).collect()}
    assert found[0]["n_a"] == len(library[0].encode(" " + texts[0][:-1], add_special_tokens=False).ids) + 1
    assert found[0]["groups"].count(";") + 1 == found[0]["n_groups"]


def test_query(spark, library, tmp_path):
    texts = corpus()[:60] + [None, ""]
    spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in q.op13_align_tokenizers(spark, str(tmp_path)).collect()}
    for i, want in enumerate(plain(library, texts)[0]):
        assert tuple(found[i][c] for c in COLUMNS[:-1]) == want[:-1]
        assert found[i]["groups_sha256"] == (hashlib.sha256(want[-1].encode()).hexdigest() if want[0] else "")
