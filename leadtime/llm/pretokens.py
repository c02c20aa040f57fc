"""Where pre-tokens begin, by a scan of transition functions over the classes of characters.

The pattern is that of the byte-level rank files: contractions, then runs of letters, of numbers, or of other visible
characters, each with one space before it if there is one, then white space but for a last blank that the next run takes.
A character is a function from states to states. Functions compose, so the state before each character is a prefix scan,
which is done inside blocks for all blocks at once, then over the blocks.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Classes of characters. An apostrophe that may begin a contraction of two or three characters has a class of its own.
OTHER, LETTER, NUMBER, BLANK, WHITE, SHORT, LONG = range(7)
#: States: a pre-token begins next, a blank came last, inside a run, one or two letters of a contraction to come.
FRESH, AFTER_BLANK, IN_OTHERS, IN_LETTERS, IN_NUMBERS, ONE_LEFT, TWO_LEFT = range(7)
STATES = 7
# The endings of contractions.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@cache
def class_table() -> np.ndarray:
    """The class of each code point, by the same Unicode tables that the tokenizer library has."""
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        # An encoding of single bytes gives back the characters that match its pattern.
        matching = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(matching.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = BLANK
    return table


def step(state: int, kind: int) -> int:
    """The state after a character of this class."""
    if state in (ONE_LEFT, TWO_LEFT):
        return FRESH if state == ONE_LEFT else ONE_LEFT
    if kind in (SHORT, LONG) and state not in (AFTER_BLANK, IN_OTHERS):
        return ONE_LEFT if kind == SHORT else TWO_LEFT
    return {BLANK: AFTER_BLANK, WHITE: FRESH, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHERS)


def begins(state: int, kind: int) -> bool:
    """Whether a pre-token begins at a visible character of this class."""
    same = {IN_LETTERS: (LETTER,), IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, SHORT, LONG)}
    return state == FRESH or (state in same and kind not in same[state])


@cache
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that characters compose to: number of each class's (and of the same at a text's beginning), products, values."""
    plain = [tuple(step(s, kind) for s in range(STATES)) for kind in range(7)]
    first = [(step(FRESH, kind),) * STATES for kind in range(7)]
    found = dict.fromkeys([tuple(range(STATES)), *plain, *first])
    while True:
        grown = found | dict.fromkeys(tuple(b[x] for x in a) for a in found for b in found)
        if len(grown) == len(found):
            break
        found = grown
    place = {f: i for i, f in enumerate(found)}
    product = np.array([[place[tuple(b[x] for x in a)] for b in found] for a in found], np.uint8)
    return np.array([[place[f] for f in plain], [place[f] for f in first]], np.uint8), product, np.array(list(found), np.uint8)


def states_before(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each character; ``first`` marks the first character of each text."""
    number, product, values = functions()
    n = len(kinds)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)  # function 0 is the identity
    padded[:n] = number[first.astype(np.uint8), kinds]
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    before, total = np.empty_like(columns), np.zeros(blocks, np.uint8)
    for j in range(width):
        before[j] = total
        total = product[total, columns[j]]
    past, so_far = np.empty(blocks, np.uint8), 0
    for k, f in enumerate(total.tolist()):
        past[k] = so_far
        so_far = product[so_far, f]
    return values[product[past[None, :], before], FRESH].T.reshape(-1)[:n]


def characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, and its code point."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.int32)
    code = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.r_[raw, np.zeros(3, np.uint8)]
        b = [(padded[at[wide] + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        lead = lead[wide]
        two, three, four = (lead & 0x1F) << 6 | b[0], (lead & 0xF) << 12 | b[0] << 6 | b[1], (lead & 7) << 18 | b[0] << 12 | b[1] << 6 | b[2]
        code[wide] = np.minimum(np.select([lead < 0xE0, lead < 0xF0], [two, three], four), 0x10FFFF)
    return at, code


def pretoken_starts(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens of texts (end to end in ``raw``, with offsets) begin, in order."""
    at, code = characters(raw)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 2, bool)
    first[np.searchsorted(at, off)] = True
    first[n:] = True
    kinds = table[code]
    mark = np.flatnonzero(code == ord("'"))
    after = np.r_[code, 0, 0]
    one, two, alone, last = after[mark + 1], after[mark + 2], first[mark + 1], first[mark + 2]
    kinds[mark[~alone & np.isin(one, [ord(c) for c in ONE_LETTER])]] = SHORT
    kinds[mark[~alone & ~last & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in TWO_LETTERS])]] = LONG
    blank = (kinds == BLANK) | (kinds == WHITE)
    visible = np.array([[begins(s, kind) for kind in range(7)] for s in range(STATES)])[states_before(kinds, first[:n]), kinds]
    opens = first[:n] | ~np.r_[True, blank[:-1]]
    closes = ~(first[1 : n + 1] | np.r_[blank[1:], True])
    return at[np.where(blank, opens | closes, visible | first[:n])]
