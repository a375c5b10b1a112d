"""Where the pieces of a text begin that a byte-level BPE merges within: by a finite-state machine over codepoint classes, without a regular expression.

The pattern of these vocabularies is: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of digits or of other signs, each with one
space before it if there is one; white space, of which the last character before a word is left to the word if it is a space and stands
alone if it is not. Looking ahead is done first, by splitting classes (an apostrophe's letter that is followed by the right one, white space
that is the last of its run); what is left is a machine of eight states. Every character is then a function from states to states; the
functions of equal chunks are composed for all chunks at once, a prefix composition gives each chunk its first state, and a second
pass gives the state before each character.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Classes of codepoints: other signs, letters, digits, white space.
OTHER, LETTER, DIGIT, SPACE = range(4)
#: Codepoints with the White_Space property. Fixed values.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters behind an apostrophe that make a contraction by themselves, and those that do with a second one. Fixed values.
SINGLE, DOUBLE = "stmd", (("r", "e"), ("v", "e"), ("l", "l"))

#: Symbols of the machine.
Y_OTHER, Y_APOSTROPHE, Y_LETTER, Y_SINGLE, Y_DOUBLE, Y_DIGIT, Y_INNER, Y_LAST_SPACE, Y_LAST_WHITE, Y_BREAK = range(10)
#: States: nothing or a finished contraction; within letters, digits, signs; a lone apostrophe that began its piece; a space that began one;
#: white space; the second letter of a contraction is next.
Q_NEW, Q_LETTER, Q_DIGIT, Q_OTHER, Q_APOSTROPHE, Q_SPACE, Q_WHITE, Q_SECOND = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state."""
    step, begins = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    same = {Y_LETTER: Q_LETTER, Y_SINGLE: Q_LETTER, Y_DOUBLE: Q_LETTER, Y_DIGIT: Q_DIGIT, Y_OTHER: Q_OTHER, Y_APOSTROPHE: Q_OTHER}
    for y, q in same.items():
        step[y] = q
        begins[y, [q, Q_SPACE]] = False
    step[Y_APOSTROPHE] = Q_APOSTROPHE
    step[Y_APOSTROPHE, [Q_OTHER, Q_SPACE, Q_APOSTROPHE]] = Q_OTHER
    for y in (Y_OTHER, Y_APOSTROPHE):
        begins[y, Q_APOSTROPHE] = False
    step[Y_SINGLE, Q_APOSTROPHE], begins[Y_SINGLE, Q_APOSTROPHE] = Q_NEW, False
    step[Y_DOUBLE, Q_APOSTROPHE], begins[Y_DOUBLE, Q_APOSTROPHE] = Q_SECOND, False
    for y in (Y_LETTER, Y_SINGLE, Y_DOUBLE):
        step[y, Q_SECOND], begins[y, Q_SECOND] = Q_NEW, False
    step[Y_INNER], begins[Y_INNER, Q_WHITE] = Q_WHITE, False
    step[Y_LAST_SPACE], step[Y_LAST_WHITE], step[Y_BREAK] = Q_SPACE, Q_NEW, Q_NEW
    return step, begins


def scan(symbols: np.ndarray, step: np.ndarray, chunk: int = 256) -> np.ndarray:
    """The state before each symbol, from state 0, by composition of the symbols' functions."""
    n, q = len(symbols), step.shape[1]
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    table = step.reshape(-1)
    whole = np.broadcast_to(np.arange(q, dtype=np.uint8), (rows, q)).copy()
    for k in range(chunk):
        whole = table[(grid[k].astype(np.uint16) * q)[:, None] + whole]
    span = 1
    while span < rows:
        whole[span:] = np.take_along_axis(whole[span:], whole[:-span].astype(np.intp), 1)
        span *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, 0]
    out = np.empty((chunk, rows), np.uint8)
    for k in range(chunk):
        out[k] = state
        state = table[grid[k].astype(np.uint16) * q + state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in ``codes``, the codepoints of several texts one behind the other, at which pieces begin; ``ends`` are the places behind the texts."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    last = np.zeros(n, bool)
    last[ends[(ends > 0)] - 1] = True
    follow, code = np.full(n, 255, np.uint8), np.zeros(n, np.uint32)
    follow[:-1], code[:-1] = kind[1:], codes[1:]
    follow[last], code[last] = 255, 0
    symbol = np.array([Y_OTHER, Y_LETTER, Y_DIGIT, Y_INNER], np.uint8)[kind]
    symbol[codes == ord("'")] = Y_APOSTROPHE
    symbol[np.isin(codes, [ord(c) for c in SINGLE])] = Y_SINGLE
    for a, b in DOUBLE:
        symbol[(codes == ord(a)) & (code == ord(b))] = Y_DOUBLE
    tail = (kind == SPACE) & (follow != SPACE) & (follow != 255)
    symbol[tail] = np.where(codes[tail] == 0x20, Y_LAST_SPACE, Y_LAST_WHITE)
    # a break symbol before each text
    texts = np.searchsorted(ends, np.arange(n), "right")
    at = np.arange(n) + texts + 1
    symbols = np.full(n + len(ends) + 1, Y_BREAK, np.uint8)
    symbols[at] = symbol
    step, begins = machine()
    state = scan(symbols, step)
    return np.flatnonzero(begins[symbols, state][at])
