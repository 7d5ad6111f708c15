"""Byte-level tokenizers: cutting texts into pieces by a finite-state transducer whose chunk maps are composed by a prefix scan.

A byte-level BPE tokenizer first cuts a text into pieces (words with their leading space, numbers, runs of signs,
white space) and then encodes each piece by itself. The cutting is a transducer of nine states over eighteen symbols,
one output per started piece. A text may be read from any place: the map of a chunk says, for every state before
it, the state after it; maps of neighbours compose, and a prefix scan of them gives the state before every chunk. From there the
chunks are read once more, side by side, whatever a text's length, and put out where pieces start.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

LETTER, NUMBER, SIGN, SPACE, WHITE = range(5)
#: Symbols: the first three classes, a space or other white space before something else than white space (SPACE,
#: WHITE), the same before white space or the end, and an apostrophe before a one- or two-letter ending. A text's
#: first character has the same symbol plus FIRST.
SPACE_LAST, WHITE_LAST, SHORT_ENDING, LONG_ENDING = 5, 6, 7, 8
FIRST = 9
#: States: what was read just before. SPACE_READ is a space that belongs to the next piece.
START, IN_LETTERS, IN_NUMBER, IN_SIGNS, SPACE_READ, IN_WHITE, ENDING_1, ENDING_2, ENDED = range(9)
STATES = 9
#: English endings that are pieces of their own.
ENDINGS_1, ENDINGS_2 = ("s", "t", "m", "d"), ("re", "ve", "ll")

CHUNK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted pieces of each state and symbol, as flat tables with index 18 * state + symbol."""
    to, out = np.zeros((STATES, 2 * FIRST), np.uint8), np.zeros((STATES, 2 * FIRST), np.uint8)
    for state in range(STATES):
        for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBER), (SIGN, IN_SIGNS)):
            to[state, symbol], out[state, symbol] = own, state not in (own, SPACE_READ)
        for symbol, left in ((SHORT_ENDING, ENDING_1), (LONG_ENDING, ENDING_2)):
            joined = state in (IN_SIGNS, SPACE_READ)
            to[state, symbol], out[state, symbol] = (IN_SIGNS, state == IN_SIGNS and 0) if joined else (left, 1)
        to[state, SPACE], out[state, SPACE] = SPACE_READ, 1
        to[state, WHITE], out[state, WHITE] = IN_WHITE, 1
        for symbol in (SPACE_LAST, WHITE_LAST):
            to[state, symbol], out[state, symbol] = IN_WHITE, state != IN_WHITE
    to[ENDING_2, LETTER], out[ENDING_2, LETTER] = ENDING_1, 0
    to[ENDING_1, LETTER], out[ENDING_1, LETTER] = ENDED, 0
    to[:, FIRST:], out[:, FIRST:] = to[START, :FIRST], out[START, :FIRST]
    return to.ravel(), out.ravel()


NEXT, EMITS = _transducer()
_ROWS = (np.arange(STATES) * 2 * FIRST).astype(np.uint8)
# Next state times 18, so that a step is one addition and one look-up.
_STEP = (NEXT * (2 * FIRST)).astype(np.uint8)


class Segmenter:
    """Cuts texts as the pre-tokenizer of a byte-level tokenizer does. Classes of characters are asked from the
    tokenizer itself, once per character."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, 255, np.uint8)
        for code in range(128):
            self.classes[code] = self._class_of(chr(code))

    def _class_of(self, char: str) -> int:
        if char == " ":
            return SPACE
        one = lambda text: len(self.cut(text)) == 1
        return LETTER if one(f"a{char}") else NUMBER if one(f"1{char}") else SIGN if one(f"!{char}") else WHITE

    def symbols(self, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        kinds = self.classes[codes]
        if (kinds == 255).any():
            for code in np.unique(codes[kinds == 255]).tolist():
                self.classes[code] = SIGN if 0xD800 <= code < 0xE000 else self._class_of(chr(code))
            kinds = self.classes[codes]
        n = len(codes)
        inner = borders[1:-1]
        white = kinds >= SPACE
        # White space before white space, or at the end of its text.
        last = np.ones(n, bool)
        last[:-1] = white[1:]
        last[inner[inner > 0] - 1] = True
        symbols = kinds + np.uint8(2) * (white & last)
        marks = np.flatnonzero(codes == 39)
        if len(marks):
            ends = borders[np.searchsorted(borders, marks, "right")]
            after = lambda k: np.where(marks + k < ends, codes[np.minimum(marks + k, n - 1)], 0)
            one, two = after(1), after(2)
            short = np.isin(one, [ord(e) for e in ENDINGS_1])
            long = np.zeros(len(marks), bool)
            for a, b in ENDINGS_2:
                long |= (one == ord(a)) & (two == ord(b))
            symbols[marks[short]], symbols[marks[long]] = SHORT_ENDING, LONG_ENDING
        firsts = np.unique(borders[:-1])
        symbols[firsts[firsts < n]] += FIRST
        return symbols

    def starts(self, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Places at which pieces start."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        symbols = self.symbols(codes, borders)
        chunks = -(-n // CHUNK)
        # Chunks as columns: a step reads one row. What fills up the last chunk is cut off afterwards.
        rows = np.zeros(chunks * CHUNK, np.uint8)
        rows[:n] = symbols
        rows = np.ascontiguousarray(rows.reshape(chunks, CHUNK).T)
        before = _entry_states(rows)
        emits = np.empty((CHUNK, chunks), bool)
        at = before
        for k in range(CHUNK):
            at = at + rows[k]
            emits[k] = EMITS[at]
            at = _STEP[at]
        return np.flatnonzero(emits.T.ravel()[:n])


def _entry_states(rows: np.ndarray) -> np.ndarray:
    """State (times 18) before each chunk, by composing the chunks' state maps in a parallel prefix scan."""
    maps = chunk_maps(rows)
    step = 1
    while step < maps.shape[1]:
        # The map up to a chunk, after the map of all that lies up to `step` chunks before.
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)
        step *= 2
    return np.concatenate(([START], maps[START, :-1])).astype(np.uint8) * np.uint8(2 * FIRST)


def chunk_maps(rows: np.ndarray) -> np.ndarray:
    """For each state and chunk the state after the chunk."""
    at = np.repeat(_ROWS[:, None], rows.shape[1], 1)
    for row in rows:
        at = _STEP[at + row]
    return at // np.uint8(2 * FIRST)


def equal_pieces(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with the same characters as one group: a place of each group among the pieces, and the group of each piece.

    Pieces are grouped by a hash, then each is compared with its group's first one; where two differ, all are grouped by their characters.
    """
    lengths = np.diff(np.append(starts, len(codes)))
    inside = np.arange(len(codes)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _ODD, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    hashes = np.add.reduceat((codes + np.uint64(0x51ED27)) * powers[inside], starts) ^ (lengths.astype(np.uint64) << np.uint64(40))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    same = lengths == lengths[first][group]
    # Where lengths differ the comparison would run over another piece's end.
    model = np.repeat(np.where(same, starts[first][group], starts), lengths) + inside
    if not same.all() or not np.array_equal(codes[model], codes):
        known: dict[bytes, int] = {}
        ends = np.append(starts[1:], len(codes))
        group = np.array([known.setdefault(codes[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
        first = np.unique(group, return_index=True)[1]
    return first, group
