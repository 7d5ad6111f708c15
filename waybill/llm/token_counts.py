"""Token counts of whole texts by compiled finite-state transducers.

Two transducers stand for a byte-level BPE tokenizer. The first cuts a text into pieces (see segments.py: chunk maps, prefix
scan). The second reads a piece's bytes; each transition is annotated with the change in the number of tokens
that the bytes so far encode to. New pieces are read side by side, a byte of each at a time. Its states are compiled as texts need them and kept by
the Python worker, up to MAX_STATES; then the table starts anew, so memory is bounded and results don't depend on it.

The encoding of a prefix is its longest last token that may follow the encoding of what stands before; two
tokens may follow one another if BPE leaves them as they are. So a state is: for each place from which a
vocabulary entry may still grow, the node reached in the vocabulary's tree, the last token before that place, and
the token count there relative to now. This is finite, as entries have bounded lengths.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm.common import blocks, bounded_batches, codes, texts_of
from waybill.llm.segments import Segmenter, equal_pieces

MAX_STATES = 150_000
MAX_PIECES = 2_000_000
#: Bytes of pieces that are read side by side, and so states that may come between two looks at their number.
SIDE_BYTES = 1 << 17
#: Characters from which a piece is counted anew each time.
LONG = 64
BEGIN = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others by the next
    free code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PieceTransducer:
    """Counts the tokens of pieces; compiled from the vocabulary and merges of a tokenizer.

    A transition is one number: the next state, and in its low bits the tokens it emits plus `base`. 0 stands for one not compiled yet.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE model is needed")
        letters, ids = byte_letters(), model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in text) for text, i in ids.items() if all(c in letters for c in text)}
        self.single = {text[0]: i for i, text in self.bytes_of.items() if len(text) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [BEGIN]
        merged = {made for _, made in self.merges.values()} | set(self.single.values())
        for i in merged:
            node = 0
            for b in self.bytes_of[i]:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(BEGIN)
            self.token[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.halves = {made: pair for pair, (_, made) in self.merges.items()}
        self.rank = dict.fromkeys(self.single.values(), BEGIN) | {made: rank for rank, made in self.merges.values()}
        self.in_order = self._in_order()
        # Twice the longest entry, as a byte may give or take tokens.
        self.bits = (2 * max(map(len, self.bytes_of.values())) + 8).bit_length()
        self.base = 1 << (self.bits - 1)
        self.clear()

    def _in_order(self) -> bool:
        """Whether each token is made by one merge, later than its halves are, and its own bytes encode to it. Then no merge opens the way to an earlier one."""
        return len(self.halves) == len(self.merges) and not set(self.halves) & set(self.single.values()) and all(
            self.rank[a] < rank > self.rank[b] and self._apart(a, b, rank) for (a, b), (rank, _) in self.merges.items())

    def clear(self) -> None:
        start = ((0, BEGIN, 0),)
        self.states, self.keys = {start: 0}, [start]
        # Room for all states that may be made before the next look at their number. Rows take memory only when they are written.
        rows = MAX_STATES + SIDE_BYTES + 2
        self.table = np.zeros(rows << 8, np.uint32 if rows << self.bits < 1 << 32 else np.uint64)
        self.cells = memoryview(self.table)

    def encode(self, text: bytes) -> list[int]:
        """Plain BPE: the merge of lowest rank first."""
        tokens = [self.single[b] for b in text]
        while len(tokens) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(tokens, tokens[1:])) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            tokens[k:k + 2] = [self.merges[tokens[k], tokens[k + 1]][1]]
        return tokens

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether nothing merges across the joint of two tokens before the merge `until`: they are taken apart there, the later made one first.

        Of merges of one rank the left one comes first, so the right token's own merge leaves one of its rank across the joint the time to come.
        """
        merges, rank, halves = self.merges, self.rank, self.halves
        while True:
            known = merges.get((a, b))
            if known is not None and known[0] < until:
                return False
            left, right = rank[a], rank[b]
            if left > right:
                until, a = left, halves[a][1]
            elif right > BEGIN:
                until, b = right + 1, halves[b][0]
            else:
                return True

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 8 * MAX_STATES:
                self.follows.clear()
            known = self.follows[a, b] = (
                self._apart(a, b, len(self.merges)) if self.in_order else self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
        return known

    def _state(self, key: tuple) -> int:
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        return to

    def compile(self, state: int, byte: int) -> int:
        """Adds the transition: the next state and the tokens it emits (negative where tokens grow together)."""
        children, tokens = self.children, self.token
        grown = [(node, last, n) for at, last, n in self.keys[state] if (node := children[at].get(byte)) is not None]
        # Places stand from the farthest on, so the first that fits is the longest last token.
        for node, last, n in grown:
            token = tokens[node]
            if token != BEGIN and (last == BEGIN or self.may_follow(last, token)):
                emits = n + 1
                break
        to = self._state((*[(node, last, n - emits) for node, last, n in grown if children[node]], (0, token, 0)))
        low = emits + self.base
        if not 0 < low < 2 * self.base:
            raise OverflowError(f"{emits} tokens by one byte")
        self.cells[state << 8 | byte] = hit = to << self.bits | low
        return hit

    def count(self, piece: bytes) -> int:
        """Tokens of one piece of any length."""
        state, total, bits, mask = 0, -self.base * len(piece), self.bits, 2 * self.base - 1
        for byte in piece:
            hit = self.cells[state << 8 | byte]
            if not hit:
                if len(self.keys) > MAX_STATES:
                    key = self.keys[state]
                    self.clear()
                    state = self._state(key)
                hit = self.compile(state, byte)
            state = hit >> bits
            total += hit & mask
        return total

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of short pieces, read side by side: a step reads one byte of each."""
        ends = np.cumsum([len(p) for p in pieces])
        out, first = np.zeros(len(pieces), np.int64), 0
        while first < len(pieces):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SIDE_BYTES, "right")))
            if ends[last - 1] - before > SIDE_BYTES:
                out[first] = self.count(pieces[first])
            else:
                out[first:last] = self._side_by_side(pieces[first:last])
            first = last
        return out

    def _side_by_side(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.keys) > MAX_STATES:
            self.clear()
        lengths = np.array([len(p) for p in pieces])
        # Longest first, so that those that go on stand in front.
        order = np.argsort(-lengths, kind="stable")
        text, starts = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(lengths) - lengths)[order]
        going = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
        state, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        mask = self.table.dtype.type(2 * self.base - 1)
        for k, n in enumerate(going.tolist()):
            at = state[:n] << 8 | text[starts[:n] + k]
            hits = self.table[at]
            new = np.flatnonzero(hits == 0)
            if len(new):
                for cell in np.unique(at[new]).tolist():
                    self.compile(cell >> 8, cell & 255)
                hits[new] = self.table[at[new]]
            state[:n] = hits >> self.bits
            total[:n] += hits & mask
        out = np.empty(len(pieces), np.int64)
        out[order] = total - self.base * lengths[order]
        return out


class Counter:
    """Counts tokens of texts. Pieces are known by their characters, not by a hash of them, and counted once while they fit MAX_PIECES."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.segments, self.transducer = Segmenter(tokenizer), PieceTransducer(tokenizer)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owners, total = split_special(texts, self.special)
        at, borders = codes(parts)
        starts = self.segments.starts(at, borders)
        if not len(starts):
            return total
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        joined = "".join(parts)
        first, group = equal_pieces(at, starts)
        begin = starts[first].tolist()
        end = np.append(starts, len(at))[first + 1].tolist()
        per_piece = self.of_pieces([joined[a:b] for a, b in zip(begin, end)])[group]
        np.add.at(total, owners[np.searchsorted(borders, starts, "right") - 1], per_piece)
        return total

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        new = [k for k, n in enumerate(found) if n is None]
        short = [k for k in new if len(pieces[k]) <= LONG]
        for k, n in zip(short, self.transducer.counts([pieces[k].encode() for k in short]).tolist()):
            found[k] = self.known[pieces[k]] = n
        for k in new:
            if len(pieces[k]) > LONG:
                found[k] = self.transducer.count(pieces[k].encode())
        return np.array(found, np.int64)


def split_special(texts: list[str], special: re.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts between, the text of each part, and the special strings per text."""
    specials = np.zeros(len(texts), np.int64)
    parts, owners = [], []
    for i, text in enumerate(texts):
        cut = special.split(text) if special and special.search(text) else [text]
        specials[i] = len(cut) - 1
        parts += cut
        owners += [i] * len(cut)
    return parts, np.array(owners, np.int64), specials


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with n_bytes, n_tokens and over_limit of each whole text.

    path: a tokenizers .json file with a byte-level BPE model, readable on every executor. A null or empty text has 0 bytes
    and tokens; rows stay one to one, repeated ones too; an empty table gives an empty one. Columns that have the names of
    the results are replaced. Special strings inside a text are one token each, as the library's default is.
    """
    bounded_batches(docs.sparkSession)
    results = "n_bytes long, n_tokens long, over_limit boolean"
    names = [f.split()[0] for f in results.split(", ")]
    kept = [c for c in docs.columns if c != text and c not in names]
    whole = "_text"
    while whole in kept:
        whole += "_"
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(whole))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            texts = texts_of(batch.pop(whole))
            n = np.zeros(len(texts), np.int64)
            for a, b in blocks(texts):
                n[a:b] = counter.counts(texts[a:b])
            yield batch.assign(n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=n > limit)

    schema = source.drop(whole).schema
    for field in results.split(", "):
        schema = schema.add(*field.split())
    return source.mapInPandas(run, schema)
