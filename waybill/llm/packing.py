"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenized and cut at every `size` tokens. Only the histogram of piece lengths, at most `size` numbers,
reaches the driver. There packs are built as patterns with counts, lengths longest first, each into the shortest packs with
room for it. The patterns go back to the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm.common import BUCKETS, blocks, bounded_batches, ranked, staged, texts_of
from waybill.llm.token_counts import byte_letters, split_special

# Fixed value: how a byte-level pre-tokenizer cuts texts.
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# Characters that have been letters, numbers, signs or white space in all versions of Unicode any tokenizer may know.
_SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")


class Encoder:
    """Ids of whole texts, as a byte-level tokenizer of the tokenizers library gives them.

    Where it is certain that the ids are the same, the merges run in tiktoken's core, which takes a quarter of the time: the vocabulary is plain byte-level
    BPE, its ids are in the order of its merges, each merge makes a token of its own, each token's bytes encode to that token, and the text has
    only characters whose classes never changed. Under these conditions a pair of tokens with a known joint can only meet
    after all earlier merges if it is the pair the joint was learned from, so merging by joints and by pairs is the same.
    All other texts, and all texts of other tokenizers, are encoded by the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = added
        self.core = self._core()

    def _core(self) -> tiktoken.Encoding | None:
        given = json.loads(self.tokenizer.to_str())
        model, cut = given["model"], given["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or given["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            return None
        letters, ids = byte_letters(), model["vocab"]
        known = {bytes(letters[c] for c in text): i for text, i in ids.items() if all(c in letters for c in text)}
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])) or any(bytes([k]) not in known for k in range(256)) or len(known) != 256 + len(made):
            return None
        core = tiktoken.Encoding("byte-level", pat_str="(?s:.+)", mergeable_ranks=known, special_tokens={})
        texts = [w.decode("utf-8", "replace") for w in known]
        whole = [(t, i) for t, w, i in zip(texts, known, known.values()) if t.encode() == w]
        # The token of a whole word is what the library gives for it; tokens that are parts of characters can't be asked for, so the core is.
        # A few at a time: what the library returns for a text is large.
        for a in range(0, len(whole), 1000):
            some = [(t, i) for t, i in whole[a:a + 1000] if _one_piece(t)]
            if any(e.ids != [i] for e, (_, i) in zip(self._alone([t for t, _ in some]), some)):
                return None
        if any(core._encode_single_piece(w) != [i] for w, i in known.items()):
            return None
        return tiktoken.Encoding("byte-level", pat_str=_CUT, mergeable_ranks=known, special_tokens={})

    def _alone(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        parts, _, specials = split_special(texts, self.special)
        out: list[np.ndarray | None] = [None] * len(parts)
        others = []
        for k, part in enumerate(parts):
            if self.core and _SETTLED.fullmatch(part):
                out[k] = np.array(self.core.encode_ordinary(part), np.uint32)
            else:
                others.append(k)
        for k, encoded in zip(others, self._alone([parts[k] for k in others])):
            out[k] = np.array(encoded.ids, np.uint32)
        if len(parts) == len(texts):
            return out
        joined, k = [], 0
        for i, n in enumerate(specials.tolist()):
            found = self.special.findall(texts[i]) if n else []
            mine = [out[k]]
            for j, name in enumerate(found, 1):
                mine += [np.array([self.added[name]], np.uint32), out[k + j]]
            k += n + 1
            joined.append(np.concatenate(mine))
        return joined


def _one_piece(text: str) -> bool:
    """Whether a token's text is cut nowhere; a token that is can't come out of any text, nor of the core."""
    return len(regex.findall(_CUT, text)) == 1


_ENCODERS: dict[str, Encoder] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's ids and `end_id`, cut at every `size` ids: one row per piece, with the ids' checksum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts, keys = texts_of(batch["text"]), batch["doc_id"].astype("Int64")
            for a, b in blocks(texts):
                rows = []
                for i, ids in zip(range(a, b), encoder.ids(texts[a:b])):
                    ids = np.concatenate((ids, end)).astype("<u4")
                    rows += [(i, s, min(size, len(ids) - s), zlib.crc32(ids[s:s + size].tobytes()), len(ids)) for s in range(0, len(ids), size)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                out["doc_id"] = keys.iloc[out["doc_id"]].array
                yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


@dataclass
class Pattern:
    """`count` packs alike; parts: (length, how many of it, offset of the first)."""

    count: int
    room: int
    parts: list[tuple[int, int, int]]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Packs for all lengths of the histogram. Work depends on the number of distinct lengths and patterns, not on the counts."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern) -> None:
        if pattern.room not in by_room:
            by_room[pattern.room] = []
            rooms.insert(bisect_right(rooms, pattern.room), pattern.room)
        by_room[pattern.room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # No pack has room. Alone, new packs would be the shortest until they are full.
                most = size // length
                for n, each in ((left // most, most), (1, left % most)):
                    if n and each:
                        put(Pattern(n, size - each * length, [(length, each, 0)]))
                break
            room = rooms[-1]
            pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            if pattern.count > left:
                put(Pattern(pattern.count - left, room, pattern.parts))
            used = min(pattern.count, left)
            left -= used
            *before, last = pattern.parts
            if last[0] == length:
                parts = [*before, (length, last[1] + 1, last[2])]
            else:
                parts = [*pattern.parts, (length, 1, size - room)]
            put(Pattern(used, room - length, parts))
    return [p for r in sorted(by_room) for p in by_room[r]]


def placements(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, first sequence, how many per pack, offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        for length, each, offset in pattern.parts:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, each, offset))
            ranks[length] = rank + pattern.count * each
        sequence += pattern.count
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs whole documents into sequences of at most `size` tokens: one row per piece with its sequence and offset.

    path: a tokenizers .json file, readable on every executor. A null or empty text is `end_id` alone; a null doc_id stays; repeated
    rows are packed each; an empty table gives no rows; other columns are not read. Reruns agree: pieces
    are ranked by bucket, doc_id, start and checksum, and rows equal in all of these are interchangeable.
    """
    bounded_batches(docs.sparkSession)
    pieces = staged(token_pieces(docs, path, size, end_id), "pieces")
    # At most `size` rows, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = placements(shortest_pack_first(histogram, size))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    known = ranked(pieces, ["length"], order, F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                rows, mine = places[int(length)], np.flatnonzero(lengths == length)
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1]
                past = ranks[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + past // row[:, 2]
                offset[mine] = row[:, 3] + past % row[:, 2] * length
            yield batch.assign(sequence_id=sequence, offset=offset)

    return known.mapInPandas(run, f"{PIECES}, sequence_id long, offset long")
