"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter, grouped under their frequent forms.

The vocabulary is held as a bit-sliced position index: for each position and letter, a bitset of the words that have this letter there. A
word is looked up by recurrences that work on whole bitsets, 64 words of the vocabulary at a time: one set of the words that agree with no error so
far, one of those that agree with one error, where the letters of the longer word are shifted by one position behind an insertion. The sets of
all words of a block are tracked at once, as rows of one array.

Two words are compared in the class of the shorter one's length, so a word stands in the index of its own length and asks there and in the
index one letter shorter. A class of more than BLOCK words is parted: one of two halves of a word must be free of the error, so
its words go to a block of those with the same first half and to a block of those with the same second half, and blocks that are still too large
are parted again at the half that may hold the error. No pairs are listed but those that are near.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import lower_ascii, staged

#: Letters of a run; shortest word; fewest occurrences; one in NOISE runs loses a letter; how much more frequent a form must be.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, FEWEST, NOISE, TIMES = 7, 2, 31, 10

#: Words of a block, unless they agree in all but two letters, of which there can be no more than letters squared.
BLOCK = 8192
#: Words of an index that small blocks of one class share, and words that ask it at once.
TOGETHER, ASKING = 2048, 512


def words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, noise: int = NOISE) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, with their number, of those that are long and frequent enough.

    A run loses a letter where `noise` divides the checksum of its document's id, a colon and the run; the checksum also says which one. A null text has no
    runs; a null doc_id is an empty one. Runs of one document are not counted apart, so repeated rows count as often as they come.
    """
    # A shorter run can't become a word of `shortest` letters, and a greedy run starts where the letters start.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run"))
    lowered = runs.select("doc", run.alias("run"))
    drawn = lowered.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    counted = drawn.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= fewest)


def _block() -> Column:
    """Name of a block: length of its index, the letters from `lo` to `hi` that may differ, and all other letters."""
    return F.expr("concat_ws(':', size, lo, hi, concat(left(word, lo), right(word, size - hi)))")


def blocks(vocabulary: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(block, size, word, n): every word in blocks such that any two near words meet in one. Blocks hold `limit` words, or differ in two letters at most."""
    shortest = vocabulary.agg(F.min(F.length("word")).alias("s"))
    # A word's own class and, as the longer one of a pair, the class below.
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows = vocabulary.select("word", "n", sizes).join(F.broadcast(shortest), F.col("size") >= F.col("s")).drop("s")  # one row
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.col("size")}).withColumn("block", _block())
    done = []
    while True:
        rows = staged(rows, "word-blocks")
        large = staged(rows.where("hi - lo > 2").groupBy("block").agg(F.count("*").alias("words")).where(F.col("words") > limit).select("block"), "large-blocks")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows]).select("block", "size", "word", "n")
        done.append(rows.join(large, "block", "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        parted = rows.join(large, "block", "left_semi").select("word", "n", "size", F.explode(halves).alias("half"))
        rows = parted.select("word", "n", "size", "half.lo", "half.hi").withColumn("block", _block())


def _bitsets(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _letters(texts: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), size)


def one_error(index: np.ndarray, index_block: np.ndarray, asking: np.ndarray, asking_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking, index) of words of one block that differ by exactly one letter.

    Both are arrays of letters, a row per word; asking words are as long as those of the index (one letter replaced) or longer by
    one (one letter inserted).
    """
    size, longer = index.shape[1], asking.shape[1] > index.shape[1]
    names, own = np.unique(index_block, return_inverse=True)
    at = np.searchsorted(names, asking_block)
    at[at == len(names)] = 0
    members = _bitsets(own[None, :] == np.arange(len(names))[:, None])
    none = members[at] * (names[at] == asking_block)[:, None].astype(np.uint64)
    one = np.zeros_like(none)
    slot = np.zeros(256, np.intp)
    for i in range(size):
        # The index of this position: a bitset per letter, the first one for letters that no word has here.
        present = np.unique(index[:, i])
        sets = _bitsets(np.concatenate((np.zeros((1, len(index)), bool), index[:, i][None, :] == present[:, None])))
        slot[:] = 0
        slot[present] = np.arange(1, len(present) + 1)
        here = sets[slot[asking[:, i]]]
        if longer:
            # Behind the insertion the letters stand one position further on.
            one = (one | none) & sets[slot[asking[:, i + 1]]]
        else:
            one = (one & here) | (none & ~here)
        none &= here
    if longer:
        one |= none
    hits = np.flatnonzero(one.any(axis=1))
    bits = np.unpackbits(one[hits].view(np.uint8), axis=1, bitorder="little", count=len(index))
    who, what = np.nonzero(bits)
    return hits[who], what


def _near_in(size: int, part: pd.DataFrame) -> pd.DataFrame:
    """Near words of whole blocks of one class, both ways: word, near, near_n."""
    part = part.reset_index(drop=True)
    lengths = part["word"].str.len().to_numpy()
    places = np.unique(part["block"].to_numpy(), return_inverse=True)[1]
    in_index = np.flatnonzero(lengths == size)
    texts, n = part["word"].to_numpy(), part["n"].to_numpy()
    out = []
    if len(in_index):
        index = _letters(texts[in_index].tolist(), size)
        for length in (size, size + 1):
            asking = np.flatnonzero(lengths == length)
            for a in range(0, len(asking), ASKING):
                some = asking[a:a + ASKING]
                who, what = one_error(index, places[in_index], _letters(texts[some].tolist(), length), places[some])
                who, what = some[who], in_index[what]
                out.append((who, what))
                if length > size:
                    out.append((what, who))
    who, what = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in (0, 1))
    return pd.DataFrame({"word": texts[who], "near": texts[what], "near_n": n[what]})


def near_words(vocabulary: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, near, near_n): each pair of words one letter apart, both ways, once. vocabulary: word (letters up to U+00FF), n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Blocks come one after another; small ones of one class share an index, and one that goes on in the next batch waits for its rest.
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < TOGETHER:
                continue
            whole = held["block"].to_numpy() != held["block"].iloc[-1]
            ready, held = held[whole], held[~whole]
            yield from together(ready)
        if held is not None:
            yield from together(held)

    def together(ready: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for size, rows in ready.groupby("size", sort=False):
            blocks = rows["block"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            begin = 0
            for end in [*starts[1:].tolist(), len(rows)]:
                if end == len(rows) or end - begin >= TOGETHER:
                    yield _near_in(int(size), rows.iloc[begin:end])
                    begin = end

    parts = blocks(vocabulary, limit)
    # Blocks of one word have nothing near.
    dealt = parts.repartition("block").sortWithinPartitions("size", "block")
    return dealt.mapInPandas(run, "word string, near string, near_n long").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def spelling_variants(docs: DataFrame, times: int = TIMES, limit: int = BLOCK) -> DataFrame:
    """One row per word of `words`: word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the first in code-point order), if it is at least `times` as frequent, else null, as form_n then is. root: the
    last of the forms that follow from a word, itself if it has none. Every step multiplies n, so forms never run in a circle. A table
    without texts or words gives no rows; other columns than doc_id and text are not read. Words of any length are treated alike.
    """
    vocabulary = staged(words(docs), "vocabulary")
    near = near_words(vocabulary, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    is_form = F.col("best.near_n") >= F.col("n") * times
    judged = staged(vocabulary.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near_n")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round doubles the length of the chains, whose n grows by a factor at each step: few rounds do."""
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = staged(roots.join(further, "root", "left"), "roots")
        if joined.where("next is not null").isEmpty():
            return joined.select("word", "root")
        roots = joined.select("word", F.coalesce("next", "root").alias("root"))
