"""Toxicity of whole texts, scored after a noisy-channel decoder has restored disguised words.

A disguised word (digits or signs for letters, letters set apart, letters repeated) is a lattice: each character may
stand for itself, for another letter, or for nothing, at a cost. The Viterbi path under a character language model, whose
counts come from all texts of the corpus, is the restored word. A sparse logistic regression scores the
words, and beginnings of words, of the restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import blocks, bounded_batches, codes, staged, texts_of
from waybill.llm.ftrl import FollowTheLeader, softmax, temperature
from waybill.llm.language import fold

#: Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs that stand for a letter behind others, too, where `!` or `(` would be plain punctuation; and one inside a word that hides a vowel.
TRAILING, HIDING, VOWELS = "@$€", "*", "aeiou"
#: What stands between letters that are set apart, one to GAP of them.
BETWEEN, GAP = " .-_*\n\t", 3
#: Costs (negative log) of the channel: a letter written as another sign, one repeated, a sign dropped, a vowel hidden.
SWAP, REPEAT, DROP, HIDE = 1.0, 0.3, 4.0, 2.0

#: Language model: n-grams of this order, hashed to this many counters. A context's counter is that of its n-gram without the last letter.
ORDER, COUNTERS = 4, 1 << 18
ALPHABET = 40
SMOOTH = 4.0

#: The classifier is fitted on at most this many labelled rows (twice that of different texts, where ids repeat) and this many words or beginnings.
LABELLED, WORDS = 20_000, 1 << 16
#: Least log likelihood ratio of a word between both labels; below it chance explains the difference.
LEAST_RATIO = 4.0
PREFIXES = (5, 7)
ROUNDS = 10

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_APART = re.compile(f"[{re.escape(BETWEEN)}]+")


def _symbol(char: str) -> int:
    """a to z by place, other letters by hash, all else the border of a word."""
    return ord(char) - 96 if "a" <= char <= "z" else 27 + ord(char) % (ALPHABET - 27) if char.isalpha() else 0


@lru_cache(1)
def _symbols() -> np.ndarray:
    return np.array([_symbol(chr(c)) for c in range(0x110000)], np.uint8)


@lru_cache(1)
def _swapped() -> np.ndarray:
    """1: a sign that may stand for a letter, 2: a digit that may."""
    out = np.zeros(0x110000, np.uint8)
    for char in LEET:
        out[ord(char)] = 1 + char.isdigit()
    return out


def _counters(rolled: np.ndarray) -> np.ndarray:
    return ((rolled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def gram_totals(texts: list[str], totals: np.ndarray) -> None:
    """Adds the n-grams of the texts, and their contexts, to `totals` (2 rows of COUNTERS)."""
    chars, _ = codes([f"   {t.lower()}   " for t in texts])
    symbols = _symbols()[chars].astype(np.int64)
    if len(symbols) < ORDER:
        return
    context = symbols[:-3] * ALPHABET ** 2 + symbols[1:-2] * ALPHABET + symbols[2:-1]
    ends = symbols[3:] + symbols[2:-1] > 0
    totals[0] += np.bincount(_counters((context * ALPHABET + symbols[3:])[ends]), minlength=COUNTERS)
    totals[1] += np.bincount(_counters(context[ends]), minlength=COUNTERS)


@dataclass
class LetterModel:
    """Costs of a letter after three others, from counts of the corpus."""

    totals: np.ndarray
    known: dict[tuple[int, int, int, int], float] = field(default_factory=dict)

    def cost(self, a: int, b: int, c: int, d: int) -> float:
        found = self.known.get((a, b, c, d))
        if found is None:
            context = (a * ALPHABET + b) * ALPHABET + c
            at, of = _counters(np.array([context * ALPHABET + d, context]))
            p = (self.totals[0][at] + SMOOTH / ALPHABET) / (self.totals[1][of] + SMOOTH)
            found = self.known[a, b, c, d] = -math.log(min(1.0, p))
        return found


def decode(token: str, model: LetterModel, least_run: int = 3) -> str:
    """The best path through the lattice of a disguised word, in which runs of `least_run` equal letters may be repetitions. Paths with the same last three letters are one state, so work is linear in the length."""
    # State: last three symbols and last letter -> (cost, letters so far as a linked list).
    states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, 0, ""): (0.0, None)}
    apart = _APART.split(token)
    if len(apart) > 2 and all(len(c) == 1 for c in apart):
        token = "".join(apart)
    runs = {m[1] for m in _RUN.finditer(token) if len(m[0]) >= least_run}
    for char in token:
        options = [(x, SWAP) for x in LEET.get(char, "")]
        if char.isalpha():
            options.append((char, 0.0))
        elif not options:
            options.append(("", DROP))
            options += [(v, HIDE) for v in VOWELS if char in HIDING]
        new: dict[tuple, tuple[float, tuple | None]] = {}
        for (a, b, c, last), (cost, path) in states.items():
            for letter, extra in options:
                if letter:
                    d = _symbol(letter)
                    key, total = (b, c, d, letter), cost + extra + model.cost(a, b, c, d)
                    if key not in new or total < new[key][0]:
                        new[key] = total, (path, letter)
                if not letter or letter == last and (char in runs or len(options) > 1):
                    total = cost + extra + (REPEAT if letter else 0)
                    key = (a, b, c, last)
                    if key not in new or total < new[key][0]:
                        new[key] = total, path
        states = new
    _, path = min(states.items(), key=lambda x: x[1][0] + model.cost(*x[0][:3], 0))[1]
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def disguised(texts: list[str]) -> list[list[tuple[int, int, bool]]]:
    """Where disguised words may be in texts in lower case, by place: (first, last, sure).

    Sure ones are words with three equal letters in a row, a sign for a letter before a letter, one or two TRAILING signs or a digit behind one, a
    sign that hides a vowel between letters; and three or more single letters set apart by up to GAP separators. Words with a doubled letter
    only may be.
    """
    chars, borders = codes([f"    {t}    " for t in texts])
    letter, swapped = _symbols()[chars] > 0, _swapped()[chars]
    if len(chars) < 9:
        return [[] for _ in texts]
    hiding = np.zeros(len(chars), bool)
    hiding[1:-1] = np.isin(chars[1:-1], [ord(c) for c in HIDING]) & letter[:-2] & letter[2:]
    part = letter | (swapped > 0) | hiding
    hit, doubled = hiding.copy(), np.zeros(len(chars), bool)
    same = letter[:-1] & (chars[:-1] == chars[1:])
    hit[:-2] |= same[:-1] & same[1:]
    doubled[:-1] = same
    # A bracket opens more often than it stands for a letter, but not behind one.
    opens = chars == ord("(")
    opens[1:] &= ~letter[:-1]
    part &= ~opens
    hit[:-1] |= (swapped[:-1] > 0) & ~opens[:-1] & letter[1:]
    hit[1:] |= letter[:-1] & (swapped[1:] == 2)
    trailing = np.isin(chars, [ord(c) for c in TRAILING])
    hit[1:-2] |= letter[:-3] & trailing[1:-2] & ~(trailing[2:-1] & trailing[3:])
    single = np.zeros(len(chars), bool)
    single[1:-1] = part[1:-1] & ~part[:-2] & ~part[2:]
    chain = single.copy()
    for a, b in zip(*_runs(np.isin(chars, [ord(c) for c in BETWEEN]) & ~part)):
        if 0 < a and b < len(chars) and b - a <= GAP and single[a - 1] and single[b]:
            chain[a:b] = True
    first, last = _runs(part)

    def words_with(places: np.ndarray) -> np.ndarray:
        chosen = np.zeros(len(first), bool)
        chosen[np.searchsorted(first, np.flatnonzero(places & part), "right") - 1] = True
        return chosen

    sure = words_with(hit)
    maybe = words_with(doubled) & ~sure
    starts, ends = _runs(chain)
    singles = np.concatenate(([0], np.cumsum(single)))
    long = singles[ends] - singles[starts] >= 3
    spans = np.concatenate([
        np.stack([first[c], last[c], np.full(c.sum(), flag)], 1) for c, flag in ((sure, 1), (maybe, 0))] + [np.stack([starts[long], ends[long], np.ones(long.sum(), int)], 1)])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    out: list[list[tuple[int, int, bool]]] = [[] for _ in texts]
    owner = np.searchsorted(borders, spans[:, 0], "right") - 1
    for i, a, b, flag in zip(owner.tolist(), *(spans[:, :2] - borders[owner][:, None] - 4).T.tolist(), spans[:, 2].tolist()):
        if not out[i] or a >= out[i][-1][1]:
            out[i].append((a, b, bool(flag)))
    return out


def collapsed(word: str) -> str:
    """A word with each run of a letter as one."""
    return _RUN.sub(r"\1", word)


def restore(texts: list[str], model: LetterModel, known: dict[str, str], suspects: dict[str, str] | None = None) -> list[str]:
    """The texts in lower case with their disguised words restored.

    known: words restored before, kept up to a bound. suspects: words that count, by their collapsed form; a word with a doubled letter is decoded
    if it is another way to write one of these.
    """
    texts, suspects = [t.lower() for t in texts], suspects or {}
    out = []
    for a, b in blocks(texts):
        for text, spans in zip(texts[a:b], disguised(texts[a:b])):
            parts, done = [], 0
            for first, last, sure in spans:
                token = text[first:last]
                if not sure and suspects.get(collapsed(token), token) == token:
                    continue
                word = known.get(token)
                if word is None:
                    if len(known) > 100_000:
                        known.clear()
                    word = decode(token, model, 3 if sure else 2)
                    if len(token) <= 64:
                        known[token] = word
                parts += [text[done:first], word]
                done = last
            out.append("".join([*parts, text[done:]]) if parts else text)
    return out


def features(text: str) -> set[str]:
    """The distinct words of a restored text, and their beginnings of PREFIXES letters."""
    found = set(_WORD.findall(text))
    return found.union(*({f"^{w[:k]}" for w in found if len(w) > k} for k in PREFIXES))


def letter_model(docs: DataFrame) -> LetterModel:
    """Counts of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, COUNTERS), np.int64)
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in blocks(texts):
                gram_totals(texts[a:b], totals)
        kind, at = np.nonzero(totals)
        yield pd.DataFrame({"kind": kind, "at": at, "n": totals[kind, at]})

    counted = docs.select("text").mapInPandas(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((2, COUNTERS))  # 2 * COUNTERS rows at most
    totals[counted["kind"], counted["at"]] = counted["n"]
    return LetterModel(totals)


@dataclass
class ToxicityModel:
    letters: LetterModel
    words: dict[str, np.ndarray]
    bias: np.ndarray
    heat: float = 1.0
    known: dict[str, str] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> list[float]:
        out, names = [], self.words.keys()
        suspects = {collapsed(w): w for w in names if w[0] != "^"}
        for text in restore(texts, self.letters, self.known, suspects):
            found = names & features(text)
            # In one order, so that sums of the same words are the same number.
            logits = self.bias + sum((self.words[w] for w in sorted(found)), np.zeros(2))
            out.append(float(softmax(logits / self.heat)[1]))
        return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> ToxicityModel:
    """A model from at most LABELLED labelled rows whose fold isn't `held_out`; the letter model from all texts.

    Words are chosen by their log likelihood ratio between both labels. Without labelled rows, as from empty tables, the score is 0 everywhere, with one label
    only it is that label everywhere. Long texts are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    letters = letter_model(docs)
    draw = F.xxhash64("doc_id")
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where((fold(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(draw, "doc_id", "toxic").limit(LABELLED))
    # LABELLED rows at most. Rows that repeat an id and a text count once.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text", "toxic"])
    shared = spark.sparkContext.broadcast(letters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, str] = {}
        for batch in batches:
            found = [sorted(features(t)) for t in restore(texts_of(batch["text"]), shared.value, seen)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": found})

    bags = staged(rows.mapInPandas(run, "doc_id long, toxic int, words array<string>"), "bags")
    # Different texts under a labelled id may be many; of them a share of their hashes is kept.
    total, space = bags.count(), 1 << 30
    if total > 2 * LABELLED:
        bags = bags.where(F.pmod(F.xxhash64("doc_id", "words"), F.lit(space)) < 2 * LABELLED * space // total)
    sizes = {r["toxic"]: r["n"] for r in bags.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return ToxicityModel(letters, {}, np.array([0.0, -50.0 if not bad else 50.0]))
    p = F.lit(bad / (bad + good))
    counted = bags.select(F.explode("words").alias("word"), (F.col("toxic") > 0).cast("int").alias("y")).groupBy("word").agg(
        F.sum("y").alias("a"), F.count("*").alias("n")).where("n >= 3")
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    a, n = F.col("a"), F.col("n")
    ratio = term(a, n * p) + term(n - a, n * (1 - p))
    chosen = [r["word"] for r in counted.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(WORDS).select("word").collect()]
    place = {w: k for k, w in enumerate(chosen)}
    keep = spark.sparkContext.broadcast(place)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["found"] = [[keep.value[w] for w in ws if w in keep.value] for ws in batch.pop("words")]
            yield batch

    drawn = bags.mapInPandas(narrow, "doc_id long, toxic int, found array<int>").toPandas()
    drawn["found"] = [tuple(sorted(f)) for f in drawn["found"]]
    data = []
    for r in drawn.sort_values(["doc_id", "toxic", "found"]).itertuples():
        at = np.array([*r.found, len(chosen)], np.int64)
        data.append((at, np.ones(len(at)), int(r.toxic > 0)))
    last = np.arange(len(data)) % 5 == 4
    leader = FollowTheLeader(len(chosen) + 1, 2, rate=0.5, l1=2.0, l2=0.1).fit([d for d, c in zip(data, last) if not c], ROUNDS)
    weights = leader.weights()
    model = ToxicityModel(letters, {w: weights[k] for w, k in place.items() if weights[k].any()}, weights[-1])
    others = [d for d, c in zip(data, last) if c]
    if others:
        model.heat = temperature(np.array([v @ weights[r] for r, v, _ in others]), [y for *_, y in others])
    return model


def judge(spark: SparkSession, model: ToxicityModel):
    """A function from a text column to its score from 0 to 1. Only the text is looked at, whole; null and empty texts get the score of a text
    without known words."""
    shared = spark.sparkContext.broadcast(model)  # COUNTERS and WORDS bound it

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts_of(texts)), dtype=float)

    return run


def score_all(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text) with labels (doc_id, toxic); other columns are not read.

    The model comes from the labelled rows that aren't held out. A null doc_id counts as an empty one; repeated rows are judged alike.
    """
    judged = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), judge(docs.sparkSession, train(docs, labels))("text").alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= limit).cast("int"))
