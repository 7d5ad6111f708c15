"""Quality rules: rule statistics of whole texts, judged by fixed rules and by an isolation forest.

A tree of the forest splits a few hundred rows at random values of random statistics until they stand alone. Rows that stand
alone after few splits are anomalous. The score above which a document is dropped is calibrated from labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import bounded_batches, staged, texts_of, words

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Trees, rows of each, and bins of the score that thresholds are chosen from.
TREES, TREE_ROWS, BINS = 128, 256, 1000
#: Share of the labelled good rows that the threshold may drop.
MAX_LOSS = 0.01
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_distinct", "n_capitals", "n_signs"]


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more in the text."""
    if len(tokens) <= window:
        return 0
    grams = list(zip(*[tokens[k:] for k in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    number: dict[tuple, int] = {}
    ids = np.array([number.setdefault(g, len(number)) for g in grams])
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    tokens = words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    white = int(data[[32, 9, 10, 11, 12, 13]].sum())
    signs = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
    return (
        len(tokens), len(text) - white, int(data[[ord(c) for c in SYMBOLS]].sum()), len(lines) - len(set(lines)), repeated_words(tokens),
        len(lines), len(set(tokens)), int(data[65:91].sum()), signs)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; null is an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in texts_of(batch["text"])], columns=COUNTS)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: pd.DataFrame) -> np.ndarray:
    """What the trees split: shares, so that a text's length matters once only."""
    c = {k: counts[k].to_numpy(float) for k in COUNTS}
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([
        np.log1p(c["n_words"]), chars / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n,
        n / np.maximum(c["n_lines"], 1) ** 0.5 / n ** 0.5, c["n_distinct"] / n ** 0.9, c["n_capitals"] / chars, c["n_signs"] / chars], 1)


@dataclass
class Forest:
    """Complete binary trees as arrays: feature (-1: a leaf), split value, and path length of a leaf, by node."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the expected one: near 1 is anomalous."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(np.log2(len(feature) + 1))):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[every, f] >= split[node]))
            total += path[node]
        return np.exp2(-total / len(self.path) / self.norm)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree over n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest | None:
    """A forest over a sample of rows; None if there are fewer than two."""
    if len(sample) < 2:
        return None
    random, rows = np.random.default_rng(seed), min(rows, len(sample))
    depth = int(np.ceil(np.log2(rows)))
    size = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        held = {0: sample[random.choice(len(sample), rows, replace=False)]}
        for node in range(size):
            own = held.pop(node, None)
            if own is None:
                continue
            level = int(np.log2(node + 1))
            low, high = own.min(0), own.max(0)
            wide = np.flatnonzero(high > low)
            if level == depth or not len(wide):
                path[t, node] = level + expected_path(len(own))
                continue
            f = int(random.choice(wide))
            feature[t, node], split[t, node] = f, random.uniform(low[f], high[f])
            right = own[:, f] >= split[t, node]
            for child, mine in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                if len(mine):
                    held[child] = mine
                else:
                    path[t, child] = level + 1
    return Forest(feature, split, path, expected_path(rows))


def threshold(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> int:
    """The bin from which documents are dropped: most bad rows at a loss of at most `max_loss` of the good ones, and the difference
    of both shares at its largest. `len(good)`: none is dropped, as where no row of either kind is labelled."""
    if not good.sum() or not bad.sum():
        return len(good)
    from_bin = lambda x: x[::-1].cumsum()[::-1] / x.sum()
    lost, caught = from_bin(good), from_bin(bad)
    gain = np.where(lost <= max_loss, caught - lost, 0)
    best = int(gain.argmax())
    return best if gain[best] > 0 else len(good)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, kept, score and bin of every document (doc_id, text), with labels (doc_id, quality 0/1).

    Null and empty texts have no words, so they fail the rules. A document is dropped if it fails the fixed rules or its
    score lies at or above the calibrated threshold; without labelled rows of both kinds only the fixed rules count. Repeated rows
    are judged alike; rows without doc_id have no label; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    counts = staged(text_statistics(docs), "statistics")
    total = counts.count()
    # TREES * TREE_ROWS rows in expectation, drawn by a hash of the id and the counts.
    draw = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1 << 30)) < (TREES * TREE_ROWS << 30) // max(total, 1)
    sample = counts.where(draw).toPandas().sort_values(["doc_id", *COUNTS])
    forest = counts.sparkSession.sparkContext.broadcast(grow_forest(features(sample)))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        grown = forest.value
        rows = features(pd.DataFrame(dict(zip(COUNTS, columns))))
        return pd.Series(grown.scores(rows) if grown else np.zeros(len(rows)))

    scored = counts.withColumn("score", score(*COUNTS)).withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long"), "quality")
    found = scored.select("doc_id", "bin").join(known, "doc_id").groupBy("bin", "quality").agg(F.count("*").alias("n")).collect()  # 2 * BINS rows
    histogram = np.zeros((2, BINS), np.int64)
    for row in found:
        histogram[int(row["quality"] > 0), row["bin"]] += row["n"]
    drop_from = threshold(histogram[1], histogram[0])
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return scored.withColumn("base_failed", failed).select(
        "doc_id", *BASE, "base_failed", (~failed & (F.col("bin") < drop_from)).alias("kept"), "score", "bin")
