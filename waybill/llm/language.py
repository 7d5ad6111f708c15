"""Language of whole texts: sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams.

Document frequencies are counted over all rows that may be learned from. Weights are learned from a bounded sample of each
language, then a temperature is fitted on other rows. Runs of characters that are no letters count as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import blocks, bounded_batches, codes, texts_of
from waybill.llm.ftrl import FollowTheLeader, softmax, temperature

UNKNOWN = "und"
#: n-grams are hashed to this many features; the last feature is the constant.
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Rows that weights and temperature are learned from: at most about this many per language, and in all.
PER_LANGUAGE, IN_ALL = 1500, 24_000
ROUNDS = 3
#: Stretches of a calibration row that the temperature is fitted on, and their characters (from, below).
WINDOWS, WINDOW = 3, (6, 40)
#: n-grams count as known if this share of all learned rows has them. A text is familiar if its share of known n-grams is SLACK times that which
#: all but OUTSIDE of the calibration rows exceed.
KNOWN_FROM, OUTSIDE, SLACK = 0.002, 0.005, 0.9


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the features it has, ascending, and how often; none without a letter."""
    chars, borders = codes([f" {t.lower()} " for t in texts])
    solid = _letters()[chars]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[borders[:-1]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))[borders]
    chars = np.where(solid, chars, np.uint32(32))[keep]
    hashes, rolled = [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[:len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1:]
        if n in ORDERS:
            x = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            hashes.append((n, (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)))
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a < 2:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        counts = np.bincount(np.concatenate([h[a:max(a, b - n + 1)] for n, h in hashes]), minlength=FEATURES)
        found = np.flatnonzero(counts)
        yield found, counts[found]


def tf_idf(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of unit length and the constant."""
    values = (1 + np.log(counts)) * idf[found]
    values = values / max(1e-9, float(np.sqrt(values @ values)))
    return np.append(found, FEATURES).astype(np.int32), np.append(values, 1.0).astype(np.float32)


def known_share(found: np.ndarray, counts: np.ndarray, known: np.ndarray) -> float:
    """The share of a text's n-grams that the learned languages have."""
    return float(counts[known[found]].sum() / counts.sum())


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float = 1.0
    known: np.ndarray | None = None
    least_known: float = 0.0

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows, values = tf_idf(found, counts, self.idf)
        return values @ self.weights[rows]

    def predict(self, texts: list[str]) -> pd.DataFrame:
        names, scores, familiar = [], [], []
        for a, b in blocks(texts):
            for found, counts in gram_counts(texts[a:b]):
                if len(found) and self.languages:
                    p = softmax(self.logits(found, counts) / self.heat)
                    best = int(p.argmax())
                    names.append(self.languages[best])
                    scores.append(float(p[best]))
                    familiar.append(known_share(found, counts, self.known) >= self.least_known)
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    familiar.append(False)
        return pd.DataFrame({"lang_pred": names, "score": scores, "familiar": familiar})


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _document_frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each feature is, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in blocks(texts):
                for found, _ in gram_counts(texts[a:b]):
                    seen[found] += 1
                    seen[FEATURES] += 1
        rows = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": rows, "n": seen[rows]})

    counted = learn.select("text").mapInPandas(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, np.int64)
    for row in counted.collect():  # FEATURES + 1 rows at most
        out[row["feature"]] = row["n"]
    return out[:FEATURES], int(out[FEATURES])


def train(docs: DataFrame, folds: int = 5, held_out: int = 0) -> LanguageModel:
    """A model from text and lang of the rows whose fold isn't `held_out` and whose lang and text aren't null.

    Temperature and the limit of familiar texts are fitted on the fold after it. Without any such row the model knows no language.
    """
    bounded_batches(docs.sparkSession)
    part = fold(F.col("doc_id"), folds)
    learn = docs.select("text", "lang", part.alias("part"), F.xxhash64("doc_id", "lang", "text").alias("draw")).where(
        (part != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones(FEATURES), np.zeros((FEATURES + 1, 0)), known=np.zeros(FEATURES, bool))
    n_with, total = _document_frequencies(learn)
    idf = np.log((1 + total) / (1 + n_with)) + 1
    known = n_with >= np.maximum(2, KNOWN_FROM * total)

    per_language = max(50, min(PER_LANGUAGE, IN_ALL // len(languages)))
    space = 1 << 30
    shares = F.create_map([x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(space, per_language * space // n)))])
    sample = learn.where(F.pmod("draw", F.lit(space)) < shares[F.col("lang")])

    calibration = (held_out + 1) % folds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, parts = texts_of(batch["text"]), batch["part"].to_numpy()
            for a, b in blocks(texts):
                out = []
                for k, (found, counts) in zip(range(a, b), gram_counts(texts[a:b])):
                    if not len(found):
                        continue
                    key = batch["draw"].iloc[k], batch["lang"].iloc[k]
                    if parts[k] != calibration:
                        out.append((*key, False, 0.0, *(x.tobytes() for x in tf_idf(found, counts, idf))))
                        continue
                    share = known_share(found, counts, known)
                    for window, few in gram_counts(windows(texts[k], int(key[0]))):
                        if len(window):
                            out.append((*key, True, share, *(x.tobytes() for x in tf_idf(window, few, idf))))
                yield pd.DataFrame(out, columns=["draw", "lang", "calibrates", "share", "found", "values"])

    label = {name: k for k, name in enumerate(languages)}
    # The bounded sample as rows of bytes in one Arrow table, which the arrays below only look into.
    held = sample.mapInPandas(run, "draw long, lang string, calibrates boolean, share double, found binary, values binary").toArrow()
    keys = sorted(zip(held["draw"].to_pylist(), held["lang"].to_pylist(), held["calibrates"].to_pylist(), range(held.num_rows)))
    found, values, share = (held[c] for c in ("found", "values", "share"))
    bytes_of = lambda column, k, kind: np.frombuffer(column[k].as_buffer(), kind)
    rows = [(bytes_of(found, k, np.int32), bytes_of(values, k, np.float32), label[lang]) for _, lang, calibrates, k in keys if not calibrates]
    leader = FollowTheLeader(FEATURES + 1, len(languages)).fit(rows, ROUNDS)
    model = LanguageModel(languages, idf, leader.weights().astype(np.float32), known=known)
    others = [(k, label[lang]) for _, lang, calibrates, k in keys if calibrates]
    if others:
        logits = np.array([bytes_of(values, k, np.float32) @ model.weights[bytes_of(found, k, np.int32)] for k, _ in others])
        model.heat = temperature(logits, [y for _, y in others])
        model.least_known = SLACK * float(np.quantile([share[k].as_py() for k, _ in others], OUTSIDE))
    return model


def windows(text: str, draw: int) -> list[str]:
    """A few short stretches of a text, their places drawn from `draw`. On whole texts a model errs too seldom for its confidence to be told."""
    r = np.random.default_rng(draw & 0xFFFFFFFF)
    sizes = r.integers(*WINDOW, WINDOWS)
    return [text[a:a + n] for a, n in zip((r.random(WINDOWS) * np.maximum(1, len(text) - sizes)).astype(int).tolist(), sizes.tolist())]


def judge(spark: SparkSession, model: LanguageModel):
    """A function from a text column to a struct of lang_pred, score and familiar. Only the text is looked at, whole.

    lang_pred is `und`, score 0 and familiar false where the text is null, has no letter, or the model knows no language; of languages with one score the
    first by name is named. familiar is false for texts made of n-grams that none of the languages has. Very long texts are worked whole, in blocks of
    texts; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)  # FEATURES + 1 rows by the number of languages

    @F.pandas_udf("lang_pred string, score double, familiar boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts_of(texts))

    return run


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text, lang; other columns are not read), from a model of
    the rows that aren't held out. A null doc_id counts as an empty one, which is held out. Repeated rows are judged alike."""
    judged = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), judge(docs.sparkSession, train(docs))("text").alias("judged"))
    return judged.select("doc_id", "held_out", "judged.lang_pred", "judged.score")
