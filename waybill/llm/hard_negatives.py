"""Hard negatives from an inverted multi-index: rows of another label that are nearly as close to an anchor as its positives.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. A row's product with an anchor is the sum
of the products of the halves, and that of a half is at most the product with its codeword plus the anchor's half length times the
codeword's radius (the largest distance of a row from it). An anchor sorts the codewords of both halves by these bounds, and a
heap over the two sorted lists (multi-sequence) names the cells by falling sum of the half bounds. As soon as the next sum is
below the scores an anchor still needs, all cells left are certified to hold none of them, and the walk stops.

Walks go in two steps: the first cells up to PROBE rows give scores to beat, then the walk goes on to where it is certified. This is done
once for the positives and once for the negatives, whose scores must lie in a window below each positive's. Codebooks are fitted on a bounded
sample of rows (SAMPLE); they decide how much is visited, never the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import staged
from waybill.llm.inner_products import products

#: Rows the codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Codewords of a half: as many as give cells of about BLOCK rows, within these limits.
FEWEST_CODES, MOST_CODES = 4, 64
#: Rows of a block (a large cell has several), anchors that walk together, and rows of the first cells.
BLOCK, ANCHORS, PROBE = 4096, 512, 8192

_BLOCKS = "cell int, block int, ids binary, labels binary, rows binary, width int"
_CHUNK = "chunk int, anchor_id binary, copy binary, label binary, v binary, low binary, high binary"
_FOUND = "anchor_id long, copy int, target int, vec_id long, score long"


def scaled(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x) as integers, of the rows that take part, each once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return whole.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")).distinct()


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


class Codebooks:
    """Two codebooks, one for each half of the components."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.dim = sample.shape[1]
        self.cut = self.dim // 2
        self.words = [fit(half, codes) for half in self.halves(sample)]

    def halves(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, :self.cut].astype(float), rows[:, self.cut:].astype(float)]

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and its distance from the codeword in each half."""
        found = [nearest(half, words) for half, words in zip(self.halves(rows), self.words)]
        return found[0][0] * len(self.words[1]) + found[1][0], [d for _, d in found]

    def bounds(self, anchors: np.ndarray, radii: list[np.ndarray]) -> list[np.ndarray]:
        """For each half, the most that a row under each codeword can add to an anchor's score."""
        out = []
        for half, words, radius in zip(self.halves(anchors), self.words, radii):
            reach = half @ words.T + np.sqrt((half ** 2).sum(1))[:, None] * radius
            out.append(reach + 1e-9 * np.abs(reach) + 1e-6)
        return out


def nearest(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 4096):
        code[a:a + 4096] = (rows[a:a + 4096] @ words.T - 0.5 * (words ** 2).sum(1)).argmax(1)
    return code, np.sqrt(((rows - words[code]) ** 2).sum(1))


def fit(rows: np.ndarray, codes: int) -> np.ndarray:
    """Codewords by k-means; starts at rows spread over the sample's order. Fewer distinct rows give fewer words."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= codes:
        return distinct
    words = distinct[np.linspace(0, len(distinct) - 1, codes).astype(int)]
    for _ in range(ROUNDS):
        code, _ = nearest(rows, words)
        sums = np.zeros_like(words)
        np.add.at(sums, code, rows)
        n = np.bincount(code, minlength=len(words))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


class Directory:
    """What is known of every cell: rows and blocks; and of every codeword: its radius. Its size is that of the codebooks."""

    def __init__(self, cells: pd.DataFrame, books: Codebooks) -> None:
        self.books, n = books, [len(w) for w in books.words]
        self.rows, self.blocks = np.zeros(n[0] * n[1], np.int64), np.zeros(n[0] * n[1], np.int64)
        self.rows[cells["cell"]], self.blocks[cells["cell"]] = cells["n"], cells["blocks"]
        grid = np.zeros((2, n[0] * n[1]))
        grid[:, cells["cell"]] = cells[["far_1", "far_2"]].to_numpy().T
        grid = grid.reshape(2, *n)
        self.radii = [grid[0].max(1), grid[1].max(0)]

    def walk(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, float]]:
        """Cells that hold rows, with the sum of their half bounds, by falling sum."""
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap, seen = [(-(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = int(a[i]) * len(two) + int(b[j])
            if self.rows[cell]:
                yield cell, -bound
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(one[a[i]] + two[b[j]]), i, j))

    def visits(self, anchors: np.ndarray, least: np.ndarray, probing: bool) -> dict[int, list[int]]:
        """Cells to visit, each with the anchors that do: the first ones up to PROBE rows, or those after them up to the certified end.

        Cells whose bound is below an anchor's `least` score hold nothing it needs.
        """
        wanted: dict[int, list[int]] = {}
        one, two = self.books.bounds(anchors, self.radii)
        for k in range(len(anchors)):
            seen = 0
            for cell, bound in self.walk(one[k], two[k]):
                if bound < least[k] or (probing and seen >= PROBE):
                    break
                if probing or seen >= PROBE:
                    wanted.setdefault(cell, []).append(k)
                seen += int(self.rows[cell])
        return wanted


class Index:
    """Inverted multi-index over the rows of a table, in blocks: a table, and a directory of bounded size."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.dim = shape["n"], max(shape["dim"] or 0, 2)
        dim = self.dim
        codes = int(np.clip(np.ceil(np.sqrt(self.n / BLOCK)), FEWEST_CODES, MOST_CODES))
        # Rows are distinct, so a share of their hashes is about that share of them, whatever the partitions; the order makes the fit repeatable.
        space = 1 << 30
        drawn = rows.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(space)) < min(space, SAMPLE * space // max(1, self.n)))
        sample = drawn.limit(2 * SAMPLE).select("v", "vec_id", "label").toPandas().sort_values(["vec_id", "label"], kind="stable")["v"]
        books = Codebooks(_matrix(sample, dim), codes)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell, far = books.place(_matrix(batch["v"], dim))
                yield batch.assign(cell=cell, far_1=far[0], far_2=far[1])

        placed = staged(rows.mapInPandas(place, "vec_id long, label long, v array<long>, cell int, far_1 double, far_2 double"), "cells")
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_1").alias("far_1"), F.max("far_2").alias("far_2"))
        cells = staged(cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "directory")
        self.directory = Directory(cells.toPandas(), books)
        self.placed = placed
        # A cell that holds a third of all rows is as many blocks as its size asks for.
        dealt = placed.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn(  # a row per cell, at most MOST_CODES squared
            "block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("blocks")).cast("int"))

        def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id", kind="stable")
            matrix = _matrix(group["v"], dim)
            kind = _narrowest(matrix)
            out = (int(key[0]), int(key[1]), group["vec_id"].to_numpy(np.int64).tobytes(), group["label"].to_numpy(np.int64).tobytes(), matrix.astype(kind).tobytes(), np.dtype(kind).itemsize)
            return pd.DataFrame([out], columns=["cell", "block", "ids", "labels", "rows", "width"])

        self.blocks = staged(dealt.select("cell", "block", "vec_id", "label", "v").groupBy("cell", "block").applyInPandas(pack, _BLOCKS), "blocks")

    def chunks(self, anchors: DataFrame) -> DataFrame:
        """Anchors (anchor_id, copy, label, v, low, high: windows of scores, one per target) packed by neighbouring cells, so that they walk alike."""
        dim = self.dim
        sizes = anchors.groupBy("cell").agg(F.ceil(F.count("*") / ANCHORS).alias("parts"))
        dealt = anchors.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("anchor_id", "copy"), F.col("parts")).cast("int"))

        def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            longs = [group[c].to_numpy(np.int64).tobytes() for c in ("anchor_id", "copy", "label")]
            windows = [np.array(group[c].tolist(), np.float64).tobytes() for c in ("low", "high")]
            out = (int(key[0]), *longs, _matrix(group["v"], dim).tobytes(), *windows)
            return pd.DataFrame([out], columns=["chunk", "anchor_id", "copy", "label", "v", "low", "high"])

        return staged(dealt.groupBy("cell", "part").applyInPandas(pack, _CHUNK), "anchors")

    def search(self, chunks: DataFrame, k: int, same: bool, probing: bool) -> DataFrame:
        """(anchor_id, copy, target, vec_id, score): for each anchor and window of scores, what the visited cells hold of its k best rows.

        `same` asks for rows of the anchor's label, else for those of others.
        """
        directory, dim = self.directory, self.dim

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    anchors = _Anchors(row, dim)
                    out = []
                    for cell, at in directory.visits(anchors.v, anchors.low.min(1, initial=np.inf), probing).items():
                        packed = anchors.some(np.array(at)).packed()
                        out += [(cell, b, *packed) for b in range(directory.blocks[cell])]
                        if len(out) >= 16:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=columns)

        columns = ["cell", "block", "anchor_id", "copy", "label", "v", "low", "high"]
        asked = chunks.mapInPandas(walk, _CHUNK.replace("chunk int", "cell int, block int"))
        # Blocks are of equal size, so they are dealt by number; small bytes stand for much work, which is not to be merged into few tasks.
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = asked.repartition(tasks, "cell", "block").join(self.blocks.repartition(tasks, "cell", "block"), ["cell", "block"])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    yield best_in_block(_Anchors(row, dim), row, dim, k, same)

        found = pairs.select(*columns[2:], "ids", "labels", "rows", "width").mapInPandas(score, _FOUND)
        return best(found, k)


class _Anchors:
    """Anchors of one packed row."""

    def __init__(self, row: dict | None, dim: int) -> None:
        if row:
            self.ids, self.copy, self.label = (np.frombuffer(row[c], np.int64) for c in ("anchor_id", "copy", "label"))
            self.v = np.frombuffer(row["v"], np.int64).reshape(len(self.ids), dim)
            self.low, self.high = (np.frombuffer(row[c], np.float64).reshape(len(self.ids), -1) for c in ("low", "high"))

    def some(self, at: np.ndarray) -> _Anchors:
        out = _Anchors(None, 0)
        for name in ("ids", "copy", "label", "v", "low", "high"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def packed(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.ids, self.copy, self.label, self.v, self.low, self.high))


def _narrowest(matrix: np.ndarray) -> str:
    low, high = matrix.min(initial=0), matrix.max(initial=0)
    return next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def best_in_block(anchors: _Anchors, block: dict, dim: int, k: int, same: bool) -> pd.DataFrame:
    """The k best rows of a block for each anchor and window: highest scores, ties to smaller ids (rows stand by id)."""
    ids, labels = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels"))
    rows = np.frombuffer(block["rows"], f"int{8 * block['width']}").reshape(len(ids), dim).astype(np.int64)
    out = []
    for a in range(0, len(anchors.ids), 128):
        part = anchors.some(np.arange(a, min(a + 128, len(anchors.ids))))
        scores = products(part.v, rows)
        alike = part.label[:, None] == labels[None, :]
        fit = (alike if same else ~alike) & (part.ids[:, None] != ids[None, :])
        for target in range(part.low.shape[1]):
            usable = fit & (scores >= part.low[:, target, None]) & (scores <= part.high[:, target, None])
            for q in np.flatnonzero(usable.any(axis=1)):
                at = np.flatnonzero(usable[q])
                line = scores[q, at]
                if len(at) > k:
                    kept = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
                    at, line = at[kept], line[kept]
                order = np.argsort(-line, kind="stable")[:k]
                out.append((part.ids[q], part.copy[q], target, ids[at[order]], line[order]))
    sizes = [len(o[3]) for o in out]
    flat = lambda c, empty: np.concatenate([o[c] for o in out]) if out else np.zeros(0, empty)
    each = lambda c: np.repeat([o[c] for o in out], sizes) if out else np.zeros(0, np.int64)
    return pd.DataFrame({"anchor_id": each(0), "copy": each(1), "target": each(2), "vec_id": flat(3, np.int64), "score": flat(4, np.int64)})


def best(found: DataFrame, k: int) -> DataFrame:
    place = F.expr("row_number() over (partition by anchor_id, copy, target order by score desc, vec_id)")
    return found.withColumn("place", place).where(F.col("place") <= k)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """The k-th best score of each anchor and target that has as many."""
    return found.where(F.col("place") == k).select("anchor_id", "copy", "target", F.col("score").alias("kth"))


def hard_negatives(
    embeddings: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`. A row's score is its integer product with the anchor, components being
    floor(scale * x). An anchor's positives are the first rows of its label, its negatives for a positive the first rows of other labels with
    least_percent * positive_score <= 100 * negative_score <= 100 * positive_score (none where the positive's score is negative);
    first by score, ties by smaller vec_id. Rows with the anchor's vec_id are its own and no candidates.

    Rows without vec_id, label or vector, or with null or non-finite components, take no part. Repeated rows (equal vec_id, label and
    vector) count once; rows that share a vec_id only are rows of their own, and as anchors are answered each. Vectors of fewer components end in zeros.
    Fewer rows than asked for give them all, an empty table gives no rows. Other columns are not read. A product beyond 64 bits fails.
    """
    rows = staged(scaled(embeddings, scale), "vectors")
    if rows.isEmpty():
        return embeddings.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index(rows)
    copies = F.expr("cast(row_number() over (partition by vec_id order by label, v) as int)")
    anchors = index.placed.where(F.col("vec_id") % every == 0).withColumn("copy", copies).select(
        F.col("vec_id").alias("anchor_id"), "copy", "label", "v", "cell")
    anchors = staged(anchors, "anchors")
    ends = [F.array(F.lit(x)).cast("array<double>") for x in (float("-inf"), float("inf"))]

    near = _searched(index, anchors.withColumns({"low": ends[0], "high": ends[1]}), positives, True)
    near = staged(near.select("anchor_id", "copy", F.col("place").alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Windows of an anchor, one per positive; missing ones are empty. Scores are whole, so the lower end is rounded up.
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * least_percent / 100).cast("double")
    windows = near.groupBy("anchor_id", "copy").agg(F.sort_array(F.collect_list(F.struct("target", low.alias("low"), F.col("positive_score").cast("double").alias("high")))).alias("w"))
    filled = lambda name, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[name], F.lit(empty)))
    asking = anchors.join(windows, ["anchor_id", "copy"]).withColumns({"low": filled("low", float("inf")), "high": filled("high", float("-inf"))}).drop("w")
    far = _searched(index, asking, negatives, False).withColumn("target", F.col("target") + 1)
    return near.join(far, ["anchor_id", "copy", "target"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _searched(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each anchor and window in the whole index: the first cells, then all up to the certified end."""
    first = staged(index.search(index.chunks(anchors), k, same, probing=True), "first-cells")
    # Where k rows are known, only scores that reach the k-th are still needed.
    known = _kth(first, k).groupBy("anchor_id", "copy").agg(F.map_from_entries(F.collect_list(F.struct("target", "kth"))).alias("kth"))
    raised = F.transform("low", lambda low, i: F.greatest(low, F.coalesce(F.col("kth")[i].cast("double"), low)))
    further = anchors.join(known, ["anchor_id", "copy"], "left").withColumn("low", raised).drop("kth")
    rest = index.search(index.chunks(further), k, same, probing=False)
    return best(first.drop("place").unionByName(rest.drop("place")), k)


def oracle(scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, label: str = "label") -> str:
    """DuckDB SQL for `hard_negatives` of the table embeddings."""
    return f"""
with vectors as (
  select distinct vec_id, {label} as label, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as alike, list_inner_product(q.v, c.v)::bigint as score
  from (select * from vectors where vec_id % {every} = 0) q join vectors c on q.vec_id <> c.vec_id),
near as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {positives})
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from near join scored using (anchor_id)
where not alike and {least_percent} * positive_score <= 100 * score and score <= positive_score
qualify rank <= {negatives}"""
