"""Exact search for the largest inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a factor, and large buckets are cut into blocks. Every query
first meets the block of the longest vectors; the k-th best score there is a threshold that its answers must reach.
A query visits only buckets whose longest vector can reach it. Inside a block, the threshold over the query's length
and the block's longest vector is a local cosine threshold: where it is high, candidates are pruned by a coordinate, else by their lengths.
All that is left is verified by full integer products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import staged

SCALE = 64
#: Buckets per doubling of the length; vectors of a block; queries of a block.
PER_DOUBLING, BLOCK, QUERIES = 4, 4096, 1024
#: Local cosine threshold from which a coordinate prunes.
COORDINATE_FROM = 0.7

_LENGTH = "sqrt(aggregate(v, 0D, (s, x) -> s + cast(x as double) * x))"


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, length): components floor(64 * x) as integers, of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").cast("long"), v.alias("v")).withColumn("length", F.expr(_LENGTH))


def _bucket(length: str) -> str:
    """Buckets by length, 0 for zero vectors; the longest have the largest numbers."""
    return f"cast(case when {length} >= 1 then 1 + floor(log2({length}) * {PER_DOUBLING}) else 0 end as int)"


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    if all(len(v) == dim for v in vectors):
        return np.array(vectors.tolist(), np.int64).reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows, by the narrowest arithmetic that is exact for their size."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    for bound, kind in ((2 ** 24, np.float32), (2 ** 53, np.float64)):
        if most < bound:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if most >= 2 ** 63:
        raise OverflowError("an inner product may not fit a 64-bit integer")
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _unpack(row, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{name}_rows"], row[f"{name}_kind"]).reshape(len(ids), -1).astype(np.int64)


def _pack(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes, str]:
    kind = next(k for k in ("int8", "int16", "int32", "int64") if len(rows) == 0 or rows.size == 0 or (
        rows.min() >= np.iinfo(k).min and rows.max() <= np.iinfo(k).max))
    return ids.astype(np.int64).tobytes(), rows.astype(kind).tobytes(), kind


def _coordinate_places(query: np.ndarray, rows: np.ndarray, units: np.ndarray, local: float) -> np.ndarray:
    """Rows whose value at the query's largest coordinate lets the cosine be `local` or more."""
    query = query.astype(float)
    size = np.sqrt(query @ query)
    focus = int(np.abs(query).argmax())
    rest = query.copy()
    rest[focus] = 0
    # Signs are turned so that x > 0; sqrt(1 - x^2) comes from the other coordinates, as the difference loses digits where x is nearly 1.
    x, y = abs(query[focus]) / size, units[:, focus] * np.sign(query[focus])
    slack = np.sqrt(max(0.0, 1 - local * local)) * np.sqrt(rest @ rest) / size + 1e-9
    # The cosine is at most x * y + sqrt(1 - x^2) * sqrt(1 - y^2), the cosine of the difference of two angles. It is local or more from
    # x * local - slack on; up to x * local + slack where the query is further from its axis than the threshold allows, else up to the axis itself.
    upper = np.inf if x >= local else x * local + slack
    return np.flatnonzero((y >= x * local - slack) & (y <= upper))


def search_block(queries: pd.DataFrame, matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, k: int) -> list[tuple]:
    """Answers (row of the query, vec_id, score) of one block. queries: vec_id, length, least (score to reach, or -inf)."""
    found = []
    longest = float(lengths.max(initial=0))
    order = np.argsort(-lengths, kind="stable")
    ids, rows, lengths = ids[order], rows[order], lengths[order]
    units = rows / np.maximum(lengths, 1e-300)[:, None]
    own, least, size = (queries[c].to_numpy() for c in ("vec_id", "least", "length"))
    reach = size * longest
    local = np.where((least > 0) & (reach > 0), least / np.maximum(reach, 1e-300), np.where(least > reach, 2.0, -1.0))
    by_length = []
    for q in np.flatnonzero(local <= 1 + 1e-9):
        # A length's cosine threshold is the higher the shorter it is, so the block's holds for all.
        if local[q] >= COORDINATE_FROM and matrix.shape[1] == rows.shape[1]:
            at = _coordinate_places(matrix[q], rows, units, float(local[q]) - 1e-9)
            scores = products(matrix[q:q + 1], rows[at])[0]
            found += _answers(q, own[q], least[q], ids[at], scores, k)
        else:
            by_length.append(q)
    for first in range(0, len(by_length), 256):
        part = np.array(by_length[first:first + 256])
        # Vectors stand by length, the longest first: those too short for all of these queries are the last.
        needed = np.where((least[part] > 0) & (size[part] > 0), least[part] / np.maximum(size[part], 1e-300), 0.0) * (1 - 1e-9)
        n = int(np.searchsorted(-lengths, -needed.min(), "right"))
        scores = products(matrix[part], rows[:n])
        for q, line in zip(part, scores):
            found += _answers(q, own[q], least[q], ids[:n], line, k)
    return found


def _answers(q: int, own: int, least: float, ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    at = np.flatnonzero((scores >= least) & (ids != own))
    at = at[best(scores[at], ids[at], k)]
    return [(int(q), i, s) for i, s in zip(ids[at].tolist(), scores[at].tolist())]


def top_products(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by `every`; rows with the query's vec_id are its own and no candidates. Vectors that
    are null, or hold null or non-finite components, take no part, nor do rows without vec_id. Repeated rows are candidates each; a repeated query is
    answered once, and queries with one vec_id but different vectors once each. Vectors of fewer components
    end in zeros. Fewer than k other rows give them all; an empty table gives no rows.
    """
    # Of rows that repeat an id and a vector no more than k can be in an answer; they are folded before they meet.
    folded = scaled(embeddings).groupBy("vec_id", "v", "length").agg(F.count("*").alias("copies"))
    each = folded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))).drop("copies", "copy")
    vectors = staged(each.withColumn("bucket", F.expr(_bucket("length"))), "vectors")
    sizes = vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))
    cut = vectors.join(sizes, "bucket").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / BLOCK)).cast("int"))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in range(0, len(group), 2 * BLOCK):
            part = group.iloc[a:a + 2 * BLOCK]
            rows = _matrix(part["v"], int(group["dim"].max()))
            out.append((key[0], int(key[1]), float(part["length"].max()), *_pack(part["vec_id"].to_numpy(), rows)))
        return pd.DataFrame(out, columns=["bucket", "block", "longest", "c_ids", "c_rows", "c_kind"])

    blocks = staged(cut.select("bucket", "block", "vec_id", "v", "length", "dim").groupBy("bucket", "block").applyInPandas(
        pack, "bucket int, block int, longest double, c_ids binary, c_rows binary, c_kind string"), "blocks")
    # One block of the longest vectors, 2 * BLOCK rows at most.
    head = blocks.orderBy(F.desc("bucket"), "block", "c_ids").limit(1).collect()
    if not head:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = embeddings.sparkSession.sparkContext.broadcast(_unpack(head[0].asDict(), "c"))

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = first.value
        for batch in batches:
            matrix = _matrix(batch["v"], int(batch["v"].str.len().max() or 0)) if len(batch) else np.zeros((0, 0), np.int64)
            least = np.full(len(batch), -np.inf)
            for a in range(0, len(batch), 256):
                for q, line in enumerate(products(matrix[a:a + 256], rows), a):
                    others = line[ids != batch["vec_id"].iloc[q]]
                    if len(others) >= k:
                        least[q] = np.partition(others, len(others) - k)[len(others) - k]
            yield batch.assign(least=least)

    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v", "length").dropDuplicates(["vec_id", "v"])
    queries = queries.mapInPandas(thresholds, "vec_id long, v array<long>, length double, least double")
    # The lowest bucket whose vectors can reach the threshold; queries of one block share it.
    needed = "case when least > 0 and length > 0 then least / length * (1 - 1e-9) else 0D end"
    queries = queries.withColumn("lowest", F.expr(_bucket(f"({needed})")))
    shares = queries.groupBy("lowest").agg(F.count("*").alias("n"))
    dealt = queries.join(shares, "lowest").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / QUERIES)).cast("int"))

    def pack_queries(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(group["v"], int(group["v"].str.len().max()))
        extra = group["length"].to_numpy().tobytes(), group["least"].to_numpy().tobytes()
        return pd.DataFrame([(*key, *_pack(group["vec_id"].to_numpy(), rows), *extra)],
                            columns=["lowest", "part", "q_ids", "q_rows", "q_kind", "q_length", "q_least"])

    asked = staged(dealt.select("lowest", "part", "vec_id", "v", "length", "least").groupBy("lowest", "part").applyInPandas(
        pack_queries, "lowest int, part int, q_ids binary, q_rows binary, q_kind string, q_length binary, q_least binary"), "queries")
    # Blocks of queries meet the blocks of the buckets they can use: an equi-join on bucket and block, so that lengths that are all alike are still
    # as many keys as blocks. There are few buckets, as lengths double.
    used = [(r["bucket"], r["blocks"]) for r in blocks.groupBy("bucket").agg((F.max("block") + 1).alias("blocks")).orderBy("bucket").collect()]
    known = F.array(*[F.struct(F.lit(b).alias("bucket"), F.sequence(F.lit(0), F.lit(n - 1)).alias("blocks")) for b, n in used])
    met = asked.withColumn("met", F.explode(F.filter(known, lambda b: b["bucket"] >= F.col("lowest"))))
    met = met.select(*asked.columns, F.col("met.bucket").alias("bucket"), F.explode("met.blocks").alias("block"))
    # Few bytes stand for much work here, which is not to be merged into few tasks.
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.repartition(tasks, "bucket", "block").join(blocks.repartition(tasks, "bucket", "block"), ["bucket", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                q_ids, q_rows = _unpack(row, "q")
                c_ids, c_rows = _unpack(row, "c")
                queries = pd.DataFrame({"vec_id": q_ids, "length": np.frombuffer(row["q_length"]), "least": np.frombuffer(row["q_least"])})
                lengths = np.sqrt((c_rows.astype(float) ** 2).sum(1))
                found = search_block(queries, q_rows, c_ids, c_rows, lengths, k)
                out = pd.DataFrame(found, columns=["q", "vec_id", "score"])
                yield pd.DataFrame({
                    "query_id": q_ids[out["q"].to_numpy(np.int64)], "query": [hash_of(q_rows[i]) for i in out["q"]],
                    "vec_id": out["vec_id"].to_numpy(np.int64), "score": out["score"].to_numpy(np.int64)})

    found = pairs.mapInPandas(search, "query_id long, query long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("cast(row_number() over (partition by query_id, query order by score desc, vec_id) as int)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(row: np.ndarray) -> int:
    """Tells vectors of one vec_id apart, whatever zeros they end in."""
    import zlib

    return zlib.crc32(np.trim_zeros(row, "b").tobytes())


def oracle(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL for `top_products` of the table embeddings."""
    return f"""
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select distinct vec_id, v from vectors where vec_id % {every} = 0) q join vectors c on q.vec_id <> c.vec_id),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from placed where rank <= {k}"""
