"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them.

A text's set is that of its `width`-word shingles. Texts with equal sets are one node (128-bit digest of the set), so groups
of copies fold before anything else happens. Nodes that agree in all `ROWS` minima of a band share a bucket.
No bucket is expanded into all its pairs:

1. each node is compared with the smallest node (hub) of its buckets, first with one hub, then with the other hubs that it
   isn't connected with yet;
2. what is left are buckets over more than one component. Their nodes' sketches are compared block by block inside the
   tasks; nodes with a close partner in another component come back with their full sets, and the tasks
   return only links that join components. So what is emitted grows with the nodes, never with their pairs.

An odd sketch is a bitmap of parities: each MinHash sample (the smallest hash of each of `SAMPLES` equal ranges) flips one bit, so samples
that two documents share cancel out in the XOR of their bitmaps. The bits left over estimate the number of
samples that differ. A pair is dropped only if it is `SIGMAS` standard deviations short of the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import blocks, bounded_batches, mix, staged, texts_of
from waybill.llm.components import components

#: A pair at a similarity of 0.8 shares no bucket with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 24, 4
SAMPLES, BITS = 1024, 1024
SIGMAS = 5.0
#: Nodes of a bucket whose sketches meet in one task; larger buckets are cut into pairs of blocks.
BLOCK = 512
#: Bits of the map of documents whose sets are needed, 1 MB; what it lets through in excess is dropped by a join.
FILTER_BITS = 1 << 23

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
# Fixed value: the key of the word hashes. Executors must agree on it.
_KEY = b"near-duplicates"
#: Words whose hashes a Python worker keeps.
MAX_WORDS = 1 << 17


class _WordHashes(dict):
    """64-bit keyed hashes of words; what a Python worker has met is kept, up to MAX_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        return n


_HASHES = _WordHashes()


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer than `width` words is one shingle, without words none."""
    out = []
    for text in texts:
        # bytes.lower() turns A-Z only, bytes.split() parts at exactly the white space of WORD.
        named = text.encode("utf-8", "surrogatepass").lower().split()
        words = np.fromiter(map(_HASHES.__getitem__, named), np.uint64, len(named))
        size = min(width, len(words))
        rolled = words[:len(words) - size + 1].copy() if size else words
        for k in range(1, size):
            rolled = rolled * _STEP + words[k:k + len(rolled)]
        # A whole text of fewer words is never a shingle of another length.
        out.append(np.unique(mix(rolled if size == width else rolled ^ np.uint64(size))) if size else words)
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def buckets(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[k:k + 2048, None] * _FACTORS + _SHIFTS).min(0), out=least)
    band = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        band = mix(band * _STEP + row)
    return band.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[int, bytes]:
    """The number of MinHash samples, and the bitmap of their parities."""
    ranges = shingles >> np.uint64(64 - (SAMPLES - 1).bit_length())
    samples = shingles[np.concatenate(([True], ranges[1:] != ranges[:-1]))]
    places = (mix(samples * _STEP) & np.uint64(BITS - 1)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(places, minlength=BITS) & 1).astype(bool)).tobytes()


def may_be_similar(flips, samples_a, samples_b, size_a, size_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs can have the similarity, and how many samples they seem to share, by the bits in which their sketches differ.

    Two sets at the threshold t have a union of u = (a + b) / (1 + t) shingles. The ranges it fills are those of the larger set, whose number is
    known, and those of the empty ones that the other set's own shingles fall into, which has an occupancy's mean and variance. A share t of
    the filled ranges has the same sample in both, with the variance of a draw of so many out of u shingles. A pair passes unless it
    seems to share fewer by more than SIGMAS standard deviations and one sample. All arguments are arrays or fit together.
    """
    t = percent / 100
    most, least = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    odd = np.minimum(2.0 * flips / BITS, 0.98)
    differ = np.log1p(-odd) / np.log1p(-2.0 / BITS)
    shared = (samples_a + samples_b - differ) / 2
    union = (size_a + size_b) / (1 + t)
    known = np.where(size_a >= size_b, samples_a, samples_b)
    free, others = SAMPLES - known, np.maximum(union - most, 0)
    # Probabilities that the other set's own shingles leave out one given range, and two given ranges.
    one, two = np.exp(others * np.log1p(-1.0 / SAMPLES)), np.exp(others * np.log1p(-2.0 / SAMPLES))
    filled = known + free * (1 - one)
    occupancy = np.maximum(free * (one - two + free * (two - one * one)), 0)
    drawn = filled * t * (1 - t) * np.clip((union - filled + np.sqrt(occupancy)) / np.maximum(union - 1, 1), 0, 1)
    by_sketch = np.maximum(BITS / 4 * np.expm1(4 * differ / BITS) - differ, 0) / 4
    enough = shared + SIGMAS * np.sqrt(by_sketch + drawn + t * t * occupancy) + 1 >= t * filled
    return enough & (100 * least >= percent * most), shared


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, samples, sketch, buckets) per document; from node on null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in blocks(texts):
                rows = []
                for s in shingle_sets(texts[a:b], width):
                    rows.append((len(s), digest(s), *odd_sketch(s), buckets(s)) if len(s) else (0, None, None, None, None))
                out = pd.DataFrame(rows, columns=["n_shingles", "node", "samples", "sketch", "buckets"])
                out.insert(0, "text_hash", batch["text_hash"].iloc[a:b].array)
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].array)
                yield out

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, node binary, samples int, sketch binary, buckets array<long>")


def _sketch_close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that the sketches find close."""
    side = lambda x: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "n_shingles", "samples", "sketch")])
    known = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b")).drop("node_a", "node_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                a, b = (np.frombuffer(b"".join(p[c]), np.uint64).reshape(len(p), -1) for c in ("sketch_a", "sketch_b"))
                flips = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
                args = [p[c].to_numpy() for c in ("samples_a", "samples_b", "n_shingles_a", "n_shingles_b")]
                yield p.loc[may_be_similar(flips, *args, percent)[0], ["a", "b"]]

    return known.mapInPandas(run, "a binary, b binary")


def _full_sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes: one document of each is read again."""
    wanted = nodes.distinct()
    ids = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    # FILTER_BITS bits at most, whatever the number of documents; kept packed.
    held = {r["k"]: bytes(r["bits"]) for r in maps.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 << 15
        for batch in batches:
            # The bucket number of place 0 is 1, as Spark numbers places from 1.
            places = batch["place"].to_numpy()
            number, bit = np.where(places > 0, 1 + (places - 1) // size, 0), np.where(places > 0, (places - 1) % size, (-places) % size)
            keep = np.zeros(len(batch), bool)
            for k, bits in held.items():
                mine = number == k
                keep[mine] = (np.frombuffer(bits, np.uint8)[bit[mine] >> 3] >> (bit[mine] & 7)) & 1 == 1
            texts = texts_of(batch["text"][keep])
            for a, b in blocks(texts):
                sets = [s for s in shingle_sets(texts[a:b], width) if len(s)]
                yield pd.DataFrame({"node": [digest(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    read = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("place"), "text")
    found = read.mapInPandas(run, "node binary, shingles array<long>")
    return staged(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("n"))
    return both.where(f"100L * n >= {percent}L * (n_a + n_b - n)").select("a", "b")


def _close_pairs(bucket: int, left: pd.DataFrame, right: pd.DataFrame, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x, y) in two blocks of a bucket, and shared samples, of close pairs of different components that meet here for the first time."""
    bits = lambda g: np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
    a, b = bits(left), bits(right)
    names = pd.factorize(pd.concat([left["component"], right["component"]]))[0]
    part_a, part_b = names[:len(left)], names[len(left):]
    all_a, all_b = np.stack(left["buckets"].to_list()), np.stack(right["buckets"].to_list())
    counts = lambda g, axis: [np.expand_dims(g[c].to_numpy(), axis) for c in ("samples", "n_shingles")]
    found = []
    for k in range(0, len(left), 64):
        flips = np.zeros((len(a[k:k + 64]), len(right)), np.int64)
        for word in range(a.shape[1]):
            flips += np.bitwise_count(a[k:k + 64, word, None] ^ b[None, :, word])
        own, other = counts(left.iloc[k:k + 64], 1), counts(right, 0)
        near, shared = may_be_similar(flips, own[0], other[0], own[1], other[1], percent)
        x, y = np.nonzero(near & (part_a[k:k + 64, None] != part_b[None, :]))
        shared = shared[x, y]
        x += k
        equal = all_a[x] == all_b[y]
        here = all_a[x, equal.argmax(1)] == bucket
        if same:
            here &= x < y
        found.append((x[here], y[here], shared[here]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _links_in_block(group: pd.DataFrame, left: np.ndarray, right: np.ndarray, shared: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of a group that join their components, found among the close pairs with full sets, those that share most first."""
    sets = [np.asarray(s).view(np.uint64) for s in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    names = pd.factorize(group["component"])[0]
    links = []
    order = np.lexsort((-shared, left))
    left, right = left[order], right[order]
    for x in np.unique(left):
        partners = right[np.searchsorted(left, x):np.searchsorted(left, x, "right")]
        while len(partners := partners[names[partners] != names[x]]):
            now, partners = partners[:32], partners[32:]
            all_of = np.concatenate([sets[y] for y in now])
            place = np.minimum(np.searchsorted(sets[x], all_of), sizes[x] - 1)
            inside = np.add.reduceat((sets[x][place] == all_of).astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
            for y in now[100 * inside >= percent * (sizes[now] + sizes[x] - inside)]:
                if names[y] != names[x]:
                    links.append((x, y))
                    names[names == names[y]] = names[x]
    return links


def _left_over(docs: DataFrame, prints: DataFrame, members: DataFrame, nodes: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components, from the buckets that still hold more than one."""
    known = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        # Two nodes are the hub and one other, which have been compared.
        .where("low <> high and n > 2").select("bucket", "n"))
    details = ["n_shingles", "samples", "sketch", "buckets"]
    rows = (
        known.join(mixed, "bucket").join(nodes.select("node", *details), "node")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", *details))

    def sides(key: tuple, group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, i, j = key
        a, b = np.flatnonzero(group["own"] == i), np.flatnonzero(group["own"] == j)
        if not len(a) or not len(b):
            return (np.zeros(0, np.int64),) * 3
        x, y, shared = _close_pairs(bucket, group.iloc[a], group.iloc[b], i == j, percent)
        return a[x], b[y], shared

    def close(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = sides(key, group)
        return group.iloc[np.union1d(x, y)].assign(i=key[1], j=key[2])[["bucket", "i", "j", "own", "node", "component", *details]]

    def confirm(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        links = _links_in_block(group, *sides(key, group), percent)
        named = group["node"].to_numpy()
        return pd.DataFrame([(min(p), max(p)) for p in ((named[x], named[y]) for x, y in links)], columns=["a", "b"])

    # At most one row per node, bucket and pair of blocks, however many pairs are close.
    kept = staged(rows.groupBy("bucket", "i", "j").applyInPandas(close, rows.schema), "close")
    if kept.isEmpty():
        return kept.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = _full_sets(docs, prints, kept.select("node"), width)
    return kept.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(confirm, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64) for each row of `docs` (doc_id, text; other columns are not read).

    Documents with 100 * |A and B| >= percent * |A or B| are linked; component_id is the smallest doc_id that links reach. Null texts
    and texts without words have an empty set, are linked with nothing and are kept. A document without doc_id links
    others; its component_id is theirs, null if none has an id. Rows that repeat a doc_id are one row each.
    """
    bounded_batches(docs.sparkSession)
    prints = staged(fingerprints(docs, width), "prints")
    nodes = staged(prints.where("node is not null").drop("doc_id", "text_hash").dropDuplicates(["node"]), "nodes")
    dealt = nodes.select("node", F.explode("buckets").alias("bucket"))
    hubs = dealt.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = staged(dealt.join(hubs, "bucket"), "members")
    nodes = staged(nodes.join(members.select("node").distinct(), "node", "left_semi"), "sketches")

    near = staged(_sketch_close(members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent), "pairs")
    sets = _full_sets(docs, prints, near.select(F.col("a").alias("node")).union(near.select("b")), width)
    links = staged(_confirmed(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent), "links")
    parts = components(links)
    links = [links, staged(_confirmed(_apart(near, parts), sets, percent), "links")]
    parts = components(reduce(DataFrame.union, links))

    links.append(staged(_left_over(docs, prints, members, nodes, parts, width, percent), "links"))
    parts = components(reduce(DataFrame.union, links))

    known = (
        prints.select("doc_id", "text_hash", "n_shingles", "node").join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node")))
    smallest = known.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(smallest, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.expr("doc_id <=> case when node is null then doc_id else component_id end").alias("kept"), "text_hash")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a, b = (parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return known.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")
