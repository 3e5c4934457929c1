"""SimHash near duplicates, with exact Hamming neighbours from vantage-point trees.

A document's fingerprint has a bit for each bit position of the 64-bit hashes of its word
shingles, set where more than half of the hashes have it set. Equal fingerprints are merged
first. Distinct ones are partitioned by Hamming distance: a shallow tree of vantage points,
taken from a bounded sample of all fingerprints, cuts space into shards (nearer to or farther
from the point than the median). Each fingerprint is at home in one shard and is also sent as
a query to every shard that its ball of the radius overlaps, by the triangle bounds of the
points on the way, so no pair is lost at a border. Inside a shard the same kind of tree goes
on down to small leaves, which are compared directly; branches out of reach are pruned.

A shard keeps only a spanning forest of the links it finds, so a group of n near copies gives
fewer than n links, not n * n. Components of the links of all shards come from rounds of
large-star and small-star steps over a table of links, each round behind a checkpoint.

Lower case is A-Z only. Fewer words than a shingle are one shingle; NULL, empty and blank
texts have the fingerprint zero and are linked like any other. Rows with a NULL id have a
fingerprint and take part in linking; the component is the smallest id that is not NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table
from keelson.plans.durable import cut

WORDS, RADIUS, SEED = 3, 3, 42
PER_SHARD, SAMPLE, LEAF = 200_000, 20_000, 128
_ROWS = 1 << 15


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The 64 bits as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        block = hashes[at : at + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * ones[k] > n))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """``doc_id, fp`` of every row; fp holds the bits as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def far(points: np.ndarray, from_: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ from_).astype(np.int16)


class Shards:
    """The shallow tree: inner nodes (point, median), leaves are shard numbers in order."""

    def __init__(self, sample: np.ndarray, shards: int, rng: np.random.Generator):
        self.count = 0
        self.root = self._grow(sample, max(0, int(np.ceil(np.log2(max(1, shards))))), rng)

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        if depth and len(points) > 2:
            point = points[rng.integers(len(points))]
            d = far(points, point)
            median = int(np.median(d))
            near = d <= median
            if near.any() and not near.all():
                return (point, median, self._grow(points[near], depth - 1, rng), self._grow(points[~near], depth - 1, rng))
        self.count += 1
        return self.count - 1

    def visits(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that the ball around a row overlaps; radius 0: its home."""
        rows, shards, open_nodes = [], [], [(self.root, np.arange(len(points)))]
        while open_nodes:
            node, here = open_nodes.pop()
            if not isinstance(node, tuple):
                rows.append(here)
                shards.append(np.full(len(here), node, np.int32))
                continue
            point, median, near, beyond = node
            d = far(points[here], point)
            open_nodes.append((near, here[d <= median + radius]))
            open_nodes.append((beyond, here[d > median - radius]))
        return np.concatenate(rows), np.concatenate(shards)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` nodes that a link touches, a link to the least node of its component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


class Links:
    """Links between numbered points, folded into a forest whenever there are many."""

    def __init__(self, n: int):
        self.n, self.size, self.parts = n, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.size += len(a)
        if self.size > 4 * self.n + 1_000_000:
            self.parts = [self.folded()]
            self.size = len(self.parts[0][0])

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return forest(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]), self.n)


def links_within(points: np.ndarray, home: np.ndarray, radius: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs (any point, a home point) within ``radius``, by a vantage-point tree.

    ``points`` are distinct; ``home`` marks those that are indexed, and all of them are queries.
    """
    rng, found = np.random.default_rng(seed), Links(len(points))
    open_nodes = [(np.flatnonzero(home), np.arange(len(points)))]
    while open_nodes:
        inside, asking = open_nodes.pop()
        if not len(inside) or not len(asking):
            continue
        if len(inside) > LEAF:
            point = points[inside[rng.integers(len(inside))]]
            d = far(points[inside], point)
            median = int(np.median(d))
            near = d <= median
            if near.all():  # at least half are equally far: cut off the nearer ones
                median -= 1
                near = d <= median
            if near.any():
                q = far(points[asking], point)
                open_nodes.append((inside[near], asking[q <= median + radius]))
                open_nodes.append((inside[~near], asking[q > median - radius]))
                continue
        for at in range(0, len(asking), 4096):
            some = asking[at : at + 4096]
            for to in range(0, len(inside), 4096):
                other = inside[to : to + 4096]
                i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[other][None, :]) <= radius)
                apart = some[i] != other[j]
                if apart.any():
                    found.add(some[i][apart], other[j][apart])
    return found.folded()


def near_links(distinct: DataFrame, radius: int = RADIUS, per_shard: int = PER_SHARD) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of ``fp`` within ``radius``."""
    spark = distinct.sparkSession
    (n,) = distinct.agg(F.count(F.lit(1))).first()
    shards = -(-n // per_shard) or 1
    # every shard needs enough points of its own in the sample for its medians
    wanted = max(SAMPLE, 64 * shards)
    picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(2**40)) < int(2**40 * min(1.0, wanted / max(n, 1))))
    points = sorted(r["fp"] for r in picked.select("fp").collect()) if shards > 1 else []
    tree = spark.sparkContext.broadcast(Shards(np.array(points, np.int64).view(np.uint64), shards, np.random.default_rng(7)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rows, shard = tree.value.visits(fp.view(np.uint64), radius)
            own_rows, own = tree.value.visits(fp.view(np.uint64), 0)
            at_home = np.empty(len(fp), np.int32)
            at_home[own_rows] = own
            yield pa.record_batch(
                [pa.array(shard), pa.array(fp[rows]), pa.array(at_home[rows] == shard)], ["shard", "fp", "home"]
            )

    def link(key: tuple, shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy()
        a, b = links_within(fp.view(np.uint64), shard.column("home").to_numpy(), radius, int(key[0].as_py()))
        return pa.table({"a": fp[a], "b": fp[b]})

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(link, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b), root being the least of its component.

    Alternating large-star and small-star steps; a round that changes nothing ends them.
    """
    both = lambda e: e.union(e.select("b", "a")).toDF("u", "v")

    def star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
        """Every neighbour v of u (larger than u, or all of them, and u itself) to their least one."""
        least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        out = neighbours.join(least, "u")
        out = out.filter("v > u") if larger_only else out.union(least.select("u", F.col("u").alias("v"), "low"))
        return out.filter("v != low").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(links.filter("a != b").distinct())
    seen = state(edges)
    while seen[0]:
        large = star(both(edges), larger_only=True)
        ordered = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = cut(star(ordered, larger_only=False))
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, per_shard: int = PER_SHARD
) -> DataFrame:
    """``id, of, component`` of every row; ``of`` is xxhash64 of its text, which tells apart rows of one id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], ["id", "of", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    prints = cut(rows.mapInArrow(hashed, "id long, of long, fp long"))
    roots = components(near_links(prints.select("fp").distinct(), radius, per_shard))
    placed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.select("id", "of", F.coalesce("root", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, per_shard: int = PER_SHARD
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the fingerprint as 16 hex digits."""
    prints = cut(fingerprints(docs, doc_id, text))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct, radius, per_shard))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).join(placed.select("fp", "root"), "root")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", hexed, "component_id")


def op9_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
