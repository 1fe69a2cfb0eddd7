"""Operator 8: near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and
names the axis, with its sign, that lies closest. A table joins a few hashes; a vector stands in
its own bucket and, as probes, in those where one hash takes its second axis. How often two
vectors just at the threshold share a bucket of a table is measured on random pairs, and there
are as many tables as that asks for.

Buckets only pass on vectors that another member may be close to, by the bits of two words of
random projections; these are compared in double precision and give links that span what is
linked. Components follow, and as no link leaves its component, links are counted there, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, cut, discard, mix64, sorted_groups, spanning

#: Members of a bucket or component that one block compares with another.
BLOCK = 2000
#: Members of a bucket above which all are passed on unread.
LARGE = 2000
#: Bits of the projections, and standard errors by which a close pair may have more of them apart.
BITS, SLACK = 128, 7.0
#: Chance that a pair just at the threshold shares no bucket.
MISS = 1e-4


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """(n, 3, width) signs for vectors padded to a power of two."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (n, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis."""
    rows, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(rows, -1, 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(rows, width)
        step *= 2
    return x


def axes(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(row, hash, 2): the closest and the second closest signed axis."""
    out = np.empty((len(vectors), len(signs), 2), np.int64)
    padded = np.zeros((len(vectors), signs.shape[-1]))
    padded[:, : vectors.shape[1]] = vectors
    for k, turn in enumerate(signs):
        x = padded
        for s in turn:
            x = hadamard(x * s)
        size, rows = np.abs(x), np.arange(len(x))
        for p in range(2):
            best = size.argmax(1)
            out[:, k, p] = 2 * best + (x[rows, best] < 0)
            size[rows, best] = -1
    return out


def buckets(vectors: np.ndarray, n_tables: int, n_hashes: int, seed: int) -> np.ndarray:
    """(row, table, 1 + n_hashes): ids of the buckets a vector stands in."""
    near = axes(vectors, rotations(vectors.shape[1], n_tables * n_hashes, seed)).reshape(len(vectors), n_tables, n_hashes, 2)
    first = near[..., 0]
    out = np.empty((len(vectors), n_tables, 1 + n_hashes), np.uint64)
    for p in range(1 + n_hashes):
        own = first.copy()
        if p:
            own[..., p - 1] = near[..., p - 1, 1]
        h = np.tile(mix64(np.arange(1, n_tables + 1, dtype=np.uint64) << np.uint64(32)), (len(vectors), 1))
        for k in range(n_hashes):
            h = mix64(h ^ (own[..., k].astype(np.uint64) + np.uint64(1)))
        out[..., p] = h
    return out.view(np.int64)


def shared_by_close(dim: int, n_hashes: int, threshold: float, seed: int, pairs: int = 600) -> float:
    """Chance that vectors just at the threshold share a bucket of one table, from below (three standard errors), by trial."""
    rng, tables = np.random.default_rng([seed, dim, n_hashes]), 4
    x, z = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    a, b = (buckets(v, tables, n_hashes, seed) for v in (x, y))
    p = float((a[..., :, None] == b[..., None, :]).any((2, 3)).mean())
    return max(p - 3 * math.sqrt(p * (1 - p) / (pairs * tables)), 0.02)


def plan(n: int, dim: int, threshold: float, seed: int) -> tuple[int, int]:
    """(tables, hashes a table): so many hashes that a bucket holds few of n vectors, so many tables that a close pair is missed by ``MISS``."""
    width = 1 << max(1, (dim - 1).bit_length())
    n_hashes = max(1, round(math.log(max(n, 2)) / math.log(2 * width)))
    return math.ceil(math.log(MISS) / math.log(1 - min(shared_by_close(dim, n_hashes, threshold, seed), 0.999))), n_hashes


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def unit(column: pa.Array) -> np.ndarray:
    raw = matrix(column)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def bits(vectors: np.ndarray, seed: int) -> np.ndarray:
    """(row, 2): on which sides of random hyperplanes a vector lies."""
    planes = np.random.default_rng([seed, vectors.shape[1], BITS]).normal(size=(vectors.shape[1], BITS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.uint64)


def bits_apart(threshold: float) -> float:
    """How many bits of a close pair may differ: hyperplanes part it as its angle says."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return BITS * p + SLACK * math.sqrt(BITS * p * (1 - p)) + 1


def entries(vectors: DataFrame, n_tables: int, n_hashes: int, seed: int) -> DataFrame:
    """bucket, id, h and two words of bits for each place of a vector."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                held = unit(own.column("vector"))
                got, sides = buckets(held, n_tables, n_hashes, seed), bits(held, seed)
                # vectors of different labels or lengths never meet
                keys = mix64(got.view(np.uint64) ^ mix64(own.column("part").to_numpy().view(np.uint64))[:, None, None]).reshape(len(got), -1)
                places = keys.shape[1]
                columns = [keys.reshape(-1).view(np.int64), *(np.repeat(own.column(c).to_numpy(), places) for c in ("id", "h")), *(np.repeat(sides[:, k].view(np.int64), places) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id", "h", "bits_a", "bits_b"])

    return vectors.select("id", "h", "part", "dim", "vector").mapInArrow(read, "bucket long, id long, h long, bits_a long, bits_b long")


def partnered(places: DataFrame, threshold: float) -> DataFrame:
    """bucket, id and h of members that another member of the bucket may be close to. Of a bucket with more than ``LARGE`` members, all."""
    most, names = bits_apart(threshold), ["bucket", "id", "h"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        large = None

        def ended() -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(rest).combine_chunks()
            bucket, h = rows.column("bucket").to_numpy(), rows.column("h").to_numpy()
            sides = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("bits_a", "bits_b")], 1)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            keep = np.zeros(len(bucket), bool)
            for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
                if b - a > 1:
                    apart = np.bitwise_count(sides[a:b, None] ^ sides[None, a:b]).sum(2, dtype=np.int32)
                    keep[a:b] = ((apart <= most) & (h[a:b, None] != h[None, a:b])).any(1)
            return rows.select(names).filter(pa.array(keep)).to_batches()

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            if large is not None:
                upto = int(np.searchsorted(bucket, large, "right"))
                if upto:
                    yield batch.slice(0, upto).select(names)
                batch, bucket = batch.slice(upto), bucket[upto:]
            if not len(bucket):
                continue
            large = None
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last or (rest and rest[-1].column("bucket")[-1].as_py() != bucket[0]):
                rest.append(batch.slice(0, last))
                yield from ended()
                rest = []
            rest.append(batch.slice(last))
            if sum(x.num_rows for x in rest) > LARGE:
                large = bucket[-1]
                yield from (x.select(names) for x in rest)
                rest = []
        if rest:
            yield from ended()

    order = places.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "id", "h", "bits_a", "bits_b")
    return order.mapInArrow(read, "bucket long, id long, h long").dropDuplicates()


def in_blocks(members: DataFrame, key: str) -> DataFrame:
    """Members of a group dealt into blocks of about ``BLOCK``; two blocks (x, y) meet in one group. own: the member's block."""
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).where("n_blocks > 1")
    own = members.join(sizes, key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    own = own.withColumn("own", F.pmod(F.xxhash64("id", "h"), F.col("n_blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return own.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "n_blocks")


NODE = "struct<id:bigint,h:bigint>"


def close_pairs(members: DataFrame, classes: DataFrame, key: str, threshold: float, count: bool) -> DataFrame:
    """Rows (node, links, to): with ``count`` numbers of close vectors (to null), else links that span what is close."""
    dealt = in_blocks(members, key).join(classes.select("id", "h", "vector", "copies"), ["id", "h"])
    names = [key, "x", "y"]
    dealt = dealt.select(*names, "own", F.struct("id", "h").alias("node"), "vector", "copies").repartition(*names).sortWithinPartitions(*names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, names):
            group, x, y, own, copies = (rows.column(c).to_numpy() for c in ("group", "x", "y", "own", "copies"))
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            links, found = np.zeros(len(group), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in zip(starts, np.r_[starts[1:], len(group)], strict=True):
                held = unit(rows.column("vector").slice(a, b - a).combine_chunks())
                # a block with itself, or one with the other
                left, right = (np.arange(b - a),) * 2 if x[a] == y[a] else (np.flatnonzero(own[a:b] == x[a]), np.flatnonzero(own[a:b] == y[a]))
                close = held[left] @ held[right].T >= threshold
                if x[a] == y[a]:
                    np.fill_diagonal(close, False)
                if count:
                    links[a + left] += close @ copies[a + right]
                    if x[a] != y[a]:
                        links[a + right] += close.T @ copies[a + left]
                else:
                    i, j = np.nonzero(close)
                    found.append(spanning(a + left[i], a + right[j]))
            nodes = rows.column("node").combine_chunks()
            if count:
                at = np.flatnonzero(links)
                to = pa.array(np.zeros(len(at), np.int64), mask=np.ones(len(at), bool))
            else:
                at, to = (np.concatenate(z) for z in zip(*found, strict=True))
                to = pa.array(to)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at)), pa.array(links[at]), nodes.take(to)], names=["node", "links", "to"])

    return dealt.mapInArrow(read, f"node {NODE}, links long, to {NODE}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, n_tables: int | None = None, n_hashes: int | None = None, seed: int = 5, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Operator 8: vec_id, n_links, component_id and kept for each row.

    Rows of equal, non-null label (and length) are linked if the cosine in double precision is at
    least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components
    are linked with nothing. Equal vectors of a label (by two 64-bit hashes) count once, with their
    number, in the search. Tables and hashes a table follow from :func:`plan` unless they are given;
    a close pair that shares no bucket is found all the same if other links join the two.

    Pairs are never listed: a task gives links that span what is close, then sums by vector. Hot
    buckets and components are compared in blocks of ``BLOCK`` members; none is capped, so counting
    is quadratic in a component. Repeated rows of one id count as copies. Extra columns are ignored;
    an empty table gives an empty table.
    """
    x = F.col("vector")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    same = lambda n: F.when(usable, F.xxhash64(F.lit(n), "label", "vector"))
    rows = rows.withColumns({"h": same(1), "h2": same(2)})
    part = F.xxhash64("label", F.size("vector"))
    classes = cut(rows.where(usable).groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first(part).alias("part"), F.first(F.size("vector")).alias("dim")), "vectors")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    if n_tables is None or n_hashes is None:
        tables, hashes = plan(n, dim, threshold, seed)
        n_tables, n_hashes = n_tables or tables, n_hashes or hashes

    met = cut(partnered(entries(classes, n_tables, n_hashes, seed), threshold), "met-vectors")
    joined = cut(close_pairs(met, classes, "bucket", threshold, False), "vector-links")
    reached = cut(components(joined.select("node", "to"), "node", "to"), "reached")
    members = reached.select(F.xxhash64("component.id", "component.h").alias("group_key"), "node.id", "node.h")
    links = close_pairs(members, classes, "group_key", threshold, True).groupBy("node").agg(F.sum("links").alias("links"))
    links = cut(reached.join(links, "node", "left").select("node.id", "node.h", F.col("component.id").alias("component_id"), "links"), "vector-sums")
    discard(met, joined, reached)
    told = classes.select("id", "h", "h2", "copies").join(links, ["id", "h"], "left")
    told = told.select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    # unusable rows have no hash and so find no class
    out = rows.select("vec_id", "h", "h2").join(told, ["h", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
