"""Operator 9: near-duplicate documents by HyperMinHash.

A document is the set of its word shingles, as 64-bit hashes. The first bits of a hash
choose one of 128 registers; a register keeps the smallest remaining hash as a count of
leading zeros (6 bits) and the 10 mantissa bits after the leading one, so 256 bytes stand
for a document of any length. Four neighbouring registers are a band of 64 bits.

Texts with equal sets are one class. Classes that share a band are compared: first each with
the smallest member of its bands, and linked pairs become components; in later rounds only
pairs of different components are left. A pair is linked only after the exact comparison of
full sets. Pairs that the sketches put clearly below the threshold, after correcting for
register collisions, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, cut, mix64, raw_bytes

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
#: Words a worker remembers hashes of.
CACHE = 400_000
#: Standard errors by which an estimate may fall short of the threshold and still be compared.
SLACK = 4.5
#: Members of a band that one block of the last round compares with another.
BLOCK = 500


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE and len(word) < 64:
            self[word] = got
        return got


_words = WordHashes()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; one of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    got = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        got = mix64(got ^ h[k : k + n]) + np.uint64(k + 1)
    return np.unique(mix64(got))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of sorted hashes; 0 where no hash falls."""
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    bounds = np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << shift)
    ends = np.append(bounds[1:], len(hashes))
    held = ends > bounds
    rest = hashes[bounds[held]] << np.uint64(64 - int(shift))
    zeros = np.minimum(64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, "<u2")
    out[held] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype("<u2")
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (s1, s2; null for the empty set) and its sketch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, s1, s2, kept = [], [], [], []
            for text in raw_bytes(batch.column("text")):
                own = shingle_set(text, width)
                digest = xxhash.xxh128_digest(own.tobytes())
                sizes.append(len(own))
                s1.append(int.from_bytes(digest[:8], "little", signed=True) if len(own) else None)
                s2.append(int.from_bytes(digest[8:], "little", signed=True) if len(own) else None)
                kept.append(sketch(own).tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(read, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary")


def banded(reps: DataFrame) -> DataFrame:
    """id and band for each band with a register in use."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))
        for batch in batches:
            kept = batch.column("sketch").to_pylist()
            rows = np.frombuffer(b"".join(kept), "<u8").reshape(len(kept), BANDS)
            used = rows != 0
            ids = np.repeat(batch.column("id").to_numpy(), used.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mix64(rows ^ marks)[used].view(np.int64))], names=["id", "band"])

    return reps.select("id", "sketch").mapInArrow(read, "id long, band long")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketch rows, and registers used by either. Registers that agree by
    chance, about 0.17 / 2**MANTISSA of those in use, are taken off."""
    either = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    chance = either * 0.169919 / 2**MANTISSA
    return np.clip((same - chance) / np.maximum(either - chance, 1e-9), 0, 1), either


def plausible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    j, used = estimate(a, b)
    t = percent / 100
    return j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are as similar as asked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", shingle_set(b"", width))
        for batch in batches:
            keep = []
            sketch_a, sketch_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            maybe = plausible(sketch_a, sketch_b, percent)
            for i, (x, y) in enumerate(zip(raw_bytes(batch.column("text_a")), raw_bytes(batch.column("text_b")), strict=True)):
                if not maybe[i]:
                    keep.append(False)
                    continue
                if x != last[0]:
                    last = x, shingle_set(x, width)
                p, q = last[1], shingle_set(y, width)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "text_a", "text_b", "sketch_a", "sketch_b").mapInArrow(compare, "a long, b long")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of each band, dealt into blocks of about BLOCK; a pair of blocks (x, y) is one group.

    side tells the block (0 or 1) of the pair, or 2 where a block meets itself, so no task holds a
    whole band and each two members meet in one group.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    own = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return own.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": side}).drop("own", "other", "n_blocks")


def open_pairs(rows: pa.Table, band: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a group with the later rows it is to be compared with: of another component and
    block, plausible by their sketches, and with this as the first band they share."""
    kept = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
    words, marks = kept.view("<u8"), mix64(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))
    keys = mix64(words ^ marks).view(np.int64)
    component, side = rows.column("component").to_numpy(), rows.column("side").to_numpy()
    turn = int(np.flatnonzero(keys[0] == band)[0])
    for i in range(len(kept) - 1):
        j = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        j = j[(side[j] != side[i]) | (side[j] == 2)]
        j = j[~((words[j, :turn] == words[i, :turn]) & (words[i, :turn] != 0)).any(1)]
        if len(j):
            j = j[plausible(kept[i][None, :], kept[j], percent)]
        if len(j):
            yield i, j


def crossing(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one band and different components.

    Sketches tell, in blocks, which members have a plausible partner; only these are read, and
    compared on their full sets in their group, one with all at once. A group gives the links
    that join what was apart, so the rows made grow with the members.
    """
    small = "band long, x int, y int, id long, component long, side int"

    def partnered(key: tuple, rows: pa.Table) -> pa.Table:
        held = np.zeros(rows.num_rows, bool)
        for i, j in open_pairs(rows, key[0].as_py(), percent):
            held[i] = held[j] = True
        return rows.select([x.split()[0] for x in small.split(", ")]).filter(pa.array(held))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        sets = [shingle_set(x, width) for x in raw_bytes(rows.column("text"))]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        mark, ids, group = np.zeros(len(known), np.int32), rows.column("id").to_numpy(), list(range(len(sets)))
        a, b = [], []

        def root(i: int) -> int:
            while group[i] != i:
                i = group[i] = group[group[i]]
            return i

        for i, j in open_pairs(rows, key[0].as_py(), percent):
            j = np.array([k for k in j if root(k) != root(i)], np.int64)
            if not len(j):
                continue
            mark[code[starts[i] : starts[i] + sizes[i]]] = 1
            part = np.repeat(np.arange(len(j)), sizes[j])
            at = np.arange(len(part)) - np.repeat(np.cumsum(sizes[j]) - sizes[j], sizes[j]) + starts[j][part]
            both = np.bincount(part, mark[code[at]], len(j)).astype(np.int64)
            mark[code[starts[i] : starts[i] + sizes[i]]] = 0
            for k in j[100 * both >= percent * (sizes[i] + sizes[j] - both)]:
                if root(k) != root(i):
                    group[root(k)] = root(i)
                    a.append(min(ids[i], ids[k]))
                    b.append(max(ids[i], ids[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = cut(in_blocks(members).groupBy("band", "x", "y").applyInArrow(partnered, small), "partnered")
    read = found.join(texts.select("id", "text", "sketch"), "id")
    return read.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """Operator 9: doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lowered. Documents whose shingle sets have
    100 * intersection >= ``percent`` * union are linked; component_id is the smallest doc_id
    reachable, kept tells whether that is the document itself. Null, empty and wordless texts have
    an empty set and are linked with nothing. Repeated rows stay repeated and have one component.
    Extra columns are ignored; an empty table gives an empty table.
    """
    own = cut(sketches(docs, width), "sketches")
    classes = own.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    reps = own.withColumnRenamed("doc_id", "id").join(classes, ["s1", "s2", "id"]).dropDuplicates(["id"]).select("id", "n_shingles", "sketch")
    bands = banded(reps)
    shared = bands.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    bands = cut(bands.join(shared.select("band"), "band"), "bands")
    near = bands.select("id").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    texts = cut(reps.join(near, "id").join(text, "id").dropDuplicates(["id"]), "texts")

    labels = texts.select("id", F.col("id").alias("component"))
    edges = None
    for turn in range(rounds + 1):
        members = bands.join(labels, "id")
        if turn:
            open_bands = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
            members = members.join(open_bands, "band")
        if turn < rounds:
            # each round another member of a band is its centre
            rank = F.struct(F.xxhash64("id") if turn else F.lit(0).cast("long"), F.col("id"))
            centres = members.groupBy("band").agg(F.min(rank).alias("c")).select("band", F.col("c.id").alias("centre"))
            pairs = members.join(centres, "band").where("id <> centre")
            if turn:
                pairs = pairs.join(labels.select(F.col("id").alias("centre"), F.col("component").alias("centre_component")), "centre").where("component <> centre_component")
                pairs = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
            else:
                pairs = pairs.groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b")
        else:
            found = crossing(members.join(texts.select("id", "sketch"), "id").select("band", "id", "component", "sketch"), texts, width, percent)
        found = cut(found if turn == rounds else linked(pairs, texts, width, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        reached = components(edges)
        labels = cut(texts.select("id").join(reached.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    whole = classes.join(labels, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    out = own.join(whole, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
