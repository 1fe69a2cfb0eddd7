"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every word rule here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is not shared with the executors")
    folder = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders of tables that were cut and not yet discarded, with the file system and path that delete them.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[str, tuple] = {}


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, an executor may be lost.

    Shuffle files of the write are freed as soon as it is done. The folder goes with
    :func:`discard`, or when the driver ends.
    """
    spark, free = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(free, "false")
    spark.conf.set(free, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(free, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _left[path] = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from :func:`cut` that nothing reads any more."""
    for t in tables:
        path = _folders.pop(t, None)
        if path in _left:
            system, place = _left.pop(path)
            system.delete(place, True)


@atexit.register
def _discard_rest() -> None:
    for system, place in _left.values():
        with contextlib.suppress(Exception):  # the driver's Java may have ended before
            system.delete(place, True)


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


class Fingerprints:
    """64-bit fingerprints of any part of ``data`` (bytes or characters), from prefix sums of a polynomial."""

    table = mix64(np.arange(1, 257, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        values = self.table[data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64) + np.uint64(1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def each(self, size: int) -> np.ndarray:
        return mix64((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables of whole groups, with their number in a column group. Holds a batch and a group."""
    held: list[pa.RecordBatch] = []

    def numbered() -> pa.Table:
        rows = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        for c in keys:
            x = rows.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return rows.append_column("group", pa.array(np.cumsum(new)))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = 0
        for c in keys:
            x = batch.column(c).to_numpy()
            last = max(last, int(np.max(np.flatnonzero(x[1:] != x[:-1]), initial=-1)) + 1)
        if last:
            held.append(batch.slice(0, last))
            yield numbered()
            held = []
        elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys):
            yield numbered()
            held = []
        held.append(batch.slice(last))
    if held:
        yield numbered()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (a, b) that join all that the links join: each turn every root hooks below a smaller one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label, left, keep = np.arange(len(nodes)), np.arange(len(a)), [np.empty(0, np.int64)]
    while len(left):
        x, y = label[u[left]], label[v[left]]
        left = left[x != y]
        high, low = np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        roots, first = np.unique(high, return_index=True)
        keep.append(left[first])
        below = np.arange(len(nodes))
        below[roots] = low[first]
        while (further := below[below]).tobytes() != below.tobytes():
            below = further
        label = below[label]
    kept = np.concatenate(keep)
    return a[kept], b[kept]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large and small stars.

    Every step is a group-by and an equi-join over the edge table, written to the
    shared folder, so no component is ever held by one task or the driver. Nodes
    without an edge have no row. Self loops and nulls are ignored.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.where(u > v).distinct(), "edges")
    while True:
        # a star forest: every larger node has one root, and no root hangs below another
        n, n_u = e.agg(F.count("*"), F.countDistinct("u")).first()
        if n == n_u and e.join(e.select(v.alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        large = cut(large.where(u > v).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(v.alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, e = e, cut(small.where(u > v).distinct(), "small")
        discard(before, large)
    nodes = e.select(u.alias("node"), v.alias("component"))
    return nodes.unionByName(e.select(v.alias("node"), v.alias("component")).distinct())
