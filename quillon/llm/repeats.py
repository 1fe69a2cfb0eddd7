"""Operator 6: removal of long byte strings that occur more than once.

Every 200-byte window names one of its 32-byte strings, the one with the smallest hash, so
equal windows name equal strings ("anchors"), and a corpus has one anchor for about every
80 bytes. A first pass, sorted by anchor and context (all windows that name it), keeps what an
equal window elsewhere needs: anchors that stand in the corpus again. Where a whole context stands
again, by two 64-bit fingerprints, all its windows do, and one of its copies speaks for it.

The bytes of one copy of each context whose anchor has others go to an index of suffix arrays,
dealt in shards by anchor and place: :class:`LevelFamily`. A batch of texts gets a suffix array a
shard, is merge-scanned against the levels that are there, and levels of one size are merged, so
the levels, tables in the shared folder, grow geometrically. Matches are equal bytes, not hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Fingerprints, cut, discard, mix64, raw_bytes

LENGTH, ANCHOR = 200, 32
#: Window starts that the scan handles at once, and bits that hold a place among them.
CHUNK, PLACE_BITS = 1 << 19, 22
#: Places of an anchor in its window that one piece of text holds.
PLACES = 32
#: Bytes of text that a shard of the index holds on average, and pieces of one key above which ranges of windows are told apart before the index.
SHARD, HOT = 1 << 18, 4096
#: Places of an anchor in a range of windows, from step to step; the last are single windows.
SIZES = (PLACES, 4, 1)
#: Batches in which a corpus is added to the index.
BATCHES = 4


def anchors(data: np.ndarray, last: np.ndarray, length: int, width: int) -> dict[str, np.ndarray]:
    """The anchors of ``data``, texts one after the other. ``last``: for each text, the end of its windows' starts.

    start, n: the windows that name the anchor; at: its place; anchor, context, check: fingerprints.
    """
    none = {"start": np.empty(0, np.int64), "n": np.empty(0, np.int64), "at": np.empty(0, np.int64), "anchor": np.empty(0, np.uint64), "context": np.empty(0, np.uint64), "check": np.empty(0, np.uint64)}
    if len(data) < length:
        return none
    prints = Fingerprints(data)
    short = prints.each(width)
    bits = np.uint64(PLACE_BITS)  # the same for every batch, so that equal windows name equal anchors
    low = (short >> bits << bits) | np.arange(len(short), dtype=np.uint64)
    span, size = length - width + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, last[:, 0], 1)
    np.add.at(inside, last[:, 1], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    if not len(starts):
        return none
    named = at[starts]
    new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (starts[1:] != starts[:-1] + 1)])
    n = np.diff(np.r_[new, len(starts)])
    start, place = starts[new], named[new]
    shape, end = mix64((n << 32 | (place - start)).astype(np.uint64) + np.uint64(1)), start + n - 1 + length
    other = Fingerprints(data.astype(np.uint32))  # bytes as other numbers: a second, independent fingerprint
    return {"start": start, "n": n, "at": place, "anchor": short[place], "context": mix64(prints.of(start, end) ^ shape), "check": mix64(other.of(start, end) ^ shape)}


def scan(docs: DataFrame, length: int, width: int) -> DataFrame:
    """A row for each anchor: anchor, context, check, doc, text_hash, start, n, at."""
    names = ["anchor", "context", "check", "doc", "text_hash", "start", "n", "at"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy(), raw_bytes(batch.column("text"))
            parts: list[tuple[int, int, bytes]] = []
            held = 0

            def flush(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
                sizes = np.array([len(x[2]) for x in parts], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                got = anchors(np.frombuffer(b"".join(x[2] for x in parts), np.uint8), np.stack([begins, ends - length + 1], 1), length, width)
                own = np.searchsorted(ends, got["start"], side="right")
                row = np.array([x[0] for x in parts], np.int64)[own]
                move = (np.array([x[1] for x in parts], np.int64) - begins)[own]
                columns = [*(got[c].view(np.int64) for c in ("anchor", "context", "check")), ids[row], hashes[row], got["start"] + move, got["n"].astype(np.int32), got["at"] + move]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

            for i, text in enumerate(texts):
                # windows of a long text are dealt out by their start
                for begin in range(0, len(text) - length + 1, CHUNK):
                    parts.append((i, begin, text[begin : begin + CHUNK + length - 1]))
                    held += len(parts[-1][2])
                    if held >= CHUNK:
                        yield flush(parts)
                        parts, held = [], 0
            if parts:
                yield flush(parts)

    return docs.select("doc", "text_hash", "text").mapInArrow(read, "anchor long, context long, check long, doc long, text_hash long, start long, n int, at long")


def standing_again(found: DataFrame) -> DataFrame:
    """doc, text_hash, start, n, at, anchor of rows that stand again. whole: so does their context; counted: a row speaks for its context, whose anchor has others.

    Rows come sorted and are read as a stream; only the first row of the last context is held, so an
    anchor or context of any number of rows takes no memory.
    """
    keys, rest = ["anchor", "context", "check"], ["doc", "text_hash", "start", "n", "at"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told_whole, told_counted, several = None, False, False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in (*keys, *rest)}
            if held is not None:
                rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
            new_anchor = np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1]]
            new = new_anchor | np.r_[True, (rows["context"][1:] != rows["context"][:-1]) | (rows["check"][1:] != rows["check"][:-1])]
            context, anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
            many = np.bincount(anchor[new]) > 1
            if held is not None:
                many[0] |= several
            whole, counted = np.bincount(context)[context] > 1, new & many[anchor]
            if held is not None:
                whole[0] |= told_whole
            first = int(np.flatnonzero(new)[-1])
            now = whole.copy(), counted.copy()
            if held is not None:  # what was told of the held row is not told again
                now[0][0] &= not told_whole
                now[1][0] &= not told_counted
            keep = now[0] | now[1]
            columns = [rows[c][keep] for c in (*rest, "anchor")] + [now[0][keep], now[1][keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*rest, "anchor", "whole", "counted"])
            carried = first == 0 and held is not None
            held, told_whole, told_counted, several = {c: x[first : first + 1] for c, x in rows.items()}, bool(whole[first]), bool(counted[first]) or (carried and told_counted), bool(many[-1])

    order = found.repartition("anchor").sortWithinPartitions(*keys)
    return order.mapInArrow(read, "doc long, text_hash long, start long, n int, at long, anchor long, whole boolean, counted boolean")


PIECE = "key long, doc long, text_hash long, start long, place int, piece binary"


def window_pieces(docs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """The bytes of neighbouring windows of ``parts`` (doc, text_hash, start, n, at, anchor), dealt by anchor and place: equal windows have one key."""
    names = [x.split()[0] for x in PIECE.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts, every = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy(), raw_bytes(batch.column("text")), batch.column("parts").to_pylist()
            rows = []
            for doc, text_hash, text, own in zip(ids, hashes, texts, every, strict=True):
                for x in own:
                    at, end = x["start"], x["start"] + x["n"]
                    while at < end:
                        group = (x["at"] - at) // PLACES
                        upto = min(end, x["at"] - group * PLACES + 1)
                        rows.append((x["anchor"], group, doc, text_hash, at, x["at"] - at, text[at : upto - 1 + length]))
                        at = upto
            for k in range(0, len(rows), 5000):
                anchor, group, doc, text_hash, start, place, piece = zip(*rows[k : k + 5000], strict=True)
                key = mix64(np.array(anchor, np.int64).view(np.uint64) ^ mix64(np.array(group, np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(np.array(x, np.int64)) for x in (doc, text_hash, start)), pa.array(place, pa.int32()), pa.array(piece, pa.binary())], names=names)

    grouped = parts.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "n", "at", "anchor")).alias("parts"))
    # doc_id is not read here, but keeps the shuffle of the texts the same as in the last join
    both = docs.join(grouped, ["doc", "text_hash"]).select("doc_id", "doc", "text_hash", "text", "parts")
    return both.mapInArrow(read, PIECE)


RANGE = "key long, whole binary, core binary, doc long, text_hash long, start long, n int, place int, piece binary"


def ranges(pieces: DataFrame, length: int, size: int) -> DataFrame:
    """The windows of ``pieces`` in ranges of at most ``size`` places of their anchor.

    whole: fingerprint of all bytes of the range and their places; core: that of the bytes which every window
    at these places holds. Windows can only be equal at one place and in ranges of one core.
    """
    names = [x.split()[0] for x in RANGE.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                rows = []
                for key, doc, text_hash, start, place, piece in zip(*(part.column(c).to_pylist() for c in ("key", "doc", "text_hash", "start", "place", "piece")), strict=True):
                    i, n = 0, len(piece) - length + 1
                    while i < n:
                        low = (place - i) // size * size
                        end = min(n, place - low + 1)
                        own, shape = piece[i : end - 1 + length], b"%d,%d:" % (place - i, end - i)
                        core = piece[place - low : place - low - size + 1 + length]
                        rows.append((key, print_of(shape + own), print_of(b"%d:" % low + core), doc, text_hash, start + i, end - i, place - i, own))
                        i = end
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pieces.mapInArrow(read, RANGE)


def print_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def hot_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of windows (doc, text_hash, start, n) of ``pieces`` whose bytes stand in them again, for keys of any number of pieces.

    The windows of a piece are judged in ranges of falling size. Where a range stands again, all its windows do, and one
    copy goes on; where its core does not, none of its windows does, and it goes no further. What is left, ranges of distinct bytes
    about a core that others have, is cut smaller. So what goes on grows with distinct bytes and not with copies.
    """
    found, keep, left = None, [], pieces
    for size in SIZES:
        rows = cut(ranges(left, length, size), "ranges")
        place = F.struct("doc", "text_hash", "start")
        again = rows.groupBy("key", "whole").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
        told = rows.join(again, ["key", "whole"], "left")
        met = cut(told.where("copies > 1").select("doc", "text_hash", "start", "n"), "met-ranges")
        found = met if found is None else found.unionByName(met)
        keep.append(rows)
        if size > 1:
            one = told.where(F.col("copies").isNull() | (F.col("first") == place)).select("key", "core", "doc", "text_hash", "start", "place", "piece")
            shared = one.groupBy("key", "core").agg(F.count("*").alias("n")).where("n > 1").select("key", "core")
            left = cut(one.join(shared, ["key", "core"], "left_semi").select([x.split()[0] for x in PIECE.split(", ")]), "ranges-left")
            keep.append(left)
    discard(*keep)
    return found


class Suffixes:
    """A suffix array: the windows of some pieces of text, in the order of their bytes.

    doc, text_hash and start tell where a piece comes from, offset where it stands in ``text``;
    order holds the places of the windows in ``text``.
    """

    COLUMNS = {"doc": "<i8", "text_hash": "<i8", "start": "<i8", "offset": "<i4", "order": "<i4"}
    SCHEMA = "shard long, text binary, " + ", ".join(f"{c} binary" for c in COLUMNS)

    def __init__(self, text: bytes, length: int, **columns: np.ndarray):
        self.text, self.length = text, length
        for c in self.COLUMNS:
            setattr(self, c, columns[c])

    @classmethod
    def of(cls, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, pieces: list[bytes], length: int) -> Suffixes:
        sizes = np.array([len(x) for x in pieces], np.int64)
        offset, n = np.cumsum(sizes) - sizes, sizes - length + 1
        every = np.repeat(offset - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = cls(b"".join(pieces), length, doc=doc, text_hash=text_hash, start=start, offset=offset, order=every)
        own.order = every[np.argsort(own.keys(), kind="stable")]
        return own

    @classmethod
    def read(cls, row: dict, length: int) -> Suffixes:
        return cls(row["text"], length, **{c: np.frombuffer(row[c], kind).astype(np.int64) for c, kind in cls.COLUMNS.items()})

    def table(self, shard: int) -> pa.Table:
        columns = {"text": self.text} | {c: getattr(self, c).astype(kind).tobytes() for c, kind in self.COLUMNS.items()}
        return pa.table({"shard": pa.array([shard], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in columns.items()})

    def keys(self) -> np.ndarray:
        """The bytes of the windows, in order; of one length, so their comparison is that of the bytes."""
        if not len(self.order):
            return np.empty(0, f"S{self.length}")
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.text, np.uint8), self.length)
        return np.ascontiguousarray(windows[self.order]).view(f"S{self.length}").reshape(-1)

    def twice(self) -> np.ndarray:
        """Which windows equal a neighbour in the order: those that stand in this array again."""
        keys = self.keys()
        same = keys[1:] == keys[:-1]
        return np.r_[False, same][: len(keys)] | np.r_[same, False][: len(keys)]

    def scan(self, other: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Which windows of this array, and of the other, stand in both: their orders are merged."""
        mine, others = self.keys(), other.keys()
        low, high = np.searchsorted(others, mine, "left"), np.searchsorted(others, mine, "right")
        met = np.zeros(len(others) + 1, np.int64)
        np.add.at(met, low, 1)
        np.add.at(met, high, -1)
        return high > low, np.cumsum(met)[:-1] > 0

    def merged(self, other: Suffixes) -> Suffixes:
        """One array of both: each window of the other is put before the first of this one that is not smaller."""
        place = np.searchsorted(self.keys(), other.keys(), "left")
        order = np.insert(self.order, place, other.order + len(self.text))
        joined = {c: np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("doc", "text_hash", "start")}
        return Suffixes(self.text + other.text, self.length, offset=np.concatenate([self.offset, other.offset + len(self.text)]), order=order, **joined)

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, text_hash, start, n) of neighbouring marked windows of a piece."""
        at = np.sort(self.order[marked])
        piece = np.searchsorted(self.offset, at, side="right") - 1
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])][: len(at)])
        own = piece[new]
        return self.doc[own], self.text_hash[own], self.start[own] + at[new] - self.offset[own], np.diff(np.r_[new, len(at)])


class LevelFamily:
    """Suffix arrays in levels, each a table of the shared folder with a row for each shard, that outlive a batch.

    Adding a batch gives the runs of windows that stand in it twice, or in it and in a level.
    Levels of one size are merged before the next scan, so n batches lie in at most log2(n) + 1 levels.
    """

    RUN = "doc long, text_hash long, start long, n int"

    def __init__(self, n_shards: int, length: int):
        self.n_shards, self.length = n_shards, length
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, pieces: DataFrame) -> DataFrame:
        length = self.length

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            return Suffixes.of(*(rows.column(c).to_numpy() for c in ("doc", "text_hash", "start")), raw_bytes(rows.column("piece")), length).table(key[0].as_py())

        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, cut(self._merge(a, b), "level")))
            discard(a, b)
        new = cut(pieces.withColumn("shard", F.pmod("key", F.lit(self.n_shards))).drop("key").groupBy("shard").applyInArrow(build, Suffixes.SCHEMA), "level")
        rows = new.withColumn("level", F.lit(-1))
        for i, (_, level) in enumerate(self.levels):
            rows = rows.unionByName(level.withColumn("level", F.lit(i)))

        def scan(key: tuple, rows: pa.Table) -> pa.Table:
            found, own, marked = [], None, np.empty(0, bool)
            for row in rows.sort_by("level").to_pylist():
                held = Suffixes.read(row, length)
                if row["level"] < 0:
                    own, marked = held, held.twice()
                elif own is not None:
                    here, there = own.scan(held)
                    marked |= here
                    found.append(held.runs(there))
            if own is not None:
                found.append(own.runs(marked))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 4
            return pa.table({c: pa.array(x, pa.int32() if c == "n" else pa.int64()) for c, x in zip(("doc", "text_hash", "start", "n"), columns, strict=True)})

        met = cut(rows.groupBy("shard").applyInArrow(scan, self.RUN), "met-windows")
        self.levels.append((1, new))
        return met

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        length = self.length

        def join(key: tuple, rows: pa.Table) -> pa.Table:
            held = [Suffixes.read(x, length) for x in rows.sort_by("level").to_pylist()]
            return (held[0] if len(held) == 1 else held[0].merged(held[1])).table(key[0].as_py())

        both = a.withColumn("level", F.lit(0)).unionByName(b.withColumn("level", F.lit(1)))
        return both.groupBy("shard").applyInArrow(join, Suffixes.SCHEMA)

    def close(self) -> None:
        """Delete the levels; leave this out to add further batches later."""
        discard(*(x for _, x in self.levels))


def repeated_windows(pieces: DataFrame, length: int, batches: int) -> DataFrame:
    """Runs of windows (doc, text_hash, start, n) of ``pieces`` whose bytes stand in them again."""
    hot = cut(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot-keys")
    met = None if hot.isEmpty() else hot_windows(pieces.join(hot, "key", "left_semi").select(*pieces.columns), length)
    dealt = pieces.join(hot, "key", "left_anti").drop("place")
    dealt = cut(dealt.withColumn("batch", F.pmod(F.xxhash64("doc", "text_hash"), F.lit(batches))), "pieces")
    size = dealt.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    family = LevelFamily(max(1, -(-size // SHARD)), length)
    for i in range(batches):
        found = family.add(dealt.where(F.col("batch") == i).drop("batch"))
        met = found if met is None else met.unionByName(found)
    family.close()
    discard(dealt, hot)
    return met.distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = ANCHOR, with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """Operator 6: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and ``kept``, bytes, if asked).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this or
    another document; all copies go, the first too. Strings do not cross documents. Null and
    empty texts have no bytes; texts shorter than ``length`` stay. Repeated rows are copies of each
    other. Extra columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # keys that are never null, so that both joins below deal the texts alike and Spark shuffles them once
    doc_id = F.col("doc_id").cast("long")
    own = docs.select(doc_id, F.xxhash64(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    shared = cut(standing_again(scan(own, length, width)), "suffixes")
    pieces = cut(window_pieces(own, shared.where("counted"), length), "window-pieces")
    single = repeated_windows(pieces, length, batches)
    discard(pieces)
    found = shared.where("whole").select("doc", "text_hash", "start", "n").unionByName(single)
    spans = found.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, own in zip(batch.column("doc_id").to_pylist(), raw_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, gone, n_spans, end = [], 0, 0, 0
                for x in own or ():
                    a, b = x["start"], x["start"] + x["n"] - 1 + length
                    if not n_spans or a > end:
                        kept.append(raw[end:a])
                        n_spans, gone, end = n_spans + 1, gone + b - a, b
                    elif b > end:
                        gone, end = gone + b - end, b
                kept.append(raw[end:])
                rest = b"".join(kept)
                rows.append((doc_id, len(raw), gone, n_spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    both = own.join(spans, ["doc", "text_hash"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
