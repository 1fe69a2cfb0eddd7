"""Operators 1 and 7: documents as token ids, packed into sequences.

Ids come from a public byte-level BPE vocabulary. Its pre-tokeniser never joins
text across a single space, so a text is cut at spaces and each distinct chunk is
encoded once per worker and kept (bounded); texts with runs of spaces are encoded
whole. The ids are those the ``tokenizers`` library gives; as there, the spelling of an
added token such as ``<|endoftext|>`` is that token, and a text is cut at it first.

Operator 1 (:func:`token_matrices`) packs by best-fit decreasing: a segment tree
over remaining capacities finds the fullest bin that still takes a piece.
Operator 7 (:func:`pack_documents`) packs by minimum bin slack: a bitset
subset-sum over the multiset of remaining lengths finds the filling closest to
the window, and counts are traced back.

Both cut an overlong document into full windows and a rest, losing no id, and
deal pieces by a hash of the document into shards of a bounded number of
documents, the windows of a long one into one shard after the other; a shard is packed
by one task, so sources and documents of any size spread evenly.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import shards_for

WINDOW = 2048
#: Documents a shard holds on average.
PER_SHARD = 4096
#: Distinct chunks a Python worker remembers.
CACHE = 400_000
#: Ids of an end-of-document mark, appended to every document.
END = 1


class ChunkEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes. ``added``: ids of whole spellings that are cut out first."""

    def __init__(self, path: str, added: dict[str, int], limit: int = CACHE):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit, self.known = limit, {}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.at_added and any(x in text for x in self.added):
            return b"".join(self.added.get(x) or self.plain(x) for x in self.at_added.split(text) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        # a run of spaces, or one that ends the text, is matched together with its neighbours
        if "  " in text or text[-1:] == " ":
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
        except KeyError:
            pass
        parts, known = [self.whole(first)], self.known
        for chunk in rest:
            got = known.get(chunk)
            if got is None:
                got = self.whole(" " + chunk)
                if len(known) < self.limit and len(chunk) < 64:
                    known[chunk] = got
            parts.append(got)
        return b"".join(parts)


_encoders: dict[str | None, ChunkEncoder] = {}


def encoder(path: str | None) -> ChunkEncoder:
    """One encoder a worker and vocabulary. ``path``: ranks of a byte-level BPE, without added tokens; None: the public 50k one, with its added tokens."""
    if path not in _encoders:
        added: dict[str, int] = {}
        ranks = path
        if path is None:
            import public_tokenizers

            ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
                added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        _encoders[path] = ChunkEncoder(ranks, added)
    return _encoders[path]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


class FillTree:
    """Open bins by remaining capacity, in a segment tree that counts bins.

    ``best(size)`` is the smallest capacity of at least ``size`` that some bin
    has, found on the way up and down the tree in O(log window).
    """

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, bin_id: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_id)
        self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.bins[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def best(self, size: int) -> int | None:
        at = self.base + size
        if self.count[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces are taken from the longest, ties in order."""
    tree, placed, n_bins = FillTree(window), [(0, 0)] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.best(sizes[i])
        if room is None:
            bin_id, room, n_bins = n_bins, window, n_bins + 1
        else:
            bin_id = tree.take(room)
        placed[i] = bin_id, window - room
        if room > sizes[i]:
            tree.add(room - sizes[i], bin_id)
    return placed


def fullest_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``, as length -> count.

    Bit s of a row says that sum s can be reached with the lengths so far; a count c is
    dealt in powers of two, so a row is a few shifts. Rows are walked back from the best sum.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, part = min(counts[size], room // size), 1
        while left:
            part = min(part, left)
            steps.append((size, part, reach))
            reach |= reach << size * part & full
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, Counter()
    for size, part, before in reversed(steps):
        if not before >> best & 1:
            best -= size * part
            used[size] += part
    return used


def minimum_bin_slack(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece. A bin opens with the longest piece left and takes the filling
    closest to the window; the same filling is used for as many bins as the counts allow."""
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[i], []).append(i)
    counts = {s: len(x) for s, x in by_size.items()}
    order, placed, bin_id = sorted(counts), [(0, 0)] * len(sizes), 0
    while order:
        longest = order[-1]
        counts[longest] -= 1
        used = Counter(fullest_subset({s: c for s, c in counts.items() if c}, window - longest))
        counts[longest] += 1
        used[longest] += 1
        for _ in range(min(counts[s] // c for s, c in used.items())):
            offset = 0
            for size in sorted(used, reverse=True):
                for _ in range(used[size]):
                    placed[by_size[size].pop()] = bin_id, offset
                    offset += size
            bin_id += 1
        for s in used:
            counts[s] = len(by_size[s])
        while order and not counts[order[-1]]:
            order.pop()
    return placed


def narrow(ids: bytes, width: int) -> bytes:
    """4-byte ids as ids of ``width`` bytes."""
    if width == 4:
        return ids
    held = np.frombuffer(ids, "<u4")
    if held.max(initial=0) > 0xFFFF:
        raise ValueError(f"id {held.max()} does not fit 2 bytes; ask for wide ids")
    return held.astype("<u2").tobytes()


def pieces(docs: DataFrame, vocabulary: str | None, window: int, end: int, n_shards: int, with_ids: int) -> DataFrame:
    """A row for each window-sized piece and each rest of a document, with the shard that packs it.

    ``with_ids``: bytes an id in a column ids, 0 for none. Ids that do not fit are refused.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long" + ", ids binary" * bool(with_ids)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = encoder(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True):
                ids = encode(text) + mark
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, window)):
                    piece = ids[4 * at : 4 * (at + window)]
                    row = doc_id, at, len(piece) // 4, zlib.crc32(piece), n, (shard + k) % n_shards
                    rows.append((*row, narrow(piece, with_ids)) if with_ids else row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (6 + bool(with_ids))
            kinds = [pa.int64()] * 6 + [pa.binary()] * bool(with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard")
    return docs.select(F.col("doc_id").cast("long"), shard, F.col("text").cast("string")).mapInArrow(cut_up, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END, per_shard: int = PER_SHARD) -> DataFrame:
    """Operator 7: a row for each piece with its place, packed by minimum bin slack.

    Every document, also one with null or empty text, ends with ``end`` and so has a
    piece. Repeated rows are packed as often as they occur. Extra columns are ignored.
    An empty table gives no row. Sequences are numbered within their shard, below the
    shard's number shifted by 32 bits.
    """

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at = minimum_bin_slack(rows.column("length").to_pylist(), window)
        bins, offsets = np.array(at, np.int64).reshape(-1, 2).T
        rows = rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
        return rows.append_column("offset", pa.array(offsets))

    cut_up = pieces(docs, vocabulary, window, end, shards_for(docs.count(), per_shard), 0)
    return cut_up.groupBy("shard").applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def token_matrices(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END, pad: int = 50256, wide: bool = False, per_shard: int = PER_SHARD) -> DataFrame:
    """Operator 1: one row per packed sequence, by best-fit decreasing.

    Columns: sequence_id; n_tokens; ids, the row of the id matrix (``window`` little-endian
    unsigned ids of 2 bytes, 4 if ``wide``, padded with ``pad``; larger ids are refused; n_tokens tells
    padding from an equal id of a text); cu_seqlens, cumulative lengths
    from 0 to n_tokens; position_ids, 2- or 4-byte positions that restart at 0 with each piece and
    in the padding; doc_ids and doc_starts, the piece behind each segment. Joining a document's
    pieces by start gives back its ids. Documents with null or empty text are their end mark;
    repeated rows are packed as often as they occur; an empty table gives no row.
    """
    kind = "<u4" if wide else "<u2"
    if not wide and max(window, pad, end) > 0xFFFF:
        raise ValueError("window, pad and end must fit 2 bytes; ask for wide ids")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows.column("length").to_pylist()
        members: dict[int, list[int]] = {}
        for i, (bin_id, _) in enumerate(best_fit_decreasing(sizes, window)):
            members.setdefault(bin_id, []).append(i)
        ids, doc_ids, starts = (rows.column(c).to_pylist() for c in ("ids", "doc_id", "start"))
        out: dict[str, list] = {c: [] for c in ("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts")}
        padding = np.full(window, pad, kind).tobytes()
        counting = np.arange(window, dtype=kind).tobytes()
        width = np.dtype(kind).itemsize
        for bin_id, own in members.items():
            n = sum(sizes[i] for i in own)
            out["sequence_id"].append((key[0].as_py() << 32) + bin_id)
            out["n_tokens"].append(n)
            out["ids"].append(b"".join(ids[i] for i in own) + padding[: (window - n) * width])
            out["cu_seqlens"].append([0, *np.cumsum([sizes[i] for i in own]).tolist()])
            out["position_ids"].append(b"".join(counting[: sizes[i] * width] for i in own) + counting[: (window - n) * width])
            out["doc_ids"].append([doc_ids[i] for i in own])
            out["doc_starts"].append([starts[i] for i in own])
        kinds = {"sequence_id": pa.int64(), "n_tokens": pa.int32(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "position_ids": pa.binary(), "doc_ids": pa.list_(pa.int64()), "doc_starts": pa.list_(pa.int64())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    cut_up = pieces(docs, vocabulary, window, end, shards_for(docs.count(), per_shard), 4 if wide else 2)
    return cut_up.groupBy("shard").applyInArrow(pack, "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>")


def write_matrices(sequences: DataFrame, path: str) -> None:
    """Write the sequences of :func:`token_matrices` as Parquet, one row a sequence; an existing path is refused.

    Rows of a file lie in the order of their numbers, so the column ids of a file, joined, is a matrix.
    """
    sequences.sortWithinPartitions("sequence_id").write.parquet(path)
