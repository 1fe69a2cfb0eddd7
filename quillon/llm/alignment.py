"""Operator 13: which tokens of two tokenizers meet, and how often each pair meets in the corpus.

Tokenizer A is a byte-level BPE, B a BPE of pieces with bytes to fall back on. Both spell a space and the text, so their
tokens are two partitions of the same bytes: byte ends that both have cut them into groups, and tokens are linked where
their bytes overlap. A text is aligned as two rising rows of byte ends.

Counts come from inverted bitmaps. A task numbers its documents in blocks of at most 65,536 and turns the links of a
block into postings: for each pair of ids one compressed bitmap of the block's documents that hold it (16-bit numbers,
or a bit for each document where that is shorter), and one for each binary digit of the further links
there, the multiplicity planes. Bitmaps of one pair in one block are merged by OR. Document counts are bits set in plane
0, summed over blocks; only (pair, bits) is shuffled for that, added up before. The best count of an A id is a maximum
over its pairs. Postings then take the counts of their pair and go back, by block, to the task that adds up the scores
of the block's documents. No pair is listed once for each document but in its bitmap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut
from quillon.llm.packing import encoder

#: Documents that 16 bits can number.
BLOCK = 1 << 16
#: Links that a task holds before it closes a block.
HELD = 1 << 21
SPACE_MARK = "▁"

ROWS = "block long, plane int, pair long, n int, docs binary, doc_id long, low int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: The plane of a row that is a document and no posting.
DOC = -1


class Aligned(NamedTuple):
    """Numbers of tokens and groups of a text, digest of its groups, and its links as a_id * n_b + b_id."""

    n_a: int
    n_b: int
    n_groups: int
    digest: str
    pairs: np.ndarray


NOTHING = Aligned(0, 0, 0, "", np.empty(0, np.int64))


def ends_shared(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A, and of B, end where one of the other ends."""
    return end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of tokens that share a byte; ends rise in both, to the same last one."""
    first = np.concatenate([[0], np.searchsorted(end_b, end_a[:-1], "right")])
    n = np.searchsorted(end_b, end_a) + 1 - first
    at_a = np.repeat(np.arange(len(end_a)), n)
    return at_a, np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str, n_b: int):
        import sentencepiece

        # ranks alone: special tokens in a text are text
        self.encoding, self.model, self.n_b = encoder(path_a).encoding, sentencepiece.SentencePieceProcessor(model_file=path_b), n_b
        n_a, pieces = self.encoding.n_vocab, [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if len(pieces) > n_b:
            raise ValueError(f"tokenizer B has {len(pieces)} ids, more than {n_b}")
        self.spelled_a = [self.encoding.decode_single_token_bytes(i) for i in range(n_a)]
        self.spelled_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.spelled_a, self.spelled_b))
        # an id with what stands behind it: in its group or at its end, for A and for B
        self.n_a, ends = n_a, ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";"))
        self.written = np.array([b"%d%s" % (i, end) for n, end in ends for i in range(n)], object)

    def groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[int, bytes]:
        """Number of groups, and the groups: `a1,a2|b1;a3|b2,b3`."""
        last_a, last_b = ends_shared(end_a, end_b)
        cut_a, cut_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        out = np.empty(len(a) + len(b), np.int64)
        # ids of A stand behind all of B in earlier groups, those of B behind all of A up to their own
        out[np.arange(len(a)) + np.concatenate([[0], cut_b])[np.cumsum(last_a) - last_a]] = a + last_a * self.n_a
        out[np.arange(len(b)) + cut_a[np.cumsum(last_b) - last_b]] = b + 2 * self.n_a + last_b * self.n_b
        return len(cut_a), b"".join(self.written[out].tolist())[:-1]

    def __call__(self, text: str | None) -> Aligned:
        """``text`` behind a space; nothing if a tokenizer does not spell just that."""
        if not text or SPACE_MARK in text:
            return NOTHING
        a, b = self.encoding.encode_ordinary(" " + text), self.model.encode(text, num_threads=1)
        if not b"".join([self.spelled_a[i] for i in a]) == b"".join([self.spelled_b[i] for i in b]) == b" " + text.encode():
            return NOTHING
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        n_groups, written = self.groups(a, b, end_a, end_b)
        at_a, at_b = links(end_a, end_b)
        return Aligned(len(a), len(b), n_groups, hashlib.sha256(written).hexdigest(), a[at_a] * self.n_b + b[at_b])


_aligners: dict[tuple, Aligner] = {}


def aligner_of(path_a: str | None, path_b: str | None, n_b: int) -> Aligner:
    """The tokenizers of this worker. Paths: ranks of a byte-level BPE and a piece model; None: the public ones."""
    import public_tokenizers

    key = path_a or public_tokenizers.path("byte_bpe_50k.tiktoken"), path_b or public_tokenizers.path("piece_bpe_32k.model"), n_b
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def container(low: np.ndarray) -> bytes:
    """A set of 16-bit numbers, rising: the numbers, or from 4,096 on a bit for each."""
    if len(low) < 4096:
        return low.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(held: bytes) -> np.ndarray:
    """The numbers of a container; one of 8,192 bytes is a bit for each."""
    if len(held) < BLOCK // 8:
        return np.frombuffer(held, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))


def containers(key: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys, numbers of members and containers of sorted rows (key, low)."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool))
    sizes = np.diff(np.append(first, len(key)))
    flat = low.astype("<u2")
    if (sizes >= 4096).any():
        held = [container(low[f : f + n]) for f, n in zip(first.tolist(), sizes.tolist())]
        return key[first], sizes, pa.array(held, pa.binary())
    ends = np.concatenate([[0], np.cumsum(sizes) * 2]).astype(np.int32)
    return key[first], sizes, pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


class Block:
    """Documents and links of a block, not yet in bitmaps."""

    def __init__(self, number: int):
        self.number, self.docs, self.n_links = number, [], 0
        self.pairs: list[np.ndarray] = []
        self.lows: list[np.ndarray] = []

    def add(self, doc_id: int | None, found: Aligned) -> None:
        low, n = len(self.docs), len(found.pairs)
        self.docs.append((doc_id, low, found.n_a, found.n_b, found.n_groups, n, found.digest))
        if n:
            self.pairs.append(found.pairs)
            self.lows.append(np.full(n, low, np.int64))
            self.n_links += n

    def rows(self) -> Iterator[pa.RecordBatch]:
        schema = [x.split() for x in ROWS.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

        def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["block"] = pa.array(np.full(size, self.number), pa.int64())
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kinds[k])) for c, k in schema], names=[c for c, _ in schema])

        names = ("doc_id", "low", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        said = {c: pa.array([x[i] for x in self.docs], kinds[dict(schema)[c]]) for i, c in enumerate(names)}
        yield batch(len(self.docs), plane=pa.array(np.full(len(self.docs), DOC), pa.int32()), **said)
        if not self.pairs:
            return
        key = np.concatenate(self.pairs) * BLOCK + np.concatenate(self.lows)
        # rows of one pair and document come together here: their bits are merged, and what is more than one goes to the planes
        key, many = np.unique(key, return_counts=True)
        pair, low, more = key >> 16, key & (BLOCK - 1), many - 1
        for plane in range(1 + int(more.max()).bit_length()):
            here = slice(None) if plane == 0 else (more >> (plane - 1) & 1).astype(bool)
            met, n, docs = containers(pair[here], low[here])
            yield batch(len(met), plane=pa.array(np.full(len(met), plane), pa.int32()), pair=pa.array(met), n=pa.array(n, pa.int32()), docs=docs)


def _postings(path_a: str | None, path_b: str | None, n_b: int, held: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_text, task, n_blocks = aligner_of(path_a, path_b, n_b), TaskContext.get().partitionId(), 0
        block = Block(task << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                block.add(doc_id, align_text(text))
                if len(block.docs) == BLOCK or block.n_links >= held:
                    yield from block.rows()
                    n_blocks += 1
                    block = Block((task << 32) + n_blocks)
        if block.docs:
            yield from block.rows()

    return read


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of each block, which come sorted by block with the documents first. Holds one block."""
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    block, docs, best, total = None, [], np.empty(0, np.int64), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(docs).combine_chunks()
        low = rows.column("low").to_numpy()
        held = {c: rows.column(c).combine_chunks() for c in names if c in rows.column_names}
        held |= {"n_best": pa.array(best[low]), "count_sum": pa.array(total[low])}
        return pa.RecordBatch.from_arrays([held[c] for c in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        of, plane = batch.column("block").to_numpy(), batch.column("plane").to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() + [len(of)]
        for start, end in zip(bounds, bounds[1:]):
            if of[start] != block:
                if docs:
                    yield out()
                block, docs = of[start], []
                best, total = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            n_docs = int((plane[start:end] == DOC).sum())
            if n_docs:
                docs.append(batch.slice(start, n_docs))
            rows = batch.slice(start + n_docs, end - start - n_docs)
            if not rows.num_rows:
                continue
            kept = [members(x) for x in rows.column("docs").to_pylist()]
            sizes = [len(x) for x in kept]
            # plane 0 is a link, plane k + 1 is 2**k further ones
            weight = np.left_shift(1, np.maximum(rows.column("plane").to_numpy().astype(np.int64) - 1, 0))
            low = np.concatenate(kept)
            np.add.at(total, low, np.repeat(weight * rows.column("count").to_numpy(), sizes))
            np.add.at(best, low, np.repeat(weight * rows.column("best").to_numpy(), sizes))
    if docs:
        yield out()


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), links (how often), from plane and bits set of each posting."""
    weight = F.when(F.col("plane") == 0, 1).otherwise(F.pow(F.lit(2), F.col("plane") - 1)).cast("long")
    return postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("count"), F.sum(F.col("n") * weight).alias("links"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, n_b: int = 32_000, held: int = HELD) -> DataFrame:
    """Operator 13: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text).

    ``path_a``: ranks of a byte-level BPE, ``path_b``: a piece model of ``n_b`` ids; None: the public ones. Null and
    empty texts, and those that either tokenizer does not spell byte for byte, have no tokens: zeros and ''. A document
    is a row, so repeated rows are counted each; doc_id is carried along and may be null. Ties for the best count are all
    best. An empty table gives an empty table. Other columns are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(read.mapInArrow(_postings(path_a, path_b, n_b, held), ROWS), "postings")
    postings = rows.where(F.col("plane") >= 0)
    counts = pair_counts(postings).drop("links").withColumn("a", F.floor(F.col("pair") / n_b))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    keys = ["doc_id", "low", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    known = postings.select("pair", "block", "plane", "docs").join(counts, "pair").select("block", "plane", "docs", "count", "best")
    known = known.unionByName(rows.where(F.col("plane") == DOC).select("block", "plane", *keys), allowMissingColumns=True)
    scored = known.repartition("block").sortWithinPartitions("block", "plane").mapInArrow(
        _returned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return scored
