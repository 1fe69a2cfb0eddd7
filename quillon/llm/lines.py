"""Operator 3: lines that are equal or a few edits apart.

Two lines at most ``e`` edits apart share a piece: cut one into e + 1 segments, and at least one
segment stands unchanged in the other, within a few places of where it was. So each line is
indexed by its length and segments, and probed with the substrings that length and place allow.

A key (segment, length, substring) passes on its lines only if it joins two of them; texts are
joined to these lines alone. Lines of a key meet in blocks, each pair at the first segment that
joins it, and are compared by a banded bit-parallel edit distance over many pairs at once. A task
gives sums by line and links that span what it found, so rows grow with the lines and not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, Fingerprints, components, cut, mix64, sorted_groups, spanning

EDITS = 2
#: Characters a line must have for each edit that it allows.
PER_EDIT = 12
#: Letters whose numbers in two lines are compared before the lines are read.
COUNTED = "eantohri"
#: Pairs that are looked at together, and characters of lines compared together.
PAIRS, CELLS = 1 << 19, 1 << 22
#: Lines of a key that one block holds of either side.
BLOCK = 2000
#: Rows of a key above which its lines are passed on unread.
LARGE = 4000
#: Lines above this length are compared one pair at a time.
LONG = 600


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit vectors of the 2 * most + 1 cells beside the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    skip = len(commonprefix((a, b)))
    a, b = a[skip:], b[skip:]
    end = len(commonprefix((a[::-1], b[::-1])))
    if end:
        a, b = a[:-end], b[:-end]
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) <= most:
        return len(a) <= most
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    width = 2 * most + 1
    mask, low = (1 << width) - 1, 1 << (width - 1)
    # column 0: below the diagonal each cell is one more than the cell above it
    rises, falls, distance = mask & ~((1 << most) - 1), 0, most
    for j, c in enumerate(b):
        equal = at.get(c, 0) << most >> j & mask
        down = ((equal & rises) + rises ^ rises | equal | falls) & mask
        right, left = (falls | ~(down | rises)) & mask, down & rises
        if j + most < len(a):
            distance += not down & low
        else:  # the band has reached the last row; follow it
            row = 1 << (width - 2 - (j + most - len(a)))
            distance += bool(right & row) - bool(left & row)
        if distance > 2 * most:
            return False
        rises, falls = (left | ~(down >> 1 | right)) & mask, down >> 1 & right
    return distance <= most


def segments(n: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and sizes of the segments of lines of n characters; the later ones may be longer by one."""
    short = parts - n % parts
    return [(n // parts * i + np.maximum(0, i - short), n // parts + (i >= short)) for i in range(parts)]


class Lines:
    """A batch of lines, as characters one after the other."""

    def __init__(self, texts: list[str], edits: int, per_edit: int):
        self.texts, self.edits, self.per_edit = texts, edits, per_edit
        self.n = np.array([len(x) for x in texts], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.prints = Fingerprints(self.chars)

    def allowed(self, n: np.ndarray) -> np.ndarray:
        """Edits that a shorter line of n characters allows."""
        return np.minimum(np.maximum(n, 0) // self.per_edit, self.edits)

    def _key(self, rows: np.ndarray, i: int, length: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = self.at[rows] + start
        return mix64(self.prints.of(first, first + size) ^ mix64((length * 64 + i).astype(np.uint64) + np.uint64(1)))

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, keys, segments): each line by each of its segments."""
        found = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8))]
        allowed = self.allowed(self.n)
        for e in range(1, self.edits + 1):
            rows = np.flatnonzero(allowed == e)
            for i, (start, size) in enumerate(segments(self.n[rows], e + 1)):
                found.append((rows, self._key(rows, i, self.n[rows], start, size), np.full(len(rows), i, np.int8)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def probe(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, keys): the keys that indexed lines, as long or shorter, within the edits they allow can have.

        A segment i may be moved by at most i, as the i segments before it differ (else an earlier
        one would match), and likewise from the right; the windows of both sides are intersected.
        """
        found_rows, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for shorter in range(self.edits + 1):
            allowed = self.allowed(self.n - shorter)
            for e in range(max(1, shorter), self.edits + 1):
                rows = np.flatnonzero(allowed == e)
                length = self.n[rows] - shorter
                for i, (start, size) in enumerate(segments(length, e + 1)):
                    for move in range(max(-i, shorter - (e - i)), min(i, shorter + e - i) + 1):
                        fits = (start + move >= 0) & (start + move + size <= self.n[rows])
                        found_rows.append(rows[fits])
                        found.append(self._key(rows[fits], i, length[fits], start[fits] + move, size[fits]))
        return np.concatenate(found_rows), np.concatenate(found)

    def letter_counts(self) -> np.ndarray:
        """The numbers of eight letters, modulo 256, as the bytes of one long."""
        out = np.zeros((len(self.n), len(COUNTED)), np.uint8)
        for k, letter in enumerate(COUNTED):
            sums = np.concatenate([[0], np.cumsum(self.chars == ord(letter))])
            out[:, k] = (sums[self.at + self.n] - sums[self.at]) % 256
        return out.view("<i8").reshape(-1)

    def met_before(self, a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Whether a segment of line a before the given one also stands in line b where it may."""
        seen, n, shorter = np.zeros(len(a), bool), self.n[a], self.n[b] - self.n[a]
        allowed = self.allowed(n)
        for e in range(1, self.edits + 1):
            for i in range(e):
                todo = np.flatnonzero((allowed == e) & (segment > i) & ~seen)
                if not len(todo):
                    continue
                start, size = segments(n[todo], e + 1)[i]
                first = self.at[a[todo]] + start
                own = self.prints.of(first, first + size)
                for move in range(-i, i + 1):
                    s = start + move
                    may = (move >= shorter[todo] - (e - i)) & (move <= shorter[todo] + e - i) & (s >= 0) & (s + size <= self.n[b[todo]])
                    first = self.at[b[todo]] + np.where(may, s, 0)
                    seen[todo] |= may & (self.prints.of(first, first + np.where(may, size, 0)) == own)
        return seen

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each line b, as long as line a or longer, lies within the edits that a allows."""
        out, allowed = np.zeros(len(a), bool), self.allowed(self.n[a])
        single = (self.n[b] > LONG) | (self.n[b] <= self.edits)
        for k in np.flatnonzero(single):
            out[k] = within(self.texts[a[k]], self.texts[b[k]], int(allowed[k]))
        many = np.flatnonzero(~single)
        many = many[np.argsort(self.n[a[many]], kind="stable")]
        at = 0
        while at < len(many):
            # some pairs of like length: the longest line of a piece sets its width
            step = max(1, CELLS // (int(self.n[a[many[at]]]) + self.edits + 1))
            own = many[at : at + step]
            longest = int(self.n[b[own]].max())
            own = own[: max(1, CELLS // (longest + 1))]
            out[own] = self._distances(a[own], b[own]) <= allowed[own]
            at += len(own)
        return out

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edit distances up to ``edits`` (more is anything above), by the bit vectors of :func:`within`, for pairs sorted by the length of a."""
        most = self.edits
        width = 2 * most + 1
        mask, low = (1 << width) - 1, 1 << (width - 1)
        n_a, n_b = self.n[a], self.n[b]

        def columns(x: np.ndarray, n: np.ndarray, before: int, after: int, none: int) -> np.ndarray:
            place = np.arange(-before, int(n.max()) + after)[:, None]
            held = self.chars[np.clip(self.at[x][None, :] + place, 0, len(self.chars) - 1)]
            return np.where((place >= 0) & (place < n[None, :]), held, np.uint32(none))

        # no character is as large as these
        long, short = columns(b, n_b, most, most + int((n_a.max() - n_a.min())) + most, 0xFFFFFFFF), columns(a, n_a, 0, 0, 0xFFFFFFFE)
        rises, falls, distance = np.full(len(a), mask & ~((1 << most) - 1), np.int32), np.zeros(len(a), np.int32), np.full(len(a), most, np.int32)
        for j in range(int(n_a.max())):
            k = int(np.searchsorted(n_a, j, side="right"))  # lines before k have ended
            r, f = rises[k:], falls[k:]
            equal = np.zeros(len(r), np.int32)
            for t in range(width):
                equal |= (long[j + t, k:] == short[j, k:]).astype(np.int32) << t
            down = (((equal & r) + r) ^ r | equal | f) & mask
            right, left = (f | ~(down | r)) & mask, down & r
            over = j + most - n_b[k:]
            row = np.int32(1) << np.maximum(width - 2 - np.maximum(over, 0), 0).astype(np.int32)
            distance[k:] += np.where(over < 0, (down & low) == 0, ((right & row) != 0).astype(np.int32) - ((left & row) != 0))
            rises[k:], falls[k:] = (left | ~(down >> 1 | right)) & mask, down >> 1 & right
        return distance


def counts_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much packed letter counts differ in all."""
    d = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8) - np.ascontiguousarray(b).view(np.uint8).reshape(-1, 8)
    return np.minimum(d, np.uint8(0) - d).sum(1, dtype=np.int64)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of each line with a word."""
    rows = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD))


def second_hash() -> Column:
    return F.xxhash64(F.lit(1), "line")


def key_rows(lines: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """key, h, counts, segment: the index rows of each line, and its probes (segment -1)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                held, h = Lines(part.column("line").to_pylist(), edits, per_edit), part.column("h").to_numpy()
                counts = held.letter_counts()
                rows, keys, segment = held.index()
                probing, probes = held.probe()
                rows, keys = np.concatenate([rows, probing]), np.concatenate([keys, probes])
                segment = np.concatenate([segment, np.full(len(probes), -1, np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h[rows]), pa.array(counts[rows]), pa.array(segment)], names=["key", "h", "counts", "segment"])

    return lines.select("line", "h").mapInArrow(read, "key long, h long, counts long, segment tinyint")


def pieces_of_pairs(key: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of index and probe of one key, for rows sorted by key, about PAIRS at a time."""
    index, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    low, high = np.searchsorted(key[index], key[probes], "left"), np.searchsorted(key[index], key[probes], "right")
    some = np.flatnonzero(high > low)
    low, n, probes = low[some], (high - low)[some], probes[some]
    upto, begin = np.cumsum(n), 0
    while begin < len(some):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        each = np.repeat(np.arange(begin, end), n[begin:end])
        place = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[begin:end]) - n[begin:end], n[begin:end])
        yield index[place], probes[each]
        begin = end


def meeting(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (key, h, segment) of keys that join two lines whose letter counts allow ``edits`` edits.

    Rows come sorted by key, index rows first, and are read as a stream: of a key with more than
    ``LARGE`` rows only the first ones are held, and all are passed on if there is an index row.
    """
    names = ["key", "h", "counts", "segment"]

    def out(rows: tuple[np.ndarray, ...], keep: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[i][keep]) for i in (0, 1, 3)], names=["key", "h", "segment"])

    def whole(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, h, counts, segment = rows
        held = np.zeros(len(key), bool)
        for i, j in pieces_of_pairs(key, segment < 0):
            near = np.flatnonzero(h[i] != h[j])
            near = near[counts_differ(counts[i[near]], counts[j[near]]) <= 2 * edits]
            held[i[near]] = held[j[near]] = True
        return out(rows, held)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large, passed = None, None, False
        for batch in batches:
            rows = tuple(batch.column(c).to_numpy() for c in names)
            if large is not None and len(rows[0]):
                more = rows[0] == large
                if passed and more.any():
                    yield out(rows, more)
                rows = tuple(x[~more] for x in rows)
            if not len(rows[0]):
                continue
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
            cut_at = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut_at:
                yield whole(tuple(x[:cut_at] for x in rows))
            rest = tuple(x[cut_at:] for x in rows)
            if len(rest[0]) > LARGE:
                large, passed = rest[0][0], bool((rest[3] >= 0).any())
                if passed:
                    yield out(rest)
                rest = None
        if rest is not None:
            yield whole(rest)

    order = rows.repartition("key").sortWithinPartitions("key", F.col("segment").desc())
    return order.mapInArrow(read, "key long, h long, segment tinyint").dropDuplicates()


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows of a key, index rows in block x and probes in block y, each beside every block of the other side."""
    probe = F.col("segment") < 0
    n = lambda x: F.ceil(F.sum(F.when(x, 1).otherwise(0)) / BLOCK).cast("int")
    sizes = members.groupBy("key").agg(n(~probe).alias("xs"), n(probe).alias("ys")).where("xs > 1 OR ys > 1")
    own = members.join(sizes, "key", "left").withColumns({"xs": F.coalesce("xs", F.lit(1)), "ys": F.coalesce("ys", F.lit(1))})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.array(F.pmod(F.xxhash64("h"), F.col(n)).cast("int"))
    own = own.withColumn("x", F.explode(F.when(probe, every("xs")).otherwise(mine("xs"))))
    return own.withColumn("y", F.explode(F.when(probe, mine("ys")).otherwise(every("ys")))).drop("xs", "ys")


NODE = "struct<doc_id:bigint,line_no:int,h:bigint>"


def linked_lines(lines: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Rows (id, links, to) of distinct lines: numbers of links, to be added up, and links that join what is linked (links 0). ``lines``: id, h, line."""
    met = cut(meeting(key_rows(lines, edits, per_edit), edits), "met-lines")
    # both sides grow with the corpus: one plan at every size, never a broadcast
    dealt = in_blocks(met).join(lines.select("h", "id", "line").hint("merge"), "h")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "segment", "h", "id", "line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["key", "x", "y"]):
            group = rows.column("group").to_numpy()
            ids, h, segment = rows.column("id").combine_chunks(), rows.column("h").to_numpy(), rows.column("segment").to_numpy()
            held = Lines(rows.column("line").to_pylist(), edits, per_edit)
            counts = held.letter_counts()
            links, found = np.zeros(len(h), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            # rows of one line are one node
            _, first, node = np.unique(np.stack([h, held.n], 1), axis=0, return_index=True, return_inverse=True)
            node = first[node.reshape(-1)]
            for i, j in pieces_of_pairs(group, segment < 0):
                longer = held.n[j] - held.n[i]
                may = (longer >= 0) & (longer <= held.allowed(held.n[i])) & ((longer > 0) | (h[i] < h[j]))
                i, j = i[may], j[may]
                near = counts_differ(counts[i], counts[j]) <= 2 * edits
                i, j = i[near], j[near]
                new = ~held.met_before(i, j, segment[i])
                i, j = i[new], j[new]
                sure = held.linked(i, j)
                i, j = i[sure], j[sure]
                links += np.bincount(i, minlength=len(h)) + np.bincount(j, minlength=len(h))
                found.append(spanning(node[i], node[j]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            some = np.flatnonzero(links)
            at = np.concatenate([some, a])
            to = pa.array(np.concatenate([np.zeros(len(some), np.int64), b]), mask=np.arange(len(at)) < len(some))
            counted = np.concatenate([links[some], np.zeros(len(a), np.int64)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(counted), ids.take(to)], names=["id", "links", "to"])

    return dealt.mapInArrow(read, f"id {NODE}, links long, to {NODE}")


def line_classes(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """A row for each distinct line: its hashes h and h2, its first place (doc_id, line_no), copies, n_links, class_doc_id, class_line_no.

    Lines are linked if they lie at most one edit apart for each ``per_edit`` characters of the
    shorter one, and at most ``edits``; so lines under ``per_edit`` characters only equal themselves.
    Links join lines into classes, named by the first place of any line in them. n_links counts the
    other distinct lines linked directly.
    """
    place = F.struct("doc_id", "line_no", F.xxhash64("line").alias("h"))
    lines = line_table(docs).groupBy("line").agg(F.min(place).alias("id"), F.count("*").alias("copies"))
    # two hashes stand for the line, so that texts are not shuffled again
    lines = cut(lines.select("id", F.col("id.h").alias("h"), second_hash().alias("h2"), "line", "copies"), "lines")
    found = cut(linked_lines(lines, edits, per_edit), "line-links")
    degree = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("n_links"))
    told = components(found.where("to IS NOT NULL"), "id", "to").withColumnRenamed("node", "id").join(degree, "id")
    out = lines.drop("line").join(told, "id", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component": F.coalesce("component", "id")})
    return out.select("h", "h2", F.col("id.doc_id").alias("doc_id"), F.col("id.line_no").alias("line_no"), "copies", "n_links", F.col("component.doc_id").alias("class_doc_id"), F.col("component.line_no").alias("class_line_no"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Operator 3: a row for each line with a word: doc_id, line_no, n_links, class_doc_id, class_line_no, kept.

    kept: the line is the first of its class. Null and empty texts have no lines. Lines that occur
    once and link with nothing are their own class. A repeated row is the same place, so both keep
    the same lines. Extra columns are ignored; an empty table gives no row.
    """
    again = line_classes(docs, edits, per_edit).where("copies > 1 OR n_links > 0")
    every = line_table(docs).select("doc_id", "line_no", F.xxhash64("line").alias("h"), second_hash().alias("h2"))
    told = again.select("h", "h2", "n_links", "class_doc_id", "class_line_no")
    out = every.join(told, ["h", "h2"], "left")
    out = out.select("doc_id", "line_no", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_doc_id", "doc_id").alias("class_doc_id"), F.coalesce("class_line_no", "line_no").alias("class_line_no"))
    return out.withColumn("kept", (F.col("doc_id") == F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no")))


def without_repeats(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``docs`` (doc_id, text and others) with lines that repeat an earlier class taken out of the texts.

    A document that loses its last line with a word goes; one that had none stays as it is.
    """
    drop = dedup_lines(docs, edits, per_edit).where(~F.col("kept")).groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop"))
    text = F.col("text").cast("string")
    stays = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), i))
    out = docs.join(drop, "doc_id", "left").withColumn("_left", F.when(F.col("_drop").isNotNull(), F.array_join(stays, "\n")).otherwise(text))
    out = out.where(F.col("_drop").isNull() | F.col("_left").rlike(WORD))
    return out.withColumn("text", F.col("_left")).select(docs.columns)
