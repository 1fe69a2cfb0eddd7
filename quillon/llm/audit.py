"""Operator 12: what each of five filters removes, in each of their 120 orders.

A document is told by the mask of the filters that it fails and by its two labels, so the outcome of all
orders and steps is a function of 32 masks and 4 pairs of labels. Each of these is mapped to one big integer of
3,005 fields of 64 bits (:func:`packed_outcomes`): for each of the 600 steps what happens there, and five fields
for failures of one filter alone. A field counts documents, of which there are fewer than 2**63, so sums never run
over into the next field. Tasks add the integers of their documents per part; sums are added per part and share
of the tasks, then per part, and unpacked into 600 rows.

A copy fails filter E if a smaller doc_id holds the same text. Texts are told apart by 128 bits of a digest with their
length; the smallest doc_id of a text comes from rows that are counted before they are shuffled, so a text that fills a
third of the table is a row for each task, part and pair of labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import raw_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: 64-bit fields of a packed counter: outcomes of each order and step, then failures of one filter only.
N_FIELDS = len(ORDERS) * len(FILTERS) * len(OUTCOMES) + len(FILTERS)
#: Parts that a task holds before it hands its sums on.
HELD_PARTS = 256
#: Shares of tasks whose sums are added first.
SHARES = 64

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcomes(mask: int, good: int, toxic: int) -> np.ndarray:
    """The fields of one document that fails the filters of ``mask`` (bit i: filter i)."""
    held = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
    for i, order in enumerate(ORDERS):
        inside = True
        for k, letter in enumerate(order):
            fails = mask >> FILTERS.index(letter) & 1
            here = inside and fails
            redundant = fails and not inside
            inside = inside and not fails
            held[i, k] = inside, here, redundant, here and good, here and toxic
    alone = [mask == 1 << i for i in range(len(FILTERS))]
    return np.concatenate([held.ravel(), np.array(alone, "<u8")])


@lru_cache(maxsize=1)
def packed_outcomes() -> list[int]:
    """The big integer of each mask and pair of labels, at mask * 4 + good * 2 + toxic."""
    return [int.from_bytes(outcomes(m, g, t).tobytes(), "little") for m in range(1 << len(FILTERS)) for g in (0, 1) for t in (0, 1)]


def unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(8 * N_FIELDS, "little"), "<u8").astype(np.int64)


def to_bytes(total: int) -> bytes:
    return total.to_bytes(8 * N_FIELDS, "little")


_UPPER, _MARK = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_MARK[[ord(c) for c in "#$%&*|"]] = 1
#: Bytes that begin a code point.
_BEGINS = np.array([(x & 0xC0) != 0x80 for x in range(256)], np.int64)


def own_mask(text: bytes) -> int:
    """Filters A to D that a text fails; words are what ASCII white space parts."""
    words = text.split()
    n, data = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    few, poor = n < 100, 100 * len(set(words)) < 80 * n
    loud = 100 * int(data @ _UPPER) > 10 * int(data @ _BEGINS)
    return few | poor << 1 | loud << 2 | bool(data @ _MARK) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = raw_bytes(batch.column("text"))
        masks = pa.array([own_mask(x) for x in texts], pa.int32())
        digests = pa.array([hashlib.blake2b(x, digest_size=16).digest() + len(x).to_bytes(5, "little") for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], names=["doc_id", "part", "mask", "digest"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail just the filters of ``mask`` (bits 0 to 4 for A to E); rows of equal keys are not yet added up."""
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    own = read.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary")
    # rows without a doc_id have no label: they are spread by their text
    own = own.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")).withColumn("spread", F.lit(0).cast("long"))
    told = own.join(told, ["doc_id", "spread"], "left").select("doc_id", "spread", "digest", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    keys = ["digest", "part", "mask", "quality", "toxic"]
    rows = told.groupBy("doc_id", "spread", *keys).agg(F.count("*").alias("n"))
    some = F.col("doc_id").isNotNull()
    alike = rows.groupBy(keys).agg(
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(some, F.struct("doc_id", "n"))).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("stay", F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0))
    sides = F.array(F.struct(F.col("mask").alias("mask"), (F.col("stay") + F.col("n_null")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    return alike.select("part", F.col("quality").alias("good"), "toxic", F.explode(sides).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the big integers of a task's rows, one for each part."""
    held: dict[str, int] = {}
    share, kinds = TaskContext.get().partitionId() % SHARES, packed_outcomes()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([share] * len(held), pa.int32()), pa.array([to_bytes(x) for x in held.values()], pa.binary())], names=["part", "share", "packed"])

    for batch in batches:
        kind = batch.column("mask").to_numpy() * 4 + batch.column("good").to_numpy() * 2 + batch.column("toxic").to_numpy()
        part = batch.column("part").dictionary_encode()
        code, n = part.indices.to_numpy() * len(kinds) + kind, batch.column("n").to_numpy()
        met, at = np.unique(code, return_inverse=True)
        sums = np.zeros(len(met), np.int64)
        np.add.at(sums, at, n)
        names = part.dictionary.to_pylist()
        for c, total in zip(met.tolist(), sums.tolist()):
            name = names[c // len(kinds)]
            held[name] = held.get(name, 0) + total * kinds[c % len(kinds)]
        if len(held) > HELD_PARTS:
            yield out()
            held.clear()
    if held:
        yield out()


def _total(batches: Iterator[pa.RecordBatch]) -> tuple[str, int]:
    part, total = "", 0
    for batch in batches:
        part = batch.column("part")[0].as_py()
        total += sum(int.from_bytes(x, "little") for x in batch.column("packed").to_pylist())
    return part, total


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = _total(batches)
    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([to_bytes(total)], pa.binary())], names=["part", "packed"])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 600 rows of a part."""
    part, total = _total(batches)
    fields = unpacked(total)
    steps = fields[: -len(FILTERS)].reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))
    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    shapley = [int(steps[:, :, 1][letter == i].sum()) for i in range(len(FILTERS))]
    flat = {name: steps[:, :, i].ravel() for i, name in enumerate(OUTCOMES)}
    flat |= {"unique_fails": fields[-len(FILTERS) :][letter].ravel(), "shapley": np.array(shapley, np.int64)[letter].ravel()}
    held = {"part": pa.array([part] * 600), "filter_order": pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()), "step": pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))}
    held |= {k: pa.array(v, pa.int64()) for k, v in flat.items()}
    names = [x.split()[0] for x in RESULT.split(", ")]
    yield pa.RecordBatch.from_arrays([held[x] for x in names], names=names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Operator 12: for each part (lang), order of the five filters and step, what the filter of that step does.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. A null text is an empty one, a null lang the part
    ''. A document is a row: repeated rows count each; they share a doc_id, so neither is a copy of the other, and both
    are copies of a smaller doc_id with the same text. A row without doc_id is no copy, makes none and has no label.
    A doc_id with several labels is good or toxic if one says so; null labels say nothing. Parts without rows do not
    occur, so an empty table gives none. Texts are read whole; other columns, of any name, are ignored.
    """
    packed = masks(docs, labels).mapInArrow(_added, "part string, share int, packed binary")
    shares = packed.groupBy("part", "share").applyInArrow(_share, "part string, packed binary")
    return shares.groupBy("part").applyInArrow(_report, RESULT)


def audit_sql() -> str:
    """The same rows by plain SQL."""
    return r"""
with told as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
words as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
judged as (
  select d.part, coalesce(t.good, 0) as good, coalesce(t.toxic, 0) as toxic,
    {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)} as fails
  from words d left join told t on d.doc_id = t.doc_id),
counted as (
  select part, good, toxic, cast(fails['A'] as int) as a, cast(fails['B'] as int) as b, cast(fails['C'] as int) as c, cast(fails['D'] as int) as d, cast(fails['E'] as int) as e, count(*) as n
  from judged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
outcome as (
  select part, filter_order, step, n, good, toxic, a + b + c + d + e as n_fails,
    case substr(filter_order, step, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
    list_max([0] || list_transform(range(1, step), lambda k: case substr(filter_order, k, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end)) as gone
  from counted, steps),
summed as (
  select part, filter_order, step, sum(case when fails = 0 and gone = 0 then n else 0 end) as kept, sum(case when fails = 1 and gone = 0 then n else 0 end) as removed,
    sum(case when fails = 1 and gone = 1 then n else 0 end) as redundant, sum(case when fails = 1 and n_fails = 1 then n else 0 end) as unique_fails,
    sum(case when fails = 1 and gone = 0 then n * good else 0 end) as good_lost, sum(case when fails = 1 and gone = 0 then n * toxic else 0 end) as toxic_lost
  from outcome group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, substr(filter_order, step, 1)) as bigint) as shapley
from summed"""
