"""Operator 5: toxicity scores by a factorization machine over hashed terms.

A document is its set of terms: words in lower case and their first four and five letters,
hashed. The model is logistic; each term has a weight and a vector, and the product of two
vectors is the weight of the two terms standing in one document (an insult beside the mention
of a group), which no sum of single weights gives.

The fit reads a bounded sample of labelled rows (``MAX_FIT`` of them, by a hash of the key)
in one task. Every term of the sample has a weight and a vector from the first step on, and they
are shrunk together: a value leaves its start once the slopes it has met exceed ``DOUBT`` standard
deviations, by the model's own doubt of each row and by their squares (either alone misjudges rare terms). A term that tells only beside another is
found that way, as its vector is judged by what the other one adds. Scores read all words of every
document; terms that have neither a weight nor a vector after the fit add nothing and are not sent.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit reads at most.
MAX_FIT = 20_000
BITS = 20
FACTORS = 8
#: Standard deviations by which the slopes of a value must stand out before it counts.
DOUBT = 3.0
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def term_hashes(chunk: str) -> tuple[int, ...]:
    """Hashes of the terms of a run of other than white space."""
    mask, out = (1 << BITS) - 1, []
    for word in _WORD.findall(chunk.lower()):
        out.append(xxhash.xxh64_intdigest(word) & mask)
        out += (xxhash.xxh64_intdigest(word[:n], seed=n) & mask for n in (4, 5) if len(word) > n)
    return tuple(out)


class Terms(dict):
    """Chunk -> hashes, or -> places among the kept terms."""

    def __init__(self, places: dict[int, int] | None = None):
        super().__init__()
        self.places = places

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        got = term_hashes(chunk)
        if self.places is not None:
            got = tuple(self.places[x] for x in got if x in self.places)
        if len(self) < CACHE and len(chunk) < 64:
            self[chunk] = got
        return got

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for own in map(self.__getitem__, set((text or "").split())):
            if own:
                found.update(own)
        return sorted(found)


class Rows:
    """Sets of terms, one after the other."""

    def __init__(self, rows: Iterable[np.ndarray | list[int]]):
        rows = [np.asarray(x, np.int64) for x in rows]
        self.sizes = np.array([len(x) for x in rows], np.int64)
        self.terms = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)


def margin(rows: Rows, bias: float, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of each row, and the sums of its vectors."""
    n = len(rows.sizes)
    held = vectors[rows.terms]
    sums = np.zeros((n, vectors.shape[1]))
    squares = np.zeros(n)
    np.add.at(sums, rows.row, held)
    np.add.at(squares, rows.row, (held**2).sum(1))
    return bias + np.bincount(rows.row, weights[rows.terms], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sets: list[np.ndarray], labels: np.ndarray, rate: float = 0.2, seed: int = 3) -> dict[str, np.ndarray]:
    """Terms, weights, vectors and bias by AdaGrad with dual averaging on the logistic loss, over all terms of ``sets``.

    A small sample is met more often and in smaller batches.
    """
    epochs, batch = int(np.clip(80_000 // max(len(sets), 1), 5, 40)), int(np.clip(len(sets) // 50, 16, 256))
    rng = np.random.default_rng(seed)
    sizes = [len(x) for x in sets]
    every, places = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64), return_inverse=True)
    own = np.split(places, np.cumsum(sizes)[:-1]) if sizes else []
    n_toxic, size = labels.sum(), len(every)
    share = (n_toxic + 1e-3) / (len(sets) + 2e-3)
    bias, sum_b = np.log(share / (1 - share)), 1e-6
    # a row for each term: its weight, then its vector
    start = np.zeros((size, 1 + FACTORS), np.float32)
    start[:, 1:] = rng.normal(0, 0.01, (size, FACTORS))
    held, slopes, squares, spread = start.copy(), np.zeros_like(start), np.full_like(start, 1e-6), np.zeros_like(start)
    hit, place = np.zeros(size, bool), np.zeros(size, np.int64)
    for epoch in range(epochs if n_toxic else 0):
        # each epoch meets the same rows, so their chance slopes add up and not their deviations
        doubt = np.float32(DOUBT * np.sqrt(epoch + 1))
        order = rng.permutation(len(own))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            rows = Rows(own[i] for i in now)
            hit[rows.terms] = True
            used = np.flatnonzero(hit)
            hit[used] = False
            place[used] = np.arange(len(used))
            back, n = place[rows.terms], len(used)
            old = held[used]
            sums = np.stack([np.bincount(rows.row, x[back], len(now)) for x in old.T])
            own_squares = np.bincount(rows.row, (old[:, 1:] ** 2).sum(1)[back], len(now))
            told = sigmoid(bias + sums[0] + 0.5 * ((sums[1:] ** 2).sum(0) - own_squares))
            error, unsure, sums = told - labels[now], told * (1 - told), sums[1:]
            per_term = lambda x: np.bincount(back, x[rows.row], n)  # noqa: B023, E731
            slope, sure, vectors = per_term(error)[:, None], per_term(unsure)[:, None], old[:, 1:]
            each, once, twice = (np.stack([per_term(x) for x in y], 1) for y in (sums * error, sums * unsure, sums**2 * unsure))
            new = np.hstack([slope, each - vectors * slope])
            bias -= rate * error.sum() / np.sqrt(sum_b := sum_b + error.sum() ** 2)
            slopes[used] += new
            squares[used] += new**2
            spread[used] += np.hstack([sure, np.maximum(twice - 2 * vectors * once + vectors**2 * sure, 0)])
            far = np.maximum(np.abs(slopes[used]) - doubt * np.sqrt((spread[used] + squares[used]) / 2), 0)
            held[used] = start[used] - rate * np.sign(slopes[used]) * far / np.sqrt(squares[used])
    if not n_toxic:
        bias = -10.0
    moved = (held[:, 1:] != start[:, 1:]).any(1)
    held[~moved, 1:] = 0
    tells = np.flatnonzero(moved | (held[:, 0] != 0))
    return {"terms": every[tells], "weights": held[tells, 0].astype(np.float64), "vectors": held[tells, 1:].astype(np.float64), "bias": np.array(bias)}


def fit_model(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", max_rows: int = MAX_FIT) -> bytes:
    """The model, of fixed size, from at most ``max_rows`` labelled rows for which ``may_learn`` holds."""
    sample = labels.where(may_learn & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "label").limit(max_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            sets = [np.array(terms.of(x), "<i4").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.binary())], names=["doc_id", "label", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x["doc_id"], x["label"], x["terms"]) for b in batches for x in b.to_pylist())
        model = fit([np.frombuffer(x[2], "<i4").astype(np.int64) for x in rows], np.array([x[1] for x in rows], np.float64))
        out = io.BytesIO()
        np.savez(out, **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learned = text.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(read, "doc_id long, label int, terms binary")
    return learned.repartition(1).mapInArrow(learn, "model binary").first()[0]


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.load(io.BytesIO(model))
        terms = Terms({int(x): i for i, x in enumerate(held["terms"])})
        for batch in batches:
            rows = Rows(terms.of(x) for x in batch.column("text").to_pylist())
            log_odds, _ = margin(rows, float(held["bias"]), held["weights"], held["vectors"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(log_odds))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT) -> DataFrame:
    """Operator 5: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for each row of ``docs``.

    Labels are learned from rows that are not held out (crc32 of doc_id modulo 5 is not 0); only
    texts are read for a score. Null, empty and wordless texts have no terms and get the score of
    the bias. Without a labelled toxic row every score is near 0. Repeated rows are scored alike;
    an empty table gives an empty table. Null labels are not learned from. Extra columns are ignored.
    """
    model = fit_model(docs, labels, ~held_out(F.col("doc_id")), max_rows=max_rows)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
