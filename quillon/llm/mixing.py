"""Operator 10: mixing sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut

#: Sources up to which the table of sources is broadcast (a few dozen bytes each).
MAX_BROADCAST_SOURCES = 20_000
BLOCK_TOKENS = 1_000_000


def exponent(stats: DataFrame, total: int, budget: float, target_entropy: float | None, max_repeats: float | None, levels: int = 5, passes: int = 6) -> float:
    """The smallest exponent in [0, 1] whose weights, token shares to that power, keep the entropy
    at or below ``target_entropy`` (in nats) and every source's repetitions at or below ``max_repeats``.

    Entropy and repetitions fall as the exponent grows, so it is bisected. One aggregate over the
    sources answers the midpoints of ``levels`` halvings at once; 1 where nothing smaller will do.
    """
    low, high = 0.0, 1.0
    n = 2**levels
    for p in range(passes):
        grid = [low + (high - low) * k / n for k in range(0 if p == 0 else 1, n)]
        at = stats.select("_mix_tokens", F.explode(F.array(*map(F.lit, grid))).alias("a")).withColumn("w", F.pow(F.col("_mix_tokens") / total, "a"))
        said = at.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s"), F.max(F.col("w") / F.col("_mix_tokens")).alias("r"))
        fits = [a for a, z, s, r in sorted(said.collect()) if (target_entropy is None or math.log(z) - s / z <= target_entropy) and (max_repeats is None or r * budget / z <= max_repeats)]
        first = min(fits, default=high)
        if p == 0 and first == 0.0:
            return 0.0
        low, high = max([low, *(a for a in grid if a < first)]), first
    return high


def mix_sources(
    docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", budget_tokens: int | None = None,
    target_entropy: float | None = None, max_repeats: float | None = 1.5, block_tokens: int = BLOCK_TOKENS, seed: int = 17,
) -> DataFrame:
    """Operator 10: a row for each time a document is used, with n_tokens, weight, epoch, block, block_order and doc_order.

    Tokens are words. Weights are token shares to the power of :func:`exponent`, normalised. A
    source's quota is its weight of ``budget_tokens`` (None: all tokens). Its documents lie in
    blocks of about ``block_tokens``; each epoch is a permutation of blocks and, within them, of
    documents. Whole epochs are used as often as they fit, then the start of the permutation
    until the next document would exceed the quota. So a row's place is (epoch, block_order, doc_order).

    Only sums by source and block are shuffled; the one block a quota ends in is read by document,
    so a source with a third of all rows costs one task no more than its list of blocks. The table
    of sources is broadcast only up to ``MAX_BROADCAST_SOURCES`` rows.

    A null source is a source of its own. Documents without words have no tokens and come along as
    their place in the permutation says; a source without any token has weight 0 and is not used.
    Repeated rows share a place and are used together. An empty table gives an empty table. Columns
    of ``docs`` with a name of the result are replaced.
    """
    base = docs.drop("n_tokens", "weight", "epoch", "block", "block_order", "doc_order").withColumns({
        "_mix_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")),
        "n_tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_mix_hash": F.xxhash64(F.lit(seed), F.col(key)),
        "doc_order": F.xxhash64(F.lit(seed + 1), F.col(key)),
    })
    sizes = cut(base.groupBy("_mix_source").agg(F.sum("n_tokens").alias("_mix_tokens")).where("_mix_tokens > 0"), "sources")
    n_sources, total = sizes.agg(F.count("*"), F.coalesce(F.sum("_mix_tokens"), F.lit(0))).first()
    budget = total if budget_tokens is None else budget_tokens
    power = exponent(sizes, total, budget, target_entropy, max_repeats) if total else 1.0
    raw = F.pow(F.col("_mix_tokens") / max(total, 1), F.lit(power))
    z = sizes.agg(F.sum(raw)).first()[0] or 1.0
    quota = F.floor(raw / z * budget).cast("long")
    sources = cut(sizes.select(
        "_mix_source", (raw / z).alias("weight"), F.expr(f"ceil(_mix_tokens / {block_tokens})").cast("long").alias("_mix_blocks"),
        (quota - quota % F.col("_mix_tokens")).alias("_mix_whole"), (quota % F.col("_mix_tokens")).alias("_mix_rest"), "_mix_tokens"), "mix")
    near = F.broadcast if n_sources <= MAX_BROADCAST_SOURCES else (lambda x: x)

    def placed(df: DataFrame, table: DataFrame) -> DataFrame:
        df = df.join(near(table), "_mix_source").withColumn("block", F.pmod("_mix_hash", "_mix_blocks"))
        return df.withColumn("block_order", F.xxhash64(F.lit(seed + 2), "_mix_source", "block"))

    rows = placed(base.select("_mix_source", "n_tokens", "_mix_hash", "doc_order"), sources)
    blocks = cut(rows.groupBy("_mix_source", "block_order", "_mix_rest").agg(F.sum("n_tokens").alias("t")), "blocks")
    through = F.sum("t").over(Window.partitionBy("_mix_source").orderBy("block_order").rangeBetween(Window.unboundedPreceding, 0))
    ends = blocks.withColumn("c", through).where(F.col("c") > F.col("_mix_rest"))
    ends = ends.groupBy("_mix_source").agg(F.min_by(F.struct("block_order", (F.col("_mix_rest") - F.col("c") + F.col("t")).alias("room")), "block_order").alias("e"))
    ends = cut(ends.select("_mix_source", F.col("e.block_order").alias("_mix_end"), F.col("e.room").alias("_mix_room")), "ends")
    last = rows.join(near(ends), "_mix_source").where(F.col("block_order") == F.col("_mix_end"))
    so_far = F.sum("n_tokens").over(Window.partitionBy("_mix_source").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0))
    upto = last.withColumn("c", so_far).where(F.col("c") <= F.col("_mix_room")).groupBy("_mix_source").agg(F.max("doc_order").alias("_mix_upto"))
    table = cut(sources.join(ends, "_mix_source").join(upto, "_mix_source", "left"), "quotas")
    out = placed(base, table)
    started = (F.col("block_order") < F.col("_mix_end")) | ((F.col("block_order") == F.col("_mix_end")) & (F.col("doc_order") <= F.col("_mix_upto")))
    epochs = (F.col("_mix_whole") / F.col("_mix_tokens")).cast("int") + F.coalesce(started, F.lit(False)).cast("int")
    out = out.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(1), epochs)).otherwise(F.array().cast("array<int>"))))
    return out.drop(*(c for c in out.columns if c.startswith("_mix_")))
