"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent between 0 (all alike) and 1 (as they
are) and normalised. The exponent is bisected until no source repeats more than a limit, or until
the weights reach a target entropy. The weights times the budget are then realised per source as
block permutations: documents fall into blocks of about BLOCK_TOKENS tokens, an epoch is a
permutation of the blocks (and of the documents in each), and a source takes whole epochs and of
the next one as many blocks as its budget holds, the last of them up to a document.

Sources stay a table, however many there are; the driver sees sums over them. Only numbers are shuffled: where
a source's last epoch ends is searched in three steps, by ranges of blocks, by blocks and by documents of one
block, so no source's blocks have to be ordered in one task. The few numbers of each source are joined back to the
texts. Everything is DataFrame code.

Defined cases: a null source is a source of its own; a null or blank text has no tokens and is in
each whole epoch of its source, and in the last one if its place comes before the cut; a source
without tokens has weight 0 and stays once; ties in the order of documents (repeated rows) share
their fate; an empty table gives no rows; other columns pass through, whatever their names, but for
columns named mix_epoch, mix_block or mix_place, which `mix` replaces.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK_TOKENS = 1 << 16
HALVINGS, AT_ONCE = 40, 5  # of the exponent's range in all, and in one pass over the sources
RANGES = 1 << 50  # of the 60 bits of a block's order
MADE = ("mix_epoch", "mix_block", "mix_place")


def word_count(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def number(*parts: Column) -> Column:
    """60 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


@dataclass
class Shares:
    """What is known of the sources with tokens: their sum, the least and the greatest, and sums of powers of their shares."""

    total: int
    least: int
    most: int
    powers: Callable[[list[float]], list[tuple[float, float]]]

    @classmethod
    def of(cls, sources: DataFrame) -> Shares | None:
        """sources: (s, tokens)."""
        some = sources.filter("tokens > 0")
        row = some.agg(F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
        if row.total is None:
            return None
        share = F.col("tokens") / F.lit(float(row.total))

        def powers(exponents: list[float]) -> list[tuple[float, float]]:
            sums = [c for k, e in enumerate(exponents) for c in (F.sum(F.pow(share, F.lit(e))).alias(f"n{k}"), F.sum(F.pow(share, F.lit(e)) * F.log(share)).alias(f"l{k}"))]
            found = some.agg(*sums).first()
            return [(found[f"n{k}"], found[f"l{k}"]) for k in range(len(exponents))]

        return cls(row.total, row.least, row.most, powers)


def bisect(holds: Callable[[list[float]], list[bool]]) -> float:
    """The least exponent in [0, 1] for which holds is true, if it is monotone; 1 if none is. Several halvings share a pass."""
    if holds([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(0, HALVINGS, AT_ONCE):
        inner = [low + (high - low) * k / 2**AT_ONCE for k in range(1, 2**AT_ONCE)]
        true = [e for e, good in zip(inner, holds(inner), strict=True) if good]
        high = min(true, default=high)
        low = max((e for e in (low, *inner) if e < high), default=low)
    return high


def factor(shares: Shares, budget: float | None, max_repetition: float | None, target_entropy: float | None) -> tuple[float, float]:
    """(exponent, factor): a source of share p is taken factor * p ** (exponent - 1) times.

    Without a budget it is the least one that takes every source whole at least once.
    """
    p_least, p_most = shares.least / shares.total, shares.most / shares.total

    def scale(exponents: list[float]) -> list[float]:
        if budget is None:
            return [p_most ** (1 - e) for e in exponents]
        return [budget / shares.total / norm for norm, _ in shares.powers(exponents)]

    if max_repetition is not None:
        found = bisect(lambda es: [f * p_least ** (e - 1) <= max_repetition * (1 + 1e-12) for e, f in zip(es, scale(es), strict=True)])
    elif target_entropy is not None:
        # Entropy falls as the exponent grows: the largest exponent that still has the target.
        def enough(back: list[float]) -> list[bool]:
            return [math.log(norm) - (1 - b) * logs / norm >= target_entropy for b, (norm, logs) in zip(back, shares.powers([1 - b for b in back]), strict=True)]

        found = 1.0 - bisect(enough)
    else:
        found = 1.0
    return found, scale([found])[0]


def _limits(docs: DataFrame, key: Column, budget: float | None, max_repetition: float | None, target_entropy: float | None, source: str, seed: int, block_tokens: int) -> DataFrame:
    """Per source: s, whole (epochs), blocks, and lo, lp: order of the block and place of the document with which the last epoch ends."""
    spark = docs.sparkSession
    with shared.Steps(spark) as steps:
        small = steps.write(docs.select(F.col(source).alias("s"), key.alias("k"), word_count(docs["text"]).alias("t")), "tokens")
        sources = steps.write(small.groupBy("s").agg(F.sum("t").alias("tokens")), "sources")
        shares = Shares.of(sources)
        times = F.lit(1.0)
        if shares is not None:
            exponent, scale = factor(shares, budget, max_repetition, target_entropy)
            share = F.col("tokens") / F.lit(float(shares.total))
            times = F.when(F.col("tokens") > 0, F.lit(scale) * F.pow(share, F.lit(exponent - 1.0))).otherwise(1.0)
        whole = F.floor(times + 1e-9)
        budgets = sources.select("s", whole.cast("int").alias("whole"), ((times - whole) * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.floor(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
        budgets = steps.write(budgets, "budgets")
        near = shared.broadcast_if_small(budgets).withColumnRenamed("s", "bs")
        placed = small.filter("t > 0").join(near, small["s"].eqNullSafe(F.col("bs"))).drop("bs").filter("rest > 0")
        order = number(F.lit(seed), F.col("whole"), F.pmod("k", "blocks"))
        placed = placed.select("s", "t", "rest", order.alias("o"), number(F.lit(seed), F.col("whole"), F.col("k")).alias("p"))
        placed = steps.write(placed.groupBy("s", "o", "p").agg(F.sum("t").alias("t"), F.first("rest").alias("rest")), "placed")

        def cut(rows: DataFrame, by: Column) -> DataFrame:
            """Of rows (s, o, p, t, rest, before): per source the value of `by` at which the sum of t from `before` on reaches rest."""
            sums = rows.groupBy("s", by.alias("at")).agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
            so_far = F.sum("t").over(Window.partitionBy("s").orderBy("at")) - F.col("t") + F.col("before")
            return sums.withColumn("before", so_far)

        def inside(rows: DataFrame, by: Column, sums: DataFrame) -> DataFrame:
            """The rows at their source's cut, with the sum before it."""
            at = steps.write(sums.filter("before < rest and before + t >= rest").select(F.col("s").alias("cs"), F.col("at"), F.col("before").alias("b")), "cuts")
            near = shared.broadcast_if_small(at)
            return rows.join(near, rows["s"].eqNullSafe(F.col("cs")) & (by == F.col("at"))).select("s", "o", "p", "t", "rest", F.col("b").alias("before"))

        rows = placed.withColumn("before", F.lit(0).cast("long"))
        in_range = F.floor(F.col("o") / RANGES)
        rows = inside(rows, in_range, cut(rows, in_range))
        rows = steps.write(inside(rows, F.col("o"), cut(rows, F.col("o"))), "block")
        ends = cut(rows, F.col("p")).groupBy("s").agg(F.max(F.when(F.col("before") + F.col("t") <= F.col("rest"), F.col("at"))).alias("lp"))
        ends = ends.join(rows.groupBy("s").agg(F.first("o").alias("lo")).withColumnRenamed("s", "es"), F.col("s").eqNullSafe(F.col("es")))
        ends = ends.select(F.col("s").alias("es"), "lo", F.coalesce("lp", F.lit(-1)).alias("lp"))
        return shared.written(budgets.join(ends, budgets["s"].eqNullSafe(ends["es"]), "left").select("s", "whole", "blocks", "lo", "lp"), "limits")


def _taken(docs: DataFrame, budget: float | None, max_repetition: float | None, target_entropy: float | None, source: str, seed: int, block_tokens: int) -> DataFrame:
    """text, row (the other columns) and the made ones, each row as often as it is taken."""
    key = number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(shared.text_column(docs), F.lit("")))
    limits = _limits(docs, key, budget, max_repetition, target_entropy, source, seed, block_tokens)
    own = docs.select(shared.text_column(docs).alias("text"), shared.boxed(docs), key.alias("k"), F.col(source).alias("s"))
    near = shared.broadcast_if_small(limits).withColumnRenamed("s", "ls")
    full = own.join(near, own["s"].eqNullSafe(F.col("ls")))
    order, place = number(F.lit(seed), F.col("whole"), F.pmod("k", "blocks")), number(F.lit(seed), F.col("whole"), F.col("k"))
    part = F.coalesce((order < F.col("lo")) | ((order == F.col("lo")) & (place <= F.col("lp"))), F.lit(False))
    full = full.withColumn("copies", F.col("whole") + part.cast("int")).filter("copies > 0")
    out = full.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    made = number(F.lit(seed), F.col("mix_epoch"), F.pmod("k", "blocks")).alias("mix_block"), number(F.lit(seed), F.col("mix_epoch"), F.col("k")).alias("mix_place")
    return out.select("text", "row", "mix_epoch", *made)


def mix(
    docs: DataFrame,
    budget: float | None = None,
    max_repetition: float | None = None,
    target_entropy: float | None = None,
    source: str = "source",
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of docs, each as often as its source's budget takes it, with mix_epoch, mix_block and mix_place.

    Sorting by (mix_epoch, mix_block, mix_place) gives the permuted order of a source.
    """
    docs = docs.drop(*MADE)
    return shared.unboxed(_taken(docs, budget, max_repetition, target_entropy, source, seed, block_tokens), docs, *map(F.col, MADE))


def repeated(docs: DataFrame, budget: float | None = None, max_repetition: float | None = None, target_entropy: float | None = None, source: str = "source", seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The same rows with the columns of docs alone."""
    return shared.unboxed(_taken(docs, budget, max_repetition, target_entropy, source, seed, block_tokens), docs)
