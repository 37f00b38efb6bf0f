"""Byte n-gram language models as sharded count tables, and per-document scores from them.

The table that maps an n-gram to its value is sharded by n-gram and never whole in one place.
Documents are worked through in blocks (runs of texts of one scan): a block asks for its
distinct n-grams once, the requests join the sharded table, and the block gets back just
those values. So a block's texts and its part of the table meet in one task, and what is
shuffled for counts is a block's distinct n-grams rather than every position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textblocks import chunks, utf8_column

ORDER = 4
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 50_000
SYMBOLS = 257  # bytes, and the border before a text


def settings(spark: SparkSession) -> dict[str, str]:
    """Small batches, and two scans of a table that cut it alike, however many executors there are at the time."""
    name = "spark.sql.files.minPartitionNum"
    return shared.small_batches(spark, BLOCK_BYTES) | {name: spark.conf.get(name, None) or str(spark.sparkContext.defaultParallelism)}


def _grams(part: np.ndarray, inner: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each byte; before a text stand zero bytes."""
    pad = order - 1
    rows = len(inner) - 1
    padded = np.zeros(len(part) + pad * rows, dtype=np.uint8)
    keep = np.ones(len(padded), dtype=bool)
    begins = inner[:-1] + pad * np.arange(rows)
    keep[(begins[:, None] + np.arange(pad)).ravel()] = False
    padded[keep] = part
    kind = np.uint32 if order <= 4 else np.uint64
    packed = padded[pad:].astype(kind)
    for k in range(1, order):
        packed |= padded[pad - k : len(padded) - k].astype(kind) << kind(8 * k)
    return packed[keep[pad:]]


def _key(column: pa.Array) -> int:
    return int(np.bitwise_xor.reduce(np.asarray(column, dtype=np.int64) * np.arange(1, 2 * len(column), 2))) if len(column) else 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows, each with a name made from its rows.

    A run ends with the row at which its texts reach BLOCK_BYTES or its rows BLOCK_ROWS, wherever batches end,
    since two scans that select other columns may be cut into batches in other places.
    """
    held: list[pa.RecordBatch] = []
    n_held = rows_held = 0

    def block() -> tuple[int, pa.RecordBatch]:
        out = pa.concat_batches(held)
        return _key(out.column("row_key")) ^ out.num_rows, out

    for batch in batches:
        _, offsets = utf8_column(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - n_held, side="left"))
            to = min(max(to, at + 1), at + BLOCK_ROWS - rows_held, batch.num_rows)
            held.append(batch.slice(at, to - at))
            n_held += int(offsets[to] - offsets[at])
            rows_held += to - at
            at = to
            if n_held >= BLOCK_BYTES or rows_held >= BLOCK_ROWS:
                yield block()
                held, n_held, rows_held = [], 0, 0
    if held:
        yield block()


CHANGED = "the rows changed between two scans"


def twice_alike(rows: DataFrame, work: Callable[[DataFrame, shared.Steps], DataFrame]) -> DataFrame:
    """The written result of work(rows, steps); if two scans of the rows turn out unlike (say, behind a shuffle), once more on a written copy."""
    spark = rows.sparkSession
    with shared.held(spark, settings(spark)):
        try:
            with shared.Steps(spark) as steps:
                return steps.write(work(rows, steps), "scores", keep=True)
        except PythonException as e:
            if CHANGED not in str(e):
                raise
        with shared.Steps(spark) as steps:
            return steps.write(work(steps.write(rows, "rows"), steps), "scores", keep=True)


def keyed(docs: DataFrame, *columns: str, whole: bool = False) -> DataFrame:
    """doc_id, text and the named columns, with a key made of doc_id and text; whole: with all other columns in `row`."""
    text = shared.text_column(docs)
    more = [shared.boxed(docs)] if whole else []
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), *(docs[c].cast("string").alias(c) for c in columns), *more)
    return chosen.withColumn("row_key", F.xxhash64("doc_id", "text"))


def gram_requests(rows: DataFrame, chosen: list[np.ndarray], steps: shared.Steps, order: int = ORDER) -> DataFrame:
    """Per block: its name, its distinct n-grams, how often each occurs, and how often in documents of the chosen ids (see shared.members)."""
    own_chosen = rows.sparkSession.sparkContext.broadcast(chosen)
    keys = shared.member_keys(chosen, "doc_id")
    n_keys = len(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches):
            data, offsets = utf8_column(block.column("text"))
            ids = block.column("doc_id")
            own = shared.is_member(own_chosen.value, np.asarray(ids.fill_null(0)), [np.asarray(block.column(f"key{k}")) for k in range(n_keys)])
            own &= np.asarray(ids.is_valid())
            grams, times, picked = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for start, end, part, inner in chunks(data, offsets):
                packed = _grams(part, inner, order)
                some, count = np.unique(packed, return_counts=True)
                marked = np.zeros(len(some), dtype=np.int64)
                if own[start:end].any():
                    sub, sub_count = np.unique(packed[np.repeat(own[start:end], np.diff(inner))], return_counts=True)
                    marked[np.searchsorted(some, sub)] = sub_count
                both, at = np.unique(np.concatenate((grams, some.astype(np.uint64))), return_inverse=True)
                times = np.bincount(at, np.concatenate((times, count)), len(both)).astype(np.int64)
                picked = np.bincount(at, np.concatenate((picked, marked)), len(both)).astype(np.int64)
                grams = both
            lists = [pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(x)) for x in (grams.astype(np.int64), times, picked)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *lists], names=["block", "gram", "times", "picked"])

    found = rows.select("doc_id", "text", "row_key", *keys).mapInArrow(shared.trimmed(scan), "block long, gram array<long>, times array<long>, picked array<long>")
    return steps.write(found, "grams")


def each_request(requests: DataFrame) -> DataFrame:
    return requests.select("block", F.inline(F.arrays_zip("gram", "times", "picked")))


def kneser_ney(counts: DataFrame, wanted: DataFrame, steps: shared.Steps, order: int = ORDER) -> DataFrame:
    """(gram, logp): natural logs of interpolated modified Kneser-Ney probabilities of the wanted n-grams.

    counts (gram, c) are the model's n-grams of full order; wanted (gram) may hold others.
    Lower orders count distinct symbols before; each order has three discounts from its
    counts of counts, and the lowest is mixed with the uniform distribution.
    """
    tables = {order: counts.filter("c > 0").select("gram", F.col("c").cast("long").alias("c"))}
    for n in range(order - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit(256**n - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    # Each level is a small table; written once, as the levels above read it again.
    tables = {n: steps.write(t, f"order{n}") for n, t in tables.items()}
    found = None
    for n, t in tables.items():
        one = t.agg(F.lit(n).alias("n"), F.sum("c").alias("total"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        found = one if found is None else found.union(one)
    stats = {r.n: r for r in found.collect()}
    low = None
    for n in range(1, order + 1):
        s = stats[n]
        base = s.n1 / (s.n1 + 2 * s.n2) if s.n1 and s.n2 else 0.5
        discounts = [min(max(k - (k + 1) * base * b / a, 0.05), k - 0.01) if a and b else 0.5 * k for k, a, b in ((1, s.n1, s.n2), (2, s.n2, s.n3), (3, s.n3, s.n4))]
        taken = F.when(F.col("c") == 1, discounts[0]).when(F.col("c") == 2, discounts[1]).otherwise(discounts[2])
        freed = sum(F.count_if(F.col("c") == k if k < 3 else F.col("c") >= 3) * F.lit(d) for k, d in ((1, discounts[0]), (2, discounts[1]), (3, discounts[2])))
        need = wanted.select(F.col("gram").bitwiseAND(F.lit(256**n - 1)).alias("gram")).distinct()
        need = need.join(tables[n].withColumn("kept", F.col("c") - taken), "gram", "left")
        contexts = tables[n].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), freed.alias("freed"))
        need = need.withColumn("context", F.shiftright("gram", 8)).join(contexts, "context", "left")
        if low is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            need = need.withColumn("tail", F.col("gram").bitwiseAND(F.lit(256 ** (n - 1) - 1))).join(low.withColumnRenamed("gram", "tail"), "tail")
            below = F.col("p_low")
        p = F.when(F.col("total") > 0, (F.coalesce(F.greatest("kept", F.lit(0.0)), F.lit(0.0)) + F.col("freed") * below) / F.col("total")).otherwise(below)
        low = need.select("gram", p.alias("p_low"))
        if n > 1:
            low = steps.write(low, f"p{n}")
    return low.select("gram", F.log("p_low").alias("logp"))


def block_scores(rows: DataFrame, requests: DataFrame, values: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row: its columns but text, n_bytes, and total (the sum of its n-grams' values); with `row` the text too.

    values: (gram, value). The blocks' texts, packed, meet the blocks' values in a shuffle by block.
    """
    carried = [c for c in rows.columns if c != "text" or "row" in rows.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for name, block in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], names=["block", "packed"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = pa.ipc.open_stream(zstandard.decompress(batch.column("packed")[i].as_py())).read_next_batch()
                pairs = batch.column("found")[i].values
                grams = np.asarray(pairs.field("gram")).astype(np.uint64)
                by = np.argsort(grams)
                grams, value = grams[by], np.asarray(pairs.field("value"), dtype=np.float64)[by]
                small = grams.astype(np.uint32) if order <= 4 else grams
                data, offsets = utf8_column(block.column("text"))
                total = np.zeros(block.num_rows)
                for start, end, part, inner in chunks(data, offsets):
                    packed = _grams(part, inner, order)
                    if len(packed) and not len(small):
                        raise ValueError(CHANGED)
                    at = np.minimum(np.searchsorted(small, packed), len(small) - 1)
                    if not (small[at] == packed).all():
                        raise ValueError(CHANGED)
                    sums = np.concatenate(([0.0], np.cumsum(value[at])))
                    total[start:end] = sums[inner[1:]] - sums[inner[:-1]]
                columns = [*(block.column(c) for c in carried), pa.array(np.diff(offsets)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, "n_bytes", "total"])

    packed = rows.mapInArrow(shared.trimmed(pack), "block long, packed binary")
    answers = (
        each_request(requests).select("block", "gram").join(values, "gram")
        .groupBy("block").agg(F.collect_list(F.struct("gram", F.col("value").cast("float").alias("value"))).alias("found"))
    )
    empty = F.array().cast("array<struct<gram:bigint,value:float>>")
    met = packed.join(answers, "block", "left").select("packed", F.coalesce("found", empty).alias("found"))
    schema = T.StructType([rows.schema[c] for c in carried]).add("n_bytes", "long").add("total", "double")
    return met.mapInArrow(shared.trimmed(score), schema)
