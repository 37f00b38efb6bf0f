"""What the operators share: a folder all executors see, written steps, settings, filters and components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh

def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Steps:
    """The written steps of a job: Parquet in the shared folder, which cuts lineage and survives lost executors.

    As a context it deletes at its end what was not written with keep=True; a step that nothing reads
    any more can be deleted before.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = fresh(self.spark, name)
        if not keep:
            self.paths[id(path)] = None, path
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            del self.paths[id(path)]
            self.paths[id(out)] = out, path
        return out

    def drop(self, *steps: DataFrame) -> None:
        for step in steps:
            _, path = self.paths.pop(id(step))
            deleted(self.spark, path)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        for _, path in self.paths.values():
            deleted(self.spark, path)
        self.paths = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, for as long as that folder is kept."""
    return Steps(df.sparkSession).write(df, name, keep=True)


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold inside; then the caller's are back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> dict[str, str]:
    """The setting for Arrow batches of at most so many bytes: a worker holds a batch and the arrays made from a part of it."""
    now = spark.conf.get(BATCH_BYTES).rstrip("bB")
    return {BATCH_BYTES: str(min(most, int(now)) if now.isdigit() else most)}


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """The same for a job that ends without an action of its own: it stays set in the session."""
    for name, value in small_batches(spark, most).items():
        spark.conf.set(name, value)


_HELD: dict[str, Callable[[], object]] = {}


def keeps(name: str, forget: Callable[[], object]) -> None:
    """Says what a worker keeps from task to task under an operator's name, and how it is forgotten."""
    _HELD[name] = forget


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget_others(name: str | None) -> None:
    """Forgets what the worker keeps for operators of other names, since it lives on through all stages of a pipeline."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    if others:
        _give_back()


def trimmed(work: Callable[[Iterator], Iterator], name: str | None = None) -> Callable[[Iterator], Iterator]:
    """work over batches; at the end of a task the worker gives freed memory back, as it lives on for other tasks.

    What it keeps for tasks of the same name stays; what it keeps for others goes before the work begins.
    """

    def run(batches: Iterator) -> Iterator:
        forget_others(name)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def text_column(df: DataFrame, column: str = "text") -> Column:
    return df[column].cast("string")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame) -> Column:
    """All columns but text in one struct with names of our own, so that no column of the caller's can clash with a helper."""
    return F.struct(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns) if c != "text")).alias("row")


def unboxed(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of `like` from (text, row), in their order, and more."""
    kind = like.schema["text"].dataType
    out = (F.col("text").cast(kind).alias(c) if c == "text" else F.col(f"row.c{k}").alias(c) for k, c in enumerate(like.columns))
    return df.select(*out, *more)


#: Bits of a key filter: 8 MB in parts of 4 KB, whatever the number of keys.
FILTER_BITS = 26
_LOW = FILTER_BITS - 15


def _places(key: Column) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(1 << _LOW)).cast("int"), F.shiftright(key, _LOW).bitwiseAND(F.lit((1 << 15) - 1))


def filter_parts(rows: DataFrame, key: str) -> DataFrame:
    """(part, bits): a filter that holds every key of the column (long, well mixed) and, by chance, others. At most 2,048 rows of 4 KB."""
    part, bit = _places(F.col(key))
    return rows.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap(rows: DataFrame, key: str) -> np.ndarray:
    """The same filter as an array, for tasks in Python."""
    out = np.zeros((1 << _LOW, 1 << 12), dtype=np.uint8)
    for row in filter_parts(rows, key).toLocalIterator():
        out[row.part] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    part, bit = keys & ((1 << _LOW) - 1), (keys >> _LOW) & ((1 << 15) - 1)
    return ((bits[part, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among keys, the others): only the second part need be shuffled to be joined with keys.

    The filter is a small table of bits that is broadcast; texts stay in the JVM where they are.
    """
    parts = steps.write(filter_parts(keys, key).select(F.col("part").alias("f_part"), "bits"), "filter", keep=True)
    part, bit = _places(F.col(key))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(byte % F.pow(F.lit(2), bit % 8 + 1) >= F.pow(F.lit(2), bit % 8), F.lit(False))
    marked = rows.join(F.broadcast(parts), part == F.col("f_part"), "left").withColumn("maybe", maybe).drop("f_part", "bits")
    return marked.filter("not maybe").drop("maybe"), marked.filter("maybe").drop("maybe")


LISTED_IDS = 1 << 20  # ids that are listed as they are: 8 MB


def members(chosen: DataFrame, among: DataFrame, steps: Steps) -> list[np.ndarray]:
    """What tells exactly of each id of `among` whether it is one of `chosen`, in bounded memory: filters, then a sorted list.

    Both have a long column `id`, chosen a written step of distinct ids without null. More ids than LISTED_IDS
    become a filter; the others that it lets through, found by a join of ids alone, are told apart from them in turn.
    """
    levels = []
    while chosen.count() > LISTED_IDS:
        key = F.xxhash64("id", F.lit(len(levels))).alias("key")
        levels.append(bitmap(chosen.select(key), "key"))
        _, maybe = split_by_keys(among.select("id", key), "key", chosen.select(key), steps)
        chosen, among = steps.write(maybe.select("id").join(chosen, "id", "left_anti").filter("id is not null").distinct(), "others"), chosen
    return [*levels, np.sort(chosen.toPandas()["id"].to_numpy(dtype=np.int64))]


def member_keys(levels: list[np.ndarray], column: str) -> list[Column]:
    """The keys that is_member needs beside the ids of the column, one for each filter."""
    return [F.xxhash64(column, F.lit(k)).alias(f"key{k}") for k in range(len(levels) - 1)]


def is_member(levels: list[np.ndarray], ids: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    first, *rest = levels
    if not rest:
        return first[np.minimum(np.searchsorted(first, ids), len(first) - 1)] == ids if len(first) else np.zeros(len(ids), dtype=bool)
    out = in_bitmap(first, keys[0])
    out[out] = ~is_member(rest, ids[out], [k[out] for k in keys[1:]])
    return out


BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 8 << 20


def broadcast_if_small(step: DataFrame, text: str | None = None) -> DataFrame:
    """A written step with the hint to broadcast it if its rows and the letters of its text column are within bounds; else as it is."""
    size = step.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)) if text else F.lit(0), F.lit(0)).alias("chars")).first()
    return F.broadcast(step) if size.n <= BROADCAST_ROWS and size.chars <= BROADCAST_CHARS else step


def components(edges: DataFrame, a: str = "a", b: str = "b", steps: Steps | None = None) -> DataFrame:
    """(node, component) of an undirected graph; component is the least node that can be reached.

    Alternates large-star and small-star steps until a round changes no edge. Neighbours are counted by partial
    sums before anything is shuffled, and a node's least neighbour goes back to its edges by a join that
    Spark may split, so a node of very many edges is no single task's. Each round is written to the shared folder.
    Loops and repeated edges are harmless; an empty graph gives no rows. A null end drops the edge.
    """
    steps = steps or Steps(edges.sparkSession)
    now = steps.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = steps.write(pairs.groupBy("c").agg(F.least(F.min("l"), F.col("c")).alias("m")), "least")
        out = pairs.join(broadcast_if_small(least), "c")
        if large:
            out = out.filter("l > c").select(F.col("l").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("l").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        out = steps.write(out.filter("u <> v").distinct(), "edges")
        steps.drop(least)
        return out

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(now)
    while seen[0]:
        both = now.select(F.col("u").alias("c"), F.col("v").alias("l")).union(now.select(F.col("v").alias("c"), F.col("u").alias("l")))
        grown = star(both, True)
        before, now = now, star(grown.toDF("c", "l"), False)
        steps.drop(before, grown)
        new = digest(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
