"""N-gram Jaccard self-join: documents whose shingle sets reach a similarity, and their components.

Method: a blocked sparse matrix product of the document by n-gram incidence. Overlap counts
are accumulated block by block and pairs below the bound that their sizes imply are discarded.

1. One scan hashes each text's word shingles and signs each set; documents with equal sets form
   a class, which is one row of the matrix. The same scan counts, per run of texts, the
   n-grams that repeat in them; the sums name the frequent ones.
2. A class of n shingles can only link to a class with which it shares one of its first
   n - ceil(t n) + 1 shingles in any fixed order. The candidate search takes n / EXTRA more, so
   that linked classes share at least n / EXTRA - 1 of them; a class with fewer n-grams that
   any class of fitting size holds too is out. Frequent n-grams come last in the order. The list
   of them has a fixed bound (``FREQUENT_LIMIT``) and changes the order alone, never the result.
3. Classes that meet in such a shingle get one home, the least minimum hash among them, so
   that the rows of near copies meet in few blocks. Homes with many shingles are cut into
   blocks, and each pair of blocks is a task of its own. Two classes with several homes in
   common are compared in the first of them.
4. In a pair of blocks the product of the incidence rows counts overlaps: first over the part
   of the n-grams with the least hashes (PART_BELOW), where a row stays only if a partner can
   still reach the bound with all the rest; then, for those rows, over all of them. A spanning forest of
   the links leaves the task, never the pairs. The overlaps that decide are counted over all 64 bits of the hashes.

What is common to many rows (a set, an n-gram, a component) is summed up before it is shuffled, and goes back to its
rows by joins of written tables, whose hot keys Spark may split.

Defined cases: a null or blank text has an empty set and links to nothing; a null doc_id keeps
its row (component null) and lends its class nothing; repeated rows keep their rows; equal sets
link; a text of any length is one set; an empty table gives no rows; other columns are ignored by the join
and kept by `first_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textblocks import chunks, distinct_sorted, mix64, shingle_hashes, utf8_column, words_of

WIDTH, PERCENT = 5, 80
FREQUENT_LIMIT = 1 << 17  # n-grams that are put last: 1 MB at most
FREQUENT_LOCAL, FREQUENT_LEAST = 8, 48
FREQUENT_RUN = 2_000_000  # shingles whose repeats are counted together
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 1500
DENSE_LIST = 48  # rows of an n-gram from which the dense product takes it
EXTRA = 10  # a tenth of a set's shingles stand in its prefix beyond the least number
PART_BELOW = np.uint64(int(0.15 * 2**64))  # the part of the hashes that is compared first
GRAM_BITS = np.uint64(2**40 - 1)  # what of a prefix n-gram's hash candidates are searched by
EARLIER = 64  # homes of a class that are looked through for an earlier meeting


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    data, offsets = utf8_column(column)
    for start, end, part, inner in chunks(data, offsets):
        values, begin = shingle_hashes(*words_of(part, inner), width)
        yield start, values, list(distinct_sorted(values, begin))


def _signature(values: np.ndarray) -> int:
    if not len(values):
        return 0
    summed = int(mix64(values + np.uint64(len(values))).sum(dtype=np.uint64))
    folded = int(np.bitwise_xor.reduce(mix64(values ^ np.uint64(0x5851F42D4C957F2D))))
    return int(mix64(np.array([(summed + 3 * folded) % 2**64], dtype=np.uint64)).view(np.int64)[0])


SIGNED = "doc_id long, row_key long, n_shingles long, class long, gram long, times long"


def signed_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document (set size, class) and rows for n-grams that many documents of one run of texts hold."""

    names = ["doc_id", "row_key", "n_shingles", "class", "gram", "times"]

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams = np.sort(np.concatenate(held))
        far = grams[FREQUENT_LOCAL - 1 :] == grams[: len(grams) - FREQUENT_LOCAL + 1]
        often = np.unique(grams[: len(far)][far])
        if len(often):
            times = np.searchsorted(grams, often, "right") - np.searchsorted(grams, often, "left")
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(_signed(often)), pa.array(times.astype(np.int64))], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            classes = np.zeros(batch.num_rows, dtype=np.int64)
            for start, _, sets in _sets(batch.column(1), width):
                for k, own in enumerate(sets):
                    sizes[start + k], classes[start + k] = len(own), _signature(own)
                held += sets
                n_held += sum(len(s) for s in sets)
                if n_held > FREQUENT_RUN:
                    yield from frequent(held)
                    held, n_held = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(classes), none, none], names=names)
        if held:
            yield from frequent(held)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), shared.text_column(docs).alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(shared.trimmed(scan), SIGNED)


def _prefixes(docs: DataFrame, frequent: np.ndarray, copied: np.ndarray, steps: shared.Steps, width: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """The steps written, and of them (class, least hash, size, prefix) of each class with words; copied: a filter of the classes of several documents.

    Only classes that the filter holds are shuffled to leave one row of each. Of a prefix n-gram's hash GRAM_BITS are kept;
    what falls together adds candidates and loses none.
    """
    own_frequent, own_copied = (docs.sparkSession.sparkContext.broadcast(a) for a in (frequent, copied))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = own_frequent.value
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), width):
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                prefixes = []
                for s in sets:
                    n = len(s)
                    keep = n - (percent * n + 99) // 100 + 1 + n // EXTRA
                    if len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        hot = last[at] == s
                        s = np.concatenate((s[~hot], s[hot]))
                    prefixes.append(s[:keep])
                lengths = np.array([len(p) for p in prefixes])
                sizes = pa.array([len(s) for s in sets], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(_signed(np.concatenate(prefixes) & GRAM_BITS)))
                names = np.array([_signature(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array([int(s[0] >> np.uint64(33)) for s in sets], pa.int32()), sizes, lists, pa.array(shared.in_bitmap(own_copied.value, names))],
                    names=["class", "low", "n", "prefix", "copied"],
                )

    rows = docs.select(shared.text_column(docs).alias("text")).mapInArrow(shared.trimmed(scan), "class long, low int, n int, prefix array<long>, copied boolean")
    rows = steps.write(rows, "prefixes")
    firsts = (F.first(c).alias(c) for c in ("low", "n", "prefix"))
    copies = steps.write(rows.filter("copied").groupBy("class").agg(*firsts), "copies")
    return [rows, copies], rows.filter("not copied").drop("copied").unionByName(copies)


def _packed(values: np.ndarray) -> bytes:
    return values.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _packed_part(values: np.ndarray) -> bytes:
    """The distinct low 32 bits of the hashes below PART_BELOW; what falls together counts as not compared."""
    return np.unique(values[: np.searchsorted(values, PART_BELOW)].astype(np.uint32)).tobytes()


def _unpacked_part(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint32)


def _candidate_sets(docs: DataFrame, bitmap: np.ndarray, width: int, part_only: bool) -> DataFrame:
    """(class, n, shingles) of classes that the filter lets through; part_only: only the part with the least hashes."""
    own_bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = own_bitmap.value
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), width):
                sets = [s for s in sets if len(s)]
                names = np.array([_signature(s) for s in sets], dtype=np.int64)
                keep = np.flatnonzero(shared.in_bitmap(bits, names))
                if len(keep):
                    sizes = [len(sets[i]) for i in keep]
                    rows = [(_packed_part if part_only else _packed)(sets[i]) for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], names=["class", "n", "shingles"])

    rows = docs.select(shared.text_column(docs).alias("text")).mapInArrow(shared.trimmed(scan), "class long, n int, shingles binary")
    return rows.groupBy("class").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Counts of common n-grams: left rows by right rows, or left by left where right is None.

    The product of two blocks of incidence rows: n-grams in few rows add their pairs one by one,
    n-grams in many rows go through a dense product in slices.
    """
    rows = left if right is None else left + right
    cut = len(left)
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), [len(s) for s in rows])
    grams = np.concatenate(rows)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1], [True])))
    length = np.diff(edge)
    shift = cut if right is not None else 0
    across = len(rows) - shift
    counts = np.zeros(cut * across, dtype=np.int32)
    for m in np.unique(length[(length > 1) & (length <= DENSE_LIST)]):
        lists = owner[edge[:-1][length == m][:, None] + np.arange(m)]
        a, b = np.triu_indices(m, 1)
        step = max(1, 500_000 // len(a))
        for at in range(0, len(lists), step):
            x, y = lists[at : at + step][:, a].ravel(), lists[at : at + step][:, b].ravel()
            if right is not None:
                keep = (x < cut) & (y >= cut)
                x, y = x[keep], y[keep]
            np.add.at(counts, x * across + y - shift, 1)
    counts = counts.reshape(cut, across)
    heavy = np.flatnonzero(length > DENSE_LIST)
    for at in range(0, len(heavy), 1024):
        part = heavy[at : at + 1024]
        dense = np.zeros((len(rows), len(part)), dtype=np.float32)
        for k, h in enumerate(part):
            dense[owner[edge[h] : edge[h + 1]], k] = 1
        counts += np.rint(dense[:cut] @ dense[shift:].T).astype(np.int32)
    return counts if right is not None else np.triu(counts, 1)


def at_bound(counts: np.ndarray, missing: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether overlap + missing can reach the overlap that the two sizes ask for; missing bounds what was not counted."""
    counts = counts.astype(np.int64) + missing
    return (100 + percent) * counts >= percent * (left[:, None] + right[None, :])


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(member, root) for the members of each component but its root."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


def _block_pairs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], list[dict], list[dict]]]:
    """(home, i, j), left rows, right rows of each pair of blocks; no right rows where a block meets itself."""
    for i in range(batch.num_rows):
        key = tuple(batch.column(c)[i].as_py() for c in ("home", "i", "j"))
        members = batch.column("members")[i].as_py()
        left, right = [m for m in members if m["side"] < 2], [m for m in members if m["side"] == 2]
        if left and (right if key[1] != key[2] else len(left) > 1):
            yield key, left, right


def _parts(left: list[dict], right: list[dict], unpack: Callable[[bytes], np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray] | None, np.ndarray, np.ndarray]:
    a, b = [unpack(m["shingles"]) for m in left], [unpack(m["shingles"]) for m in right]
    n_a, n_b = (np.array([m["n"] for m in part], dtype=np.int64) for part in (left, right))
    return a, b or None, n_a, n_b if right else n_a


def _survivors(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of each pair of blocks that some partner of the pair can reach, judged by a part of the shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, left, right in _block_pairs(batch):
                a, b, n_a, n_b = _parts(left, right, _unpacked_part)
                rest_a = n_a - np.array([len(s) for s in a])
                rest_b = n_b - np.array([len(s) for s in b or a])
                counts = overlaps(a, b)
                can = at_bound(counts, np.minimum(rest_a[:, None], rest_b[None, :]), n_a, n_b, percent)
                # Two classes that met in an earlier home are compared there.
                seen_a, seen_b = ([np.array(m["earlier"], dtype=np.int32) for m in part] for part in (left, right))
                can &= overlaps(seen_a, seen_b or None) == 0
                if b is None:
                    can = np.triu(can, 1)
                    can |= can.T
                    out += [(*key, left[i]["class"], 0) for i in np.flatnonzero(can.any(axis=1))]
                else:
                    out += [(*key, left[i]["class"], 1) for i in np.flatnonzero(can.any(axis=1))]
                    out += [(*key, right[i]["class"], 2) for i in np.flatnonzero(can.any(axis=0))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int8())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["home", "i", "j", "class", "side"])

    return blocks.mapInArrow(shared.trimmed(work), "home int, i int, j int, class long, side byte")


def _block_edges(blocks: DataFrame, percent: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[tuple[int, int]] = []
            for _, left, right in _block_pairs(batch):
                a, b, n_a, n_b = _parts(left, right, _unpacked)
                counts = overlaps(a, b)
                x, y = np.nonzero(at_bound(counts, np.zeros(1, dtype=np.int64), n_a, n_b, percent) & (counts > 0))
                names = [m["class"] for m in left + right]
                ends += [(names[m], names[r]) for m, r in spanning(x, y + (len(left) if right else 0), len(names))]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(shared.trimmed(work), "a long, b long")


def _met(member: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    rows = member.join(sets, "class").groupBy("home", "i", "j")
    return rows.agg(F.collect_list(F.struct("class", "n", "side", "shingles", *more)).alias("members"))


def _shared_grams(prefixes: DataFrame, steps: shared.Steps, percent: int) -> DataFrame:
    """(class, n, home) of each class and prefix n-gram that another class of fitting size may share; home: the least hash of those that hold it."""
    every = prefixes.select("low", "n", F.explode("prefix").alias("gram"))
    held = every.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.min("low").alias("home"), F.min("n").alias("least"), F.max("n").alias("most"))
    common = steps.write(held.filter((F.col("classes") > 2) | ((F.col("classes") == 2) & (100 * F.col("least").cast("long") >= percent * F.col("most").cast("long")))).select("gram", "home"), "common")
    own_bits = prefixes.sparkSession.sparkContext.broadcast(shared.bitmap(common.select(F.xxhash64("gram").alias("key")), "key"))

    # Most n-grams are in one class: a filter of the others spares their way through the join.
    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, grams, keys = (batch.column(c) for c in ("class", "n", "prefix", "keys"))
            keep = shared.in_bitmap(own_bits.value, np.asarray(keys.flatten()))
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(grams.value_lengths()))[keep]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), sizes.take(pa.array(owner)), grams.flatten().filter(pa.array(keep))], names=["class", "n", "gram"])

    keyed = prefixes.select("class", "n", "prefix", F.transform("prefix", lambda g: F.xxhash64(g)).alias("keys"))
    return keyed.mapInArrow(shared.trimmed(thinned), "class long, n int, gram long").join(common, "gram").select("class", "n", "home")


def linked_classes(docs: DataFrame, signed: DataFrame, steps: shared.Steps, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b) edges that connect every two classes that a chain of links joins."""
    frequent = (
        signed.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT_LEAST)
        .orderBy(F.desc("times"), "gram").limit(FREQUENT_LIMIT).select("gram").toPandas()["gram"].to_numpy(dtype=np.int64)
    )
    frequent = np.sort(frequent.view(np.uint64))
    copied = signed.filter("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    kept, prefixes = _prefixes(docs, frequent, shared.bitmap(copied, "class"), steps, width, percent)
    met = _shared_grams(prefixes, steps, percent).groupBy("home", "class", "n").agg(F.count(F.lit(1)).alias("grams"))
    # A linked pair has at least n / EXTRA - 1 n-grams in common within the two prefixes, whichever of them n is the size of.
    enough = F.sum("grams").over(Window.partitionBy("class")) >= F.col("n") / EXTRA - 1
    homes = steps.write(met.withColumn("enough", enough).filter("enough").select("home", "class", "n"), "homes")
    steps.drop(*kept)
    cut = (
        homes.groupBy("home")
        .agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("classes"))
        .filter("classes > 1")
        .select("home", F.greatest(F.ceil(F.col("held") / BLOCK_SHINGLES), F.ceil(F.col("classes") / BLOCK_ROWS)).cast("int").alias("blocks"))
    )
    cut = steps.write(cut, "blocks")
    member = homes.select("home", "class").join(cut, "home").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Whatever earlier homes are listed, two classes meet in their first common one and have none before it.
    member = member.withColumn("earlier", F.collect_list("home").over(Window.partitionBy("class").orderBy("home").rowsBetween(-EARLIER, -1)))
    # Block i meets itself and each j > i; side 1 is the first and side 2 the second of two blocks, side 0 a block alone.
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class",
        "home",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
        "earlier",
    )
    parts = _candidate_sets(docs, shared.bitmap(homes, "class"), width, True)
    left = steps.write(_survivors(_met(member, parts, "earlier"), percent), "survivors")
    wholes = _candidate_sets(docs, shared.bitmap(left, "class"), width, False)
    return steps.write(_block_edges(_met(left, wholes), percent), "links")


def _classified(docs: DataFrame, steps: shared.Steps, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, row_key, n_shingles, class of each document, and class, component of each class with words."""
    signed = steps.write(signed_sets(docs, width), "signed")
    joined = shared.components(linked_classes(docs, signed, steps, width, percent), steps=steps)
    rows = signed.filter("gram is null").select("doc_id", "row_key", "n_shingles", "class")
    classes = steps.write(rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("class_id")), "classes")
    classes = classes.join(joined, classes["class"] == joined["node"], "left").select("class", "class_id", F.coalesce("component", "class").alias("component"))
    return rows, steps.write(classes, "classes")


def ngram_jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach, itself included), class_id (least doc_id with an equal set)."""
    spark = docs.sparkSession
    with shared.held(spark, shared.small_batches(spark)), shared.Steps(spark) as steps:
        rows, classes = _classified(docs, steps, width, percent)
        names = steps.write(classes.groupBy("component").agg(F.min("class_id").alias("component_id")), "names")
        named = steps.write(classes.join(shared.broadcast_if_small(names), "component").select("class", "class_id", "component_id"), "named")
        words = rows.filter("n_shingles > 0").join(named, "class", "left").drop("class", "row_key")
        blank = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
        known = F.col("doc_id").isNotNull()
        out = words.unionByName(blank).select("doc_id", "n_shingles", *(F.when(known, F.col(c)).alias(c) for c in ("component_id", "class_id")))
        return steps.write(out, "joined", keep=True)


def first_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without those that links join to an earlier one: of each component one row stays, that of least doc_id (null last), then of least key.

    Texts without words all stay.
    """
    spark = docs.sparkSession
    with shared.held(spark, shared.small_batches(spark)), shared.Steps(spark) as steps:
        rows, classes = _classified(docs, steps, width, percent)
        place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("row_key"))
        # Per class first, so that a set in very many rows is summed up before it meets its component.
        best = rows.filter("n_shingles > 0").groupBy("class").agg(F.min(place).alias("best"))
        best = steps.write(best, "best")
        first = classes.join(best, "class").groupBy("component").agg(F.min("best").alias("best")).select("best.doc_id", "best.row_key")
        first = steps.write(first, "first")
        times = rows.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
        same = first["doc_id"].eqNullSafe(F.col("d")) & (first["row_key"] == F.col("k"))
        first = first.join(times.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "times"), same).select("doc_id", "row_key", "times")
        first = steps.write(first, "first")
        once, again = (shared.written(first.filter(c).select(F.col("doc_id").alias("d"), F.col("row_key").alias("k")), "kept") for c in ("times = 1", "times > 1"))
        own = docs.select(shared.text_column(docs).alias("text"), shared.boxed(docs), docs["doc_id"].cast("long").alias("doc_id")).withColumn("row_key", F.xxhash64("doc_id", "text"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))
        # All rows with words but those that are first and alone; the others need no look.
        others = rows.filter("n_shingles > 0").select("doc_id", "row_key").join(once, same, "left_anti").select("row_key")
        clear, touched = shared.split_by_keys(own, "row_key", others, steps)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = touched.join(once, same, "left").filter(~words | F.col("k").isNotNull()).select("text", "row")
    # Rows alike in doc_id and text: the copies of one task become one before they are shuffled.
    copies = touched.join(shared.broadcast_if_small(again), same).groupBy("d", "k").agg(F.first(F.struct("text", "row")).alias("one")).select("one.text", "one.row")
    return shared.unboxed(clear.select("text", "row").unionByName(single).unionByName(copies), docs)
