"""Line dedup: repeated runs of lines, found by winnowed fingerprints over line hashes.

From every line on, the shortest run of lines with at least MIN_WORDS words is a window. The line of least hash
in a window is selected: a run of that many words that two places share holds a window, and so the same
selected line, at both. A selected line is posted once, by its hash, with hashes of the windows that selected it. Lines
selected in one place only are dropped; the other positions join on line hash and window hash with the first
such position of the corpus. Each match is extended to both sides, and the lines of the later place go. A run that overlaps
its own source (lines that repeat within one document) loses only what follows the first windows of each phase: from where
MIN_WORDS words stand behind the line before it. So each run of MIN_WORDS words that went is in an earlier place still.

Documents are ordered by (doc_id, hash of doc_id and text). Each window joins with one first position, so a line or
passage in a third of all documents stays linear, and every join is between written tables, whose hot keys Spark may
split. A match is extended by halving over prefix hashes, so its length costs nothing.

Defined cases: a null text stays null; an empty text, blank lines and line ends stay as they are
unless a removed run holds them; runs under MIN_WORDS words stay, however often they occur; a null doc_id sorts
first; rows with equal doc_id and text count as one document, and all keep the same text; an empty table gives no
rows; other columns pass through, whatever their names, but for n_lines_removed, which `dedup_lines` replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textblocks import IS_SPACE, chunks, mix64, span_hashes, spans, utf8_column

MIN_WORDS = 50
_NEWLINE = 10
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def _lines(part: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (empty ones too), the first line of each text, and the words of each line."""
    cuts = np.flatnonzero(part == _NEWLINE)
    text_of = np.searchsorted(inner, cuts, side="right") - 1
    rows = len(inner) - 1
    count = np.bincount(text_of, minlength=rows) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    starts = np.empty(first[-1], dtype=np.int64)
    ends = np.empty(first[-1], dtype=np.int64)
    inside = np.ones(first[-1], dtype=bool)
    inside[first[:-1]] = False
    starts[first[:-1]] = inner[:-1]
    starts[inside] = cuts + 1
    inside[:] = True
    inside[first[1:] - 1] = False
    ends[first[1:] - 1] = inner[1:]
    ends[inside] = cuts
    word_starts, _ = spans(~IS_SPACE[part], inner)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    return starts, ends, first, words


def _windows(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first line, its fingerprint's line (least hash, the first of equals), and a hash of the whole window."""
    total = np.concatenate(([0], np.cumsum(words)))
    begin = np.arange(len(words))
    text = np.searchsorted(first, begin, side="right") - 1
    end = np.searchsorted(total, total[:-1] + least)  # lines begin..end-1 hold enough words
    good = (end <= first[text + 1]) & (words > 0)
    begin, end = begin[good], end[good]
    anchor = np.empty(len(begin), dtype=np.int64)
    digest = np.zeros(len(begin), dtype=np.uint64)
    length = end - begin
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        step = max(1, 1_000_000 // int(size))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            places = begin[some][:, None] + np.arange(size)
            own = hashes[places]
            anchor[some] = begin[some] + own.argmin(axis=1)
            spread = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
            digest[some] = mix64((own * spread[None, :]).sum(axis=1, dtype=np.uint64) + np.uint64(size))
    return begin, anchor, digest


def _postings(rows: DataFrame, min_words: int) -> DataFrame:
    """(fingerprint, id, row_key, line, windows): a row per selected line, with a hash of each window that selected it."""
    names = ["fingerprint", "id", "row_key", "line", "windows"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            for start, _, part, inner in chunks(data, offsets):
                starts, ends, first, words = _lines(part, inner)
                hashes = span_hashes(part, starts, ends)
                _, anchor, digest = _windows(hashes, words, first, min_words)
                by = np.lexsort((digest, anchor))
                anchor, digest = anchor[by], digest[by]
                edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))[: len(anchor)]
                chosen = anchor[edge]
                text = start + np.searchsorted(first, chosen, side="right") - 1
                line = (chosen - first[text - start]).astype(np.int32)
                take = pa.array(text)
                windows = pa.ListArray.from_arrays(pa.array(np.append(edge, len(anchor)).astype(np.int32)), pa.array(digest.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[chosen].view(np.int64)), batch.column("id").take(take), batch.column("row_key").take(take), pa.array(line), windows], names=names)

    return rows.select("id", "text", "row_key").mapInArrow(shared.trimmed(scan), "fingerprint long, id long, row_key long, line int, windows array<long>")


def _line_hashes(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(id, row_key, hashes, words): the lines of each document that the filter lets through."""
    own_wanted = rows.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.in_bitmap(own_wanted.value, np.asarray(batch.column("row_key")))))
            data, offsets = utf8_column(batch.column("text"))
            for start, end, part, inner in chunks(data, offsets):
                starts, ends, first, words = _lines(part, inner)
                cuts = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (span_hashes(part, starts, ends).view(np.int64), words.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, end - start) for c in ("id", "row_key")] + lists, names=["id", "row_key", "hashes", "words"])

    found = rows.select("id", "text", "row_key").mapInArrow(shared.trimmed(scan), "id long, row_key long, hashes array<long>, words array<int>")
    return found.groupBy("id", "row_key").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))


class Runs:
    """Hashes of any run of lines in constant time, from prefix sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        steps = np.full(len(hashes) + 1, _BASE, dtype=np.uint64)
        steps[0] = 1
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix64(hashes.view(np.uint64)) * np.cumprod(steps)[:-1], out=self.sums[1:])
        steps[1:] = _BASE_INV
        self.down = np.cumprod(steps)

    def at(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        return (self.sums[past] - self.sums[first]) * self.down[first]


def extend(target: np.ndarray, source: np.ndarray, at: np.ndarray, from_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places the run of target lines around `at` that equals the source lines around `from_`: [first, past the last)."""
    own, other = Runs(target), Runs(source)

    def reach(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()  # the run of length low is alike, none longer than high is
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = same(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    left = reach(np.minimum(at, from_), lambda n: own.at(at - n, at) == other.at(from_ - n, from_))
    right = reach(np.minimum(len(target) - at, len(source) - from_), lambda n: own.at(at, at + n) == other.at(from_, from_ + n))
    return at - left, at + right


def clear_of_source(first: np.ndarray, past: np.ndarray, shift: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """Where the runs of one document may begin to go, if their sources lie `shift` lines before them; total: words before each line."""
    kept = np.searchsorted(total, total[np.maximum(first - 1, 0)] + least)
    return np.where(past - shift > first, np.minimum(np.maximum(first, kept), past), first)


def _merged(runs: np.ndarray) -> np.ndarray:
    """(n, 2) runs [first, past) as ordered runs that do not touch."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    most = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.concatenate(([True], runs[1:, 0] > most[:-1])))
    return np.stack((runs[new, 0], most[np.append(new[1:], len(runs)) - 1]), axis=1)


def _pairs_of(column: pa.Array) -> np.ndarray:
    """(n, 2) from a value of type array<struct<two ints>>."""
    held = column.values
    return np.stack([np.asarray(held.field(k), dtype=np.int64) for k in (0, 1)], axis=1)


def repeated_lines(rows: DataFrame, steps: shared.Steps, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, row_key, kept, n_gone): for each document that repeats an earlier run, the runs of lines that stay (first, number)."""
    postings = steps.write(_postings(rows, min_words), "postings")
    often = steps.write(postings.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "often")
    places = postings.join(often, "fingerprint", "left_semi").select(F.explode(F.transform("windows", lambda w: F.xxhash64("fingerprint", w))).alias("window"), "id", "row_key", "line")
    places = steps.write(places, "places")
    steps.drop(postings, often)
    position = F.struct("id", "row_key", "line")
    firsts = steps.write(places.groupBy("window").agg(F.min(position).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "f"), "firsts")
    later = places.join(firsts, "window").filter(position != F.col("f"))
    pairs = F.collect_set(F.struct("line", F.col("f.line").alias("from_line"))).alias("pairs")
    matches = steps.write(later.groupBy("id", "row_key", F.col("f.id").alias("from_id"), F.col("f.row_key").alias("from_key")).agg(pairs), "matches")
    steps.drop(places, firsts)
    hashes = steps.write(_line_hashes(rows, shared.bitmap(matches.select("row_key").union(matches.select(F.col("from_key").alias("row_key"))), "row_key")), "hashes")
    own = steps.write(matches.join(hashes, ["id", "row_key"]), "own")
    source = hashes.select(F.col("id").alias("from_id"), F.col("row_key").alias("from_key"), F.col("hashes").alias("from_hashes"))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for k in range(batch.num_rows):
                target, source, words = (np.asarray(batch.column(c)[k].values) for c in ("hashes", "from_hashes", "words"))
                pairs = _pairs_of(batch.column("pairs")[k])
                first, past = extend(target, source, pairs[:, 0], pairs[:, 1])
                total = np.concatenate(([0], np.cumsum(words)))
                if batch.column("own_source")[k].as_py():
                    first = clear_of_source(first, past, pairs[:, 0] - pairs[:, 1], total, min_words)
                enough = total[past] - total[first] >= min_words
                gone.append(_merged(np.stack((first, past), axis=1)[enough]) if enough.any() else np.zeros((0, 2), dtype=np.int64))
            held = np.concatenate(gone)
            runs = pa.StructArray.from_arrays([pa.array(held[:, k].astype(np.int32)) for k in (0, 1)], names=["first", "past"])
            cuts = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in gone]))).astype(np.int32))
            lines = pa.array([len(x) for x in batch.column("hashes")], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), lines, pa.ListArray.from_arrays(cuts, runs)], names=["id", "row_key", "lines", "gone"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_gone = [], []
            for k in range(batch.num_rows):
                gone, lines = _merged(_pairs_of(batch.column("gone")[k])), batch.column("lines")[k].as_py()
                edges = np.concatenate(([0], gone.ravel(), [lines])).reshape(-1, 2)  # between the runs that go
                kept.append([{"first": int(a), "n": int(b - a)} for a, b in edges if b > a])
                n_gone.append(int((gone[:, 1] - gone[:, 0]).sum()))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), pa.array(kept, kind), pa.array(n_gone, pa.int32())], names=["id", "row_key", "kept", "n_gone"])

    own_source = (F.col("id") == F.col("from_id")) & (F.col("row_key") == F.col("from_key"))
    met = own.join(source, ["from_id", "from_key"]).select("id", "row_key", "pairs", "hashes", "words", "from_hashes", own_source.alias("own_source"))
    runs = met.mapInArrow(shared.trimmed(runs_of), "id long, row_key long, lines int, gone array<struct<first int, past int>>").filter(F.size("gone") > 0)
    runs = runs.groupBy("id", "row_key").agg(F.first("lines").alias("lines"), F.flatten(F.collect_list("gone")).alias("gone"))
    return runs.mapInArrow(shared.trimmed(stay), "id long, row_key long, kept array<struct<first int, n int>>, n_gone int")


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """text (without the later repeats), row (the other columns) and n_gone."""
    spark = docs.sparkSession
    own = docs.select(shared.text_column(docs).alias("text"), shared.boxed(docs), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"))
    own = own.withColumn("row_key", F.xxhash64("id", "text"))
    with shared.held(spark, shared.small_batches(spark)), shared.Steps(spark) as steps:
        gone = shared.written(repeated_lines(own.select("id", "text", "row_key"), steps, min_words), "gone")
        clear, touched = shared.split_by_keys(own, "row_key", gone, steps)
    lines = F.split("text", "\n")
    text: Column = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")
    done = touched.join(gone, ["id", "row_key"], "left")
    done = done.select(F.when(F.col("kept").isNull(), F.col("text")).otherwise(text).alias("text"), "row", F.coalesce("n_gone", F.lit(0)).alias("n_gone"))
    return clear.select("text", "row", F.lit(0).alias("n_gone")).unionByName(done)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later repeats of runs of lines deleted from text, and n_lines_removed; other columns as they are."""
    docs = docs.drop("n_lines_removed")
    return shared.unboxed(_cleaned(docs, min_words), docs, F.col("n_gone").alias("n_lines_removed"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same with the columns of docs alone; a document of which only blanks are left is left out."""
    emptied = (F.col("n_gone") > 0) & (F.length(F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     "))) == 0)
    return shared.unboxed(_cleaned(docs, min_words).filter(~F.coalesce(emptied, F.lit(False))), docs)
