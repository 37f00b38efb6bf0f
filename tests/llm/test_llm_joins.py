"""N-gram join, line dedup, mixing, nearest neighbours and components against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from odd_columns import HELPERS
from pyspark.sql import functions as F

from lumigate.llm import ann, line_dedup, mixing, ngram_join, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class long, gram string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], SCHEMA)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_hand(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 160))) for _ in range(40)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows, i = [], 0
    for b in base:
        for text in [b] * rng.randrange(1, 3) + [edited(rng, b, rng.randrange(1, 5)) for _ in range(rng.randrange(0, 4))] + [b + " " + passage]:
            rows.append((i, text))
            i += 1
    hot = " ".join(f"h{k}" for k in range(120))
    for _ in range(60):
        rows.append((i, edited(rng, hot, rng.randrange(0, 4))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n "), (i + 3, "One two"), (i + 4, "one TWO"), (i + 5, "one two three"), (i + 6, "É \x1c x"), (i + 7, "x " * 3000)]
    return rows


def join_result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("blocks", [400_000, 500])
def test_ngram_join_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks)
    monkeypatch.setattr(ngram_join, "DENSE_LIST", 48 if blocks > 1000 else 3)
    rows = corpus()
    out = ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3))
    assert join_result(out) == components_by_hand(rows)


def test_ngram_join_compares_a_pair_in_one_home(spark, monkeypatch):
    """Two near copies, and longer texts that hold a part of them each: these give the parts homes of their own but reach no link."""
    rng = random.Random(3)
    text = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(text)), (1, " ".join([*text[:-3], "x", "y", "z"]))]
    rows += [(2 + k, " ".join(text[k * 50 : k * 50 + 50] + [f"o{rng.randrange(10**6)}" for _ in range(800)])) for k in range(8)]
    seen, write = {}, shared.Steps.write

    def kept(self, df, name, keep=False):
        out = write(self, df, name, keep)
        if name in ("blocks", "survivors"):
            seen[name] = out.collect()
        return out

    monkeypatch.setattr(shared.Steps, "write", kept)
    for earlier in (64, 1):
        monkeypatch.setattr(ngram_join, "EARLIER", earlier, raising=False)
        assert join_result(ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows]))) == components_by_hand(rows)
        assert len(seen["blocks"]) > 1, "the two met in one home alone"
        assert len(seen["survivors"]) == 2
    rows = corpus(7)
    assert join_result(ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows]))) == components_by_hand(rows)


def test_ngram_join_shuffles_prefixes_of_copies_alone(spark, monkeypatch):
    """A class of one document keeps its prefix where it is; short hashes of its n-grams that fall together add candidates alone."""
    seen, write = {}, shared.Steps.write

    def kept(self, df, name, keep=False):
        out = write(self, df, name, keep)
        if name == "copies":
            seen[name] = out.count()
        return out

    monkeypatch.setattr(shared.Steps, "write", kept)
    rows = corpus(9)
    for bits in (40, 6):
        monkeypatch.setattr(ngram_join, "GRAM_BITS", np.uint64(2**bits - 1), raising=False)
        assert join_result(ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3))) == components_by_hand(rows)
        times = collections.Counter(frozenset(shingles(t)) for _, t in rows)
        assert seen["copies"] == sum(n > 1 for s, n in times.items() if s)


def test_ngram_join_with_frequent_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LOCAL", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 2)
    rows = corpus(5)
    assert join_result(ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows]))) == components_by_hand(rows)


def test_ngram_join_odd_rows(spark):
    out = ngram_join.ngram_jaccard_join(docs_of(spark, [(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (9, "A b c d e f", "s"), (None, None, "s")]))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out.collect())
    assert [g[:3] for g in got] == [(False, 5, 2), (False, 5, 2), (False, 9, 2), (True, 0, 0), (True, 0, 2)]
    assert [g[3] for g in got[:3]] == [5, 5, 5] and got[3][3] is None and got[4][3] is None
    assert ngram_join.ngram_jaccard_join(docs_of(spark, [])).count() == 0


def test_overlap_kernel():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in rows] for a in rows])
    assert (ngram_join.overlaps(rows, None) == np.triu(want, 1)).all()
    assert (ngram_join.overlaps(rows[:30], rows[30:]) == want[:30, 30:]).all()


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_filter_loses_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = shared.bitmap(keys.filter("pmod(k, 3) = 0"), "k")
    held = np.array([r.k for r in keys.collect()])
    found = shared.in_bitmap(bits, held)
    assert found[held % 3 == 0].all() and found.sum() < 1.05 * (held % 3 == 0).sum() + 5


def test_written_steps_go_with_their_job(spark):
    import os

    folder = shared.fresh(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    with shared.Steps(spark) as steps:
        a, b = steps.write(spark.range(3).toDF("a"), "one"), steps.write(spark.range(4).toDF("a"), "two", keep=True)
        steps.drop(a)
        steps.write(spark.range(3).toDF("a"), "three")
        assert len(set(os.listdir(folder)) - before) == 2
    assert len(set(os.listdir(folder)) - before) == 1 and b.count() == 4
    ngram_join.ngram_jaccard_join(docs_of(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s")])).count()
    assert len(set(os.listdir(folder)) - before) == 2


def test_settings_are_given_back(spark):
    before = spark.conf.get(shared.BATCH_BYTES)
    ngram_join.ngram_jaccard_join(docs_of(spark, [(1, "a b", "s")])).count()
    line_dedup.dedup_lines(docs_of(spark, [(1, "a b", "s")])).count()
    assert spark.conf.get(shared.BATCH_BYTES) == before


def clashing(spark, rows):
    base = docs_of(spark, rows).drop("class", "gram")
    return base.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in HELPERS if c not in base.columns})


def test_columns_of_any_name_pass_through(spark):
    passage = " ".join(f"q{k}" for k in range(55))
    rows = [(i, f"t{i} u{i} v{i} w{i} x{i} y{i}\n" * 3 + (passage if i % 3 == 0 else ""), f"s{i % 2}") for i in range(12)] + [(None, None, None), (12, "", "s1")]
    df = clashing(spark, rows)
    for out in (line_dedup.dedup_lines(df).drop("n_lines_removed"), line_dedup.without_repeats(df), mixing.mix(df, max_repetition=2.0).drop(*mixing.MADE), mixing.repeated(df, max_repetition=2.0), ngram_join.first_of_each(df)):
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in HELPERS if c not in ("lang",))
    assert ngram_join.ngram_jaccard_join(df).count() == len(rows)


def test_first_of_each(spark):
    a, b = "a b c d e f g h", "other words here now and then"
    rows = [(5, a, "s"), (5, a, "s"), (5, b, "s"), (3, b, "s"), (7, a, "s"), (None, a, "s"), (None, "x y z", "s"), (None, "x y z", "t"), (8, None, "s"), (8, " ", "s"), (8, None, "s")]
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in ngram_join.first_of_each(docs_of(spark, rows)).collect())
    assert out == [(-1, "x y z"), (3, b), (5, a), (8, ""), (8, ""), (8, " ")]
    assert ngram_join.first_of_each(docs_of(spark, [])).count() == 0


def test_texts_of_a_megabyte_are_linear(spark):
    """Equal lines, one line of letters, and one passage repeated within a text."""
    passage = "\n".join(f"line {k} of the passage" for k in range(40))
    rows = [(1, "a\n" * 500_000, "s"), (2, "x" * 1_000_000, "s"), (3, (passage + "\n") * 1000, "s"), (4, passage, "s"), (5, "w " * 500_000, "s")]
    began = time.time()
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert time.time() - began < 60
    assert out[2] == rows[1][1] and out[5] == rows[4][1] and out[4] == "" and out[3].startswith(passage) and len(out[3]) < 2 * len(passage)
    assert len(out[1]) <= 110 and set(out[1]) <= {"a", "\n"}
    assert ngram_join.ngram_jaccard_join(docs_of(spark, rows)).count() == 5


def test_extension_equals_a_walk():
    rng = np.random.default_rng(4)
    for _ in range(60):
        t, s = (rng.integers(0, 3, rng.integers(1, 30)).astype(np.int64) for _ in range(2))
        at, from_ = rng.integers(0, len(t), 8), rng.integers(0, len(s), 8)
        first, past = line_dedup.extend(t, s, at, from_)
        for i, j, a, b in zip(at, from_, first, past, strict=True):
            p, q = i, j
            while p and q and t[p - 1] == s[q - 1]:
                p, q = p - 1, q - 1
            e, f = i, j
            while e < len(t) and f < len(s) and t[e] == s[f]:
                e, f = e + 1, f + 1
            assert (a, b) == (p, e)


# --- line dedup ---------------------------------------------------------------------------------


def dedup_by_hand(rows, least):
    """Windows of at least `least` words from each line; a later one is matched with its first place and both ways from it."""
    lines = [(t or "").split("\n") for _, t in rows]
    count = [[len(WORD.findall(x)) for x in own] for own in lines]
    first, gone = {}, collections.defaultdict(set)
    for k, own in enumerate(lines):
        for i in range(len(own)):
            total, j = 0, i
            while j < len(own) and total < least:
                total += count[k][j]
                j += 1
            if not count[k][i] or total < least:
                continue
            f, g = first.setdefault(tuple(own[i:j]), (k, i))
            if (f, g) == (k, i):
                continue
            a, b, c, d = i, g, j, g + j - i
            while a and b and own[a - 1] == lines[f][b - 1]:
                a, b = a - 1, b - 1
            while c < len(own) and d < len(lines[f]) and own[c] == lines[f][d]:
                c, d = c + 1, d + 1
            if f == k and c - (i - g) > a:  # it overlaps its source: the windows of each phase stay once
                total, e = 0, a - 1
                while e < c and total < least:
                    total += count[k][e]
                    e += 1
                a = max(a, e) if total >= least else c
            if sum(count[k][a:c]) >= least:
                gone[k] |= set(range(a, c))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(lines[k]) if n not in gone[k]) for k, (i, t) in enumerate(rows)}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 9))) for _ in range(25)]
    runs = [rng.choices(pool, k=rng.randrange(2, 7)) for _ in range(6)]
    long_line = " ".join(f"z{k}" for k in range(60))
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += rng.choices(pool, k=rng.randrange(0, 3)) + rng.choice(runs) + ([long_line] if rng.random() < 0.3 else [])
        rows.append((i, "\n".join(text)))
    rows += [(70, None), (71, ""), (72, "\n\n\n"), (73, rows[0][1]), (74, "a\n" * 300)]
    for least in (8, 20):
        out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3), least).collect()}
        assert out == dedup_by_hand(rows, least)


def test_a_document_of_repeated_lines_keeps_its_source(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    rows = [(1, "\n".join([line(12)] * 30), "s"), (2, "\n".join([line(12)] * 9), "s"), (3, "\n".join([line(60)] * 3), "s")]
    for i in range(4, 24):
        rows.append((i, "\n".join([line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))] * rng.randrange(2, 30)), "s"))
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert [len(out[i].split("\n")) for i in (1, 2, 3)] == [5, 9, 1]
    for i, text, _ in rows:
        lines, left = text.split("\n"), out[i].split("\n")
        assert left == lines[: len(left)]
        for start in range(len(left), len(lines)):
            end, words = start, 0
            while end < len(lines) and words < 50:
                words, end = words + len(lines[end].split()), end + 1
            if words >= 50:  # every run of so many words that went stands in what is left
                assert "\n".join(lines[start:end]) in out[i]


def test_line_dedup_odd_rows(spark):
    passage = " ".join(f"q{k}" for k in range(55))
    df = docs_of(spark, [(1, f"x\n{passage}\ny", "s"), (1, f"x\n{passage}\ny", "s"), (2, f"{passage}\nz", "s"), (None, f"{passage}", "s"), (3, passage[:100], "s")])
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines_removed) for r in out.collect())
    # A null doc_id sorts first, so its passage is the one that stays.
    assert got[0] == (-1, passage, 0) and got[1:3] == [(1, "x\ny", 1)] * 2 and got[3] == (2, "z", 1) and got[4][2] == 0
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


# --- mixing -------------------------------------------------------------------------------------


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def mixed_by_hand(rows, block_tokens, budget=None, max_repetition=None, target_entropy=None):
    """(doc_id, epoch, block, place) of every copy, by plain loops."""
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(WORD.findall(t or ""))
    some = {s: t for s, t in tokens.items() if t}
    total = sum(some.values())

    def times(e):
        w = {s: (t / total) ** e for s, t in some.items()}
        size = budget if budget is not None else max(t / x * sum(w.values()) for t, x in zip(some.values(), w.values(), strict=True))
        return {s: x / sum(w.values()) * size / some[s] for s, x in w.items()}

    def entropy(e):
        w = [(t / total) ** e for t in some.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    low, high = 0.0, 1.0
    good = (lambda e: max(times(e).values()) <= max_repetition * (1 + 1e-12)) if max_repetition is not None else (lambda e: entropy(1 - e) >= target_entropy)
    if some and good(0.0):
        high = 0.0
    for _ in range(40 if some and high else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    taken = times(high if max_repetition is not None else 1 - high) if some else {}
    out = []
    for s in tokens:
        r = taken.get(s, 1.0)
        whole = math.floor(r + 1e-9)
        rest, blocks = (r - whole) * tokens[s], max(1, tokens[s] // block_tokens)
        own = [(i, len(WORD.findall(t or "")), number(0, "" if i is None else i, t or "")) for i, t, x in rows if x == s]
        order = sorted({(number(0, whole, k % blocks), number(0, whole, k)) for _, n, k in own if n})
        last, so_far = (-1, -1), 0
        for o, p in order:
            here = sum(n for _, n, k in own if n and (number(0, whole, k % blocks), number(0, whole, k)) == (o, p))
            block = sum(n for _, n, k in own if n and number(0, whole, k % blocks) == o)
            before = sum(n for _, n, k in own if n and number(0, whole, k % blocks) < o)
            so_far = so_far + here
            if before < rest <= before + block:
                last = max(last, (o, -1))
                if so_far <= rest:
                    last = (o, p)
        for i, _, k in own:
            part = rest > 0 and (number(0, whole, k % blocks), number(0, whole, k)) <= last
            out += [(i, e, number(0, e, k % blocks), number(0, e, k)) for e in range(whole + part)]
    return sorted(out, key=str)


def test_mixing_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, "t " * rng.randrange(1, 30), "hot" if i % 3 else f"s{i % 4}") for i in range(500)] + [(900, None, "s1"), (901, "", None), (902, "t t", None), (903, None, "blank"), (904, "t t t", "s1"), (904, "t t t", "s1"), (None, "t", "s2")]
    df = docs_of(spark, rows).repartition(3)
    for options in ({"max_repetition": 2.5}, {"budget": 4000.0, "target_entropy": 1.2}, {"budget": 9000.0, "max_repetition": 4.0}):
        out = mixing.mix(df, block_tokens=128, **options).collect()
        assert sorted(((r.doc_id, r.mix_epoch, r.mix_block, r.mix_place) for r in out), key=str) == mixed_by_hand(rows, 128, **options)
    assert mixing.mix(docs_of(spark, []), max_repetition=2.0).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, "a"), (2, " ", None)]), max_repetition=2.0).count() == 2


def test_mixing_knows_no_bound_of_sources(spark):
    docs = spark.range(100_001).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    assert mixing.mix(docs.unionByName(docs.limit(1)), max_repetition=1.5).count() >= 100_002


# --- nearest neighbours -------------------------------------------------------------------------


def test_nearest_on_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 1500)] + 0.6 * rng.standard_normal((1500, 32))).astype(np.float32)
    x[3] = x[4] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [0.0] * 32, 1), (2100, [float("nan")] * 32, 1), (2150, [1.0], 1), (2200, [None] + [1.0] * 31, 1)]
    monkeypatch.setattr(ann, "SHARD_ROWS", 600)
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(np.float64)
    norm = np.sqrt((unit * unit).sum(axis=1))
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    hits = 0
    for q, found in got.items():
        s = (unit * unit[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -2
        true = np.lexsort((np.arange(1500), -s))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(s[i] == score for _, i, score in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(true) & {i for _, i, _ in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in got[50]][:2] == [3, 4]


@pytest.mark.parametrize(("sf", "every", "rows"), [("sf0.001", 10, None), ("sf0.01", 50, 300), ("sf0.1", 200, None)])
def test_recall_on_the_given_vectors(spark, monkeypatch, sf, every, rows):
    """Over one shard, over several, and over shards of full size."""
    if rows:
        monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    held = table.toPandas()
    x = np.stack(held["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = held["vec_id"].to_numpy()
    got = collections.defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % every == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(found & set(ids[np.lexsort((ids, -s))][:5].tolist()))
    assert len(got) == sum(ids % every == 0) and hits / (5 * len(got)) >= 0.9


def test_a_very_common_vector_ties_by_id(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:700] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    for q in range(100, 700, 100):
        assert found[q] == [i for i in range(100, 110) if i != q][:5]


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op5_mixing"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    import pyarrow.dataset as ds

    from lumigate.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.register("documents", ds.dataset(f"{sf}/documents.parquet").to_table())
    found = con.sql(queries.ORACLES[name])
    names = found.columns
    assert sorted(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, sf).collect()) == sorted(found.fetchall())


def test_nearest_with_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
