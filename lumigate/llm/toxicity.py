"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters by itself and by its characters. By itself: a vector learned with the network, and evidence from labelled
documents, the lower bound of a smoothed log odds ratio, floored at 0. By its characters: the mean of the vectors
of its byte grams (all of 4 and 5 bytes, and its first 3, 4 and 5), and the largest evidence of any of them. Words
and grams have a vector where they have evidence or a share of COMMON of the fitted documents holds them, at every size of the
table; the others' is zero, since what a few documents hold tells nothing. Of the labelled documents that share one of their least shingle hashes one counts, as copies tell
nothing new. The network reads windows of WINDOW words that overlap by a third, forwards and backwards; attention
pools its states into one logit. A document's score is the calibrated largest logit of all its windows. Windows
without any known word or gram share one input, and so one logit, which is computed once.

Fitting takes a bounded sample of labelled rows, at most FIT_TOXIC of label 1 and FIT_CLEAN of label 0 by hash order,
with at most FIT_BYTES of text, and of each clean one CLEAN_WINDOWS windows. The calibration weights the sample's
documents so that the two labels have the shares they have in the whole table, so scores do not depend on where the
bounds fall. Labels of rows held out never enter any of this, and lang, source and doc_id are no inputs.

Defined cases: a null or empty text is one window without words; a long text has as many windows as it
needs; a null doc_id is not held out and lends no label; without labelled rows of both kinds every score is 0; repeated
rows get equal scores; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textblocks import LOWER_AZ, chunks, distinct_sorted, mix64, shingle_hashes, span_hashes, spans, utf8_column, words_of

FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 2_000, 4_000, 64 << 20
CLEAN_WINDOWS = 4
WINDOW, STRIDE, HIDDEN, POOLED = 64, 44, 8, 8
VECTOR, COMMON, DECAY = 4, 0.025, 0.1
INPUTS = 2 + 2 * VECTOR
BUCKET_BITS, FILTER_BITS = 22, 20
BOUND_Z = 3.0
STEPS, BATCH, RATE = 200, 256, 0.02
CUT = 0.3
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _words(part: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; of distinct words their spans; which distinct word each word is; where each text's words begin."""
    part = LOWER_AZ[part]
    starts, ends = spans(_IN_WORD[part], inner)
    _, first, which = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
    return part, starts[first], ends[first], which, np.searchsorted(starts, inner)


def _char_grams(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of the byte grams of each word: all of 4 and 5 bytes, and the first 3, 4 and 5 marked as such."""
    words, hashes = [], []
    length = ends - starts
    packed = np.zeros(len(part), dtype=np.uint64)
    for n in range(1, 6):
        packed = packed[: len(part) - n + 1] << np.uint64(8) | part[n - 1 :] if n > 1 else part.astype(np.uint64)
        if n < 3:
            continue
        long_enough = np.flatnonzero(length >= n)
        words.append(long_enough)
        hashes.append(mix64(packed[starts[long_enough]] + np.uint64((n << 50) + (1 << 49))))
        if n > 3:
            count = length[long_enough] - n + 1
            at = np.repeat(starts[long_enough], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            words.append(np.repeat(long_enough, count))
            hashes.append(mix64(packed[at] + np.uint64(n << 50)))
    return np.concatenate(words), np.concatenate(hashes)


def _bounds(counts: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Lower bounds of log odds ratios, floored at 0; counts: (2, n) of clean and toxic documents."""
    share = n_toxic / (n_toxic + n_clean)
    toxic, clean = counts[1] + share, counts[0] + 1 - share
    ratio = np.log(toxic / clean) - np.log(share / (1 - share))
    return np.maximum(ratio - BOUND_Z * np.sqrt(1 / toxic + 1 / clean), 0).astype(np.float32)


class Table:
    """Hashes with a row each: evidence, then a vector. Most other hashes are told apart by a table of bits."""

    def __init__(self, hashes: np.ndarray, evidence: np.ndarray, vectors: np.ndarray):
        self.hashes, self.evidence, self.vectors = hashes, evidence.astype(np.float32), vectors.astype(np.float32)
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that have a row, and the rows' numbers."""
        some = np.flatnonzero(self.bits[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(some):
            return some, np.zeros(0, dtype=np.int64)
        found = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        same = self.hashes[found] == hashes[some]
        return some[same], found[same]

    @classmethod
    def learned(cls, documents: Callable[[], Iterator[tuple[int, np.ndarray]]], n_toxic: int, n_clean: int, rng: np.random.Generator) -> Table:
        """From (label, distinct hashes) of each document, read twice: counts of buckets first, then of the hashes in the buckets that can tell or are common."""
        shift = np.uint64(64 - BUCKET_BITS)
        counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.float32)
        for label, hashes in documents():
            counts[label][np.unique(hashes >> shift)] += 1
        least = max(2.0, COMMON * (n_toxic + n_clean))
        wanted = (_bounds(counts, n_toxic, n_clean) > 0) | (counts.sum(axis=0) >= least)
        every, exact = np.zeros(0, dtype=np.uint64), np.zeros((0, 2))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate((every, *(h for h, _ in held)))
            add = np.concatenate((exact, *(n for _, n in held)))
            out, at = np.unique(keys, return_inverse=True)
            return out, np.stack([np.bincount(at, add[:, k], len(out)) for k in (0, 1)], axis=1)

        size = 0
        for label, hashes in documents():
            hashes = hashes[wanted[hashes >> shift]]
            held.append((hashes, np.eye(2)[np.full(len(hashes), label)]))
            size += len(hashes)
            if size > 1_000_000:
                (every, exact), held, size = merged(), [], 0
        every, exact = merged()
        evidence = _bounds(exact.T, n_toxic, n_clean)
        keep = (evidence > 0) | (exact.sum(axis=1) >= least)
        vectors = 0.1 * rng.standard_normal((int(keep.sum()), VECTOR))
        return cls(every[keep], evidence[keep], vectors)


@dataclass
class Model:
    words: Table
    grams: Table
    weights: dict[str, np.ndarray]
    blank: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


@dataclass
class Words:
    """The distinct words of a run of texts: hashes, rows of their own in the words' table (-1: none), and (word, row) of their grams."""

    hashes: np.ndarray
    own: np.ndarray
    gram_word: np.ndarray
    gram_row: np.ndarray

    @classmethod
    def of(cls, model: Model, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
        hashes = span_hashes(part, starts, ends)
        own = np.full(len(hashes), -1)
        some, row = model.words.at(hashes)
        own[some] = row
        word, gram = _char_grams(part, starts, ends)
        some, row = model.grams.at(gram)
        return cls(hashes, own, word[some], row)

    def inputs(self, model: Model) -> np.ndarray:
        """(words, INPUTS): evidence of word and characters, vector of the word, mean vector of the characters."""
        n = len(self.hashes)
        x = np.zeros((n, INPUTS), dtype=np.float32)
        known = self.own >= 0
        x[known, 0] = model.words.evidence[self.own[known]]
        x[known, 2 : 2 + VECTOR] = model.words.vectors[self.own[known]]
        np.maximum.at(x[:, 1], self.gram_word, model.grams.evidence[self.gram_row])
        count = np.maximum(np.bincount(self.gram_word, minlength=n), 1)
        for k in range(VECTOR):
            x[:, 2 + VECTOR + k] = np.bincount(self.gram_word, model.grams.vectors[self.gram_row, k], n) / count
        return x


def _window_places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a run of texts: the text of each, its first word and the one past its last."""
    counts = np.diff(first)
    made = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), made)
    start = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made))
    return text, start, np.minimum(start + WINDOW, first[text + 1])


def _windows(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, Callable[[int, int], np.ndarray]]:
    """The windows of a run of texts that hold any known word: the text of each, and a way to get (windows, WINDOW, inputs) of some in turn."""
    text, start, end = _window_places(first)
    hits = np.concatenate(([0], np.cumsum(x.any(axis=1))))
    live = np.flatnonzero(hits[end] > hits[start])
    text, start, end = text[live], start[live], end[live]

    def some(a: int, b: int) -> np.ndarray:
        places = start[a:b, None] + np.arange(WINDOW)
        return x[np.minimum(places, max(len(x) - 1, 0))] * (places < end[a:b, None])[:, :, None]

    return text, some


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {}
    for way in ("f", "b"):
        out |= {f"w{way}": scale(INPUTS, 3 * HIDDEN), f"u{way}": scale(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, dtype=np.float32)}
    return out | {"wa": scale(2 * HIDDEN, POOLED), "ca": np.zeros(POOLED, dtype=np.float32), "va": scale(POOLED, 1)[:, 0], "wo": scale(2 * HIDDEN, 1)[:, 0], "co": np.zeros(1, dtype=np.float32)}


def _run(weights: dict, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of one direction."""
    n, steps, _ = x.shape
    h, out, kept = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((steps, n, HIDDEN), dtype=np.float32), []
    u = weights[f"u{way}"]
    every = np.ascontiguousarray((x @ weights[f"w{way}"] + weights[f"c{way}"]).transpose(1, 0, 2))
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        a, b = every[t], h @ u
        gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        m = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        new = (1 - z) * m + z * h
        if keep:
            kept.append((t, h, z, r, m, b[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out, kept


def forward(weights: dict, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows (batch, time, 2)."""
    ahead, kept_f = _run(weights, x, "f", keep)
    behind, kept_b = _run(weights, x, "b", keep)
    states = np.concatenate((ahead, behind), axis=2)
    inner = np.tanh(states @ weights["wa"] + weights["ca"])
    score = inner @ weights["va"]
    share = np.exp(score - score.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[:, :, None] * states).sum(axis=0)
    return pooled @ weights["wo"] + weights["co"][0], (states, inner, share, pooled, kept_f, kept_b)


def gradients(weights: dict, x: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for the slope of the loss by each window's logit (back through time); x: of the inputs."""
    _, (states, inner, share, pooled, kept_f, kept_b) = forward(weights, x, True)
    out = {"wo": pooled.T @ slope, "co": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * weights["wo"]
    d_states = share[:, :, None] * d_pooled
    d_share = (states * d_pooled).sum(axis=2)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    out["va"] = np.einsum("tn,tnp->p", d_score, inner)
    d_inner = d_score[:, :, None] * weights["va"] * (1 - inner * inner)
    out["wa"], out["ca"] = np.einsum("tnh,tnp->hp", states, d_inner), d_inner.sum(axis=(0, 1))
    d_states = d_states + d_inner @ weights["wa"].T
    out["x"] = d_x = np.zeros_like(x)
    for way, kept, part in (("f", kept_f, d_states[:, :, :HIDDEN]), ("b", kept_b, d_states[:, :, HIDDEN:])):
        w, u = weights[f"w{way}"], weights[f"u{way}"]
        d_w, d_u, d_c = (np.zeros_like(weights[f"{k}{way}"]) for k in "wuc")
        d_h = np.zeros((len(x), HIDDEN), dtype=np.float32)
        for t, before, z, r, m, b in reversed(kept):
            d_h = d_h + part[t]
            d_m = d_h * (1 - z) * (1 - m * m)
            d_z = d_h * (before - m) * z * (1 - z)
            d_r = d_m * b * r * (1 - r)
            d_a = np.concatenate((d_z, d_r, d_m), axis=1)
            d_b = np.concatenate((d_z, d_r, d_m * r), axis=1)
            d_w += x[:, t].T @ d_a
            d_u += before.T @ d_b
            d_c += d_a.sum(axis=0)
            d_x[:, t] += d_a @ w.T
            d_h = d_h * z + d_b @ u.T
        out |= {f"w{way}": d_w, f"u{way}": d_u, f"c{way}": d_c}
    return out


def _logits(model: Model, texts: pa.Array) -> np.ndarray:
    """The largest window logit of each text."""
    out = np.full(len(texts), model.blank)
    data, offsets = utf8_column(texts)
    for start, _, part, inner in chunks(data, offsets):
        part, starts, ends, which, first = _words(part, inner)
        if not len(starts):
            continue
        text, some = _windows(Words.of(model, part, starts, ends).inputs(model)[which], first)
        for at in range(0, len(text), 1024):
            logit, _ = forward(model.weights, some(at, at + 1024))
            np.maximum.at(out, start + text[at : at + 1024], logit)
    return out


def _own_texts(column: pa.Array) -> np.ndarray:
    """Places of the texts none of whose 4 least shingle hashes an earlier text has among its own."""
    seen: set[int] = set()
    keep = []
    data, offsets = utf8_column(column)
    for start, _, part, inner in chunks(data, offsets):
        values, begin = shingle_hashes(*words_of(part, inner))
        for i, own in enumerate(distinct_sorted(values, begin)):
            least = set(own[:4].tolist())
            if not least & seen:
                keep.append(start + i)
            seen |= least
    return np.array(keep, dtype=np.int64)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5, share: float | None = None) -> Model | None:
    """A model from labelled texts; None without both labels. share: of toxic rows in the table they come from (without it, in the texts)."""
    if share is None and len(labels):
        share = float(labels.mean())
    column = pa.array(texts, pa.string())
    kept = _own_texts(column)
    column, labels = column.take(pa.array(kept)), labels[kept]
    n_toxic = int(labels.sum())
    n_clean = len(labels) - n_toxic
    if not n_toxic or not n_clean:
        return None
    data, offsets = utf8_column(column)

    def documents(grams: bool) -> Iterator[tuple[int, np.ndarray]]:
        for start, end, part, inner in chunks(data, offsets):
            part, starts, ends, which, first = _words(part, inner)
            if not len(starts):
                continue
            if grams:
                word, hashes = _char_grams(part, starts, ends)
                by = np.argsort(word, kind="stable")
                hashes, edge = hashes[by], np.searchsorted(word[by], np.arange(len(starts) + 1))
            else:
                hashes, edge = span_hashes(part, starts, ends), np.arange(len(starts) + 1)
            for i in range(end - start):
                used = np.unique(which[first[i] : first[i + 1]])
                if len(used):
                    yield int(labels[start + i]), np.unique(np.concatenate([hashes[edge[w] : edge[w + 1]] for w in used]))

    rng = np.random.default_rng(seed)
    words, grams = (Table.learned(lambda k=k: documents(k), n_toxic, n_clean, rng) for k in (False, True))
    model = Model(words, grams, _initial(rng))
    good, bad, known = _lessons(model, data, offsets, labels, rng)
    if not len(bad):
        return None
    learned = _Trained(model, known)
    for step in range(1, STEPS + 1):
        half = BATCH // 2
        blank = np.zeros((16, WINDOW), dtype=np.int64)
        ids = np.concatenate((good[rng.integers(0, len(good), half - 16)], blank, bad[rng.integers(0, len(bad), half)]))
        learned.step(ids, np.repeat((0.0, 1.0), half), step)
    model.blank = float(forward(model.weights, np.zeros((1, WINDOW, INPUTS), dtype=np.float32))[0][0])
    model.slope, model.offset = _calibrated(_logits(model, column), labels, share)
    return model


def _lessons(model: Model, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, Words]:
    """(clean windows, toxic windows) as numbers of words (0: none), and the words; of each toxic document the window with most evidence,
    of each clean one that and others at random."""
    chosen: tuple[list, list] = ([np.zeros((1, WINDOW), dtype=np.uint64)], [np.zeros((0, WINDOW), dtype=np.uint64)])
    met: list[Words] = []
    for begin, _, part, inner in chunks(data, offsets):
        part, starts, ends, which, first = _words(part, inner)
        if not len(starts):
            continue
        own = Words.of(model, part, starts, ends)
        evidence = own.inputs(model)[which, :2].sum(axis=1)
        text, start, end = _window_places(first)
        for i in np.unique(text):
            some = np.flatnonzero(text == i)
            strength = np.array([evidence[start[w] : end[w]].max(initial=0) for w in some])
            most = some[strength.argmax()]
            toxic = int(labels[begin + i])
            if toxic and not strength.any():
                continue
            take = [most] if toxic else np.unique(np.append(rng.choice(some, min(len(some), CLEAN_WINDOWS - 1), replace=False), most))
            for w in take:
                row = np.zeros(WINDOW, dtype=np.uint64)
                row[: end[w] - start[w]] = own.hashes[which[start[w] : end[w]]]
                chosen[toxic].append(row[None])
        met.append(own)
    good, bad = np.concatenate(chosen[0]), np.concatenate(chosen[1])
    vocabulary = np.unique(np.concatenate((np.zeros(1, dtype=np.uint64), good.ravel(), bad.ravel())))
    own, word, row, seen = np.full(len(vocabulary), -1), [], [], np.zeros(len(vocabulary), dtype=bool)
    for part in met:
        at = np.minimum(np.searchsorted(vocabulary, part.hashes), len(vocabulary) - 1)
        new = (vocabulary[at] == part.hashes) & ~seen[at]
        own[at[new]] = part.own[new]
        mine = new[part.gram_word]
        word.append(at[part.gram_word[mine]])
        row.append(part.gram_row[mine])
        seen[at[new]] = True
    word, row = np.concatenate((np.zeros(0, dtype=np.int64), *word)), np.concatenate((np.zeros(0, dtype=np.int64), *row))
    by = np.argsort(word, kind="stable")
    return np.searchsorted(vocabulary, good), np.searchsorted(vocabulary, bad), Words(vocabulary, own, word[by], row[by])


class _Trained:
    """Gradient steps (with moments) on the network's weights and on the vectors of words and grams."""

    def __init__(self, model: Model, known: Words) -> None:
        self.model, self.known = model, known
        self.begin = np.searchsorted(known.gram_word, np.arange(len(known.hashes) + 1))
        self.free = {k: (np.abs(t.vectors).sum(axis=1) > 0)[:, None] for k, t in (("words", model.words), ("grams", model.grams))}
        parts = model.weights | {"words": model.words.vectors, "grams": model.grams.vectors}
        self.moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in parts.items()}

    def _moved(self, k: str, value: np.ndarray, slope: np.ndarray, step: int) -> np.ndarray:
        m, v = self.moments[k]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        return (value - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def step(self, ids: np.ndarray, y: np.ndarray, step: int) -> None:
        model, known = self.model, self.known
        used, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        count = (self.begin[used + 1] - self.begin[used])
        places = np.repeat(self.begin[used] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        some = Words(known.hashes[used], known.own[used], np.repeat(np.arange(len(used)), count), known.gram_row[places])
        x = some.inputs(model)[at]
        logit, _ = forward(model.weights, x)
        slopes = gradients(model.weights, x, ((_sigmoid(logit) - y) / BATCH).astype(np.float32))
        flat = slopes.pop("x").reshape(-1, INPUTS)
        by_word = np.stack([np.bincount(at.ravel(), flat[:, k], len(used)) for k in range(2, INPUTS)], axis=1)
        own = some.own >= 0
        d_words, d_grams = np.zeros_like(model.words.vectors), np.zeros_like(model.grams.vectors)
        np.add.at(d_words, some.own[own], by_word[own, :VECTOR].astype(np.float32))
        shared_out = (by_word[:, VECTOR:] / np.maximum(count, 1)[:, None])[some.gram_word]
        for k in range(VECTOR):
            d_grams[:, k] = np.bincount(some.gram_row, shared_out[:, k], len(d_grams))
        for k, g in slopes.items():
            model.weights[k] = self._moved(k, model.weights[k], g, step)
        for name, table, slope in (("words", model.words, d_words), ("grams", model.grams, d_grams)):
            moved = self._moved(name, table.vectors, slope, step)
            table.vectors = np.where(self.free[name], moved * np.float32(1 - DECAY), 0).astype(np.float32)


def _calibrated(logit: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the documents' largest logits, toxic ones weighing `share` of all.

    A weak pull to slope 1 keeps the curve finite where the labels part fully; steps that do not lower the loss are halved.
    """
    weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())
    centre = float((weight * logit).sum())
    x = logit - centre

    def loss(ab: np.ndarray) -> float:
        v = ab[0] * x + ab[1]
        return float((weight * (np.logaddexp(0, v) - labels * v)).sum() + 0.005 * ((ab[0] - 1) ** 2 + ab[1] ** 2))

    ab = np.array([1.0, 0.0])
    for _ in range(40):
        p = _sigmoid(ab[0] * x + ab[1])
        miss, curve = weight * (p - labels), weight * p * (1 - p)
        slope = np.array([(miss * x).sum() + 0.01 * (ab[0] - 1), miss.sum() + 0.01 * ab[1]])
        bend = np.array([[(curve * x * x).sum() + 0.01, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 0.01]])
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
    return float(max(ab[0], 1e-3)), float(ab[1] - max(ab[0], 1e-3) * centre)


def _known(labels: DataFrame) -> DataFrame:
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def toxic_share(docs: DataFrame, labels: DataFrame) -> float | None:
    """The share of toxic rows among all labelled rows that are not held out; None if there are none."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id")).join(_known(labels), "doc_id").agg(F.avg("toxic").alias("share")).first()["share"]


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most so many rows of either label, by hash order, none of them held out."""
    known = _known(labels)
    order = F.xxhash64(F.lit(17), "doc_id")
    chosen = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most toxic + clean rows
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), shared.text_column(docs).alias("text")).join(chosen, "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # Copies of a text count once; by hash order, as many rows and texts as the bounds let in.
    places = own.groupBy("doc_id", "toxic", F.xxhash64("text").alias("k")).agg(F.max(size).alias("size")).orderBy(F.xxhash64(F.lit(18), "doc_id", "k"), "doc_id", "k").limit(toxic + clean)
    taken, held = [], 0
    for r in places.toLocalIterator():
        if held + r["size"] <= FIT_BYTES:
            held += r["size"]
            taken.append((r["doc_id"], r["k"]))
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, k long")) if taken else None
    if few is None:
        return [], np.zeros(0, dtype=np.int64)
    rows = own.withColumn("k", F.xxhash64("text")).join(few, ["doc_id", "k"]).dropDuplicates(["doc_id", "k"]).select("text", "toxic").toPandas()
    rows = rows.sort_values(["toxic", "text"], na_position="first")
    return [t or "" for t in rows["text"]], rows["toxic"].to_numpy(dtype=np.int64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared.bound_batches(docs.sparkSession)
    own_model = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand hashes, two tables of 1 MB and small weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = own_model.value
        for batch in batches:
            p = np.zeros(batch.num_rows)
            if fitted is not None:
                p = _sigmoid(fitted.slope * _logits(fitted, batch.column("text")) + fitted.offset)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), shared.text_column(docs).alias("text"))
    return rows.mapInArrow(shared.trimmed(work), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(*labelled_sample(docs, labels), share=toxic_share(docs, labels)))
