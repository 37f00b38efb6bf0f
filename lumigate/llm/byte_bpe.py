"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The transducer reads bytes and emits tokens. A state holds, for the bytes not yet emitted, the
last token of the encoding of each prefix that still matters and the vocabulary prefixes that
are open there; a token leaves as soon as every open continuation has it in common, so the
lookahead is bounded by the longest token. States and transitions come into being when first
met. They are kept from task to task of a worker, until it does other work, up to MOST_STATES, within a piece too: then
a new generation begins with the present state, which takes over from the last one what is met again; what is not met
until the next begins is forgotten. Pieces and pairs of tokens are kept in two generations too, so that the frequent ones stay.

That the last token of each prefix decides the rest rests on one property of BPE: a sequence of
tokens is the encoding of its bytes if and only if each neighbouring pair is the encoding of
its own bytes.

Defined cases: a null text is an empty one, of no tokens; a null doc_id stays null; a text or piece of any length
goes through with the same bounds; repeated rows get equal results; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import shared

CACHE_PIECES = 125_000  # of a generation, of about 230 bytes each
LONG_PIECE = 64  # letters from which a piece is not kept
MOST_STATES = 225_000  # of a generation, of about 450 bytes each with their transitions
MOST_FITS = 262_139  # places for pairs of tokens, of 8 bytes each; a later pair takes the place of an earlier one
KEPT_AS = "byte-level BPE"  # what workers keep it as
NEVER_ASKED, NO_LINK = -2, (-1, -1)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes in, token ids out. `encode` takes one piece of the pre-splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks, self.share = ranks, share
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for word, token in ranks.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            self.token_at[node] = token
        #: In the place that a pair's number gives: left << 25 | right << 1 | whether they fit. No pair is -1.
        self.fits = array("q", [-1]) * MOST_FITS
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.orderly: dict[int, bool] = {}
        self.states, self.number, self.moves, self.many = [], {}, {}, []
        self._forget()

    def _forget(self, but: int = 0) -> int:
        """A new generation of states, of the first and one, and that one's new number; the last one stays beside it, its last is forgotten."""
        kept = self.states[but] if but else b""
        self.before = self.states, self.number, self.moves, self.many
        #: Of each state, as packed whole numbers: the token before the unsent bytes, their count, the number of open
        #: starts, then (place before, token) of the last token of each prefix and (start, trie node) of each open start.
        first = array("i", (-1, 0, 0)).tobytes()
        self.states: list[bytes] = [first]
        self.number: dict[bytes, int] = {first: 0}
        #: state << 8 | byte -> next state | (token + 1) << 32; below 0 the place in `many` of (next state, tokens).
        self.moves: dict[int, int] = {}
        self.many: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        if kept:
            self.number[kept] = len(self.states)
            self.states.append(kept)
        return len(self.states) - 1

    def _merge(self, word: bytes, to: int = 1) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own bytes joins; None for a byte, and for what merging never makes."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts = self._merge(self.bytes_of[token], 2)
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.halves[token] = found
        return found

    def _orderly(self, token: int) -> bool:
        """Whether the merges that make a token come in the order of their ranks, so that its rank is the time at which it is made."""
        found = self.orderly.get(token)
        if found is None:
            halves = self._halves(token)
            found = len(self.bytes_of[token]) == 1 or (halves is not None and max(halves) < token and all(map(self._orderly, halves)))
            self.orderly[token] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes; left -1: whether right alone is that of its own.

        Going back in time, the later of the two tokens at the border is taken apart. Two that lie there at the same
        time must not have a merge of their own before one of them goes into a larger token; of equal ranks the left comes
        first. Where ranks do not tell times, the bytes are merged outright.
        """
        if left < 0:
            return len(self.bytes_of[right]) == 1 or self._halves(right) is not None
        bytes_of, ranks = self.bytes_of, self.ranks
        a, b, before = bytes_of[left], bytes_of[right], 1 << 60
        if not (self._orderly(left) and self._orderly(right)):
            return self._merge(a + b, 2) == [a, b] and a + b not in ranks
        while True:
            own = ranks.get(bytes_of[left] + bytes_of[right])
            if own is not None:
                if own < max(left, right):
                    return self._merge(a + b, 2) == [a, b] and a + b not in ranks
                if own < before:
                    return False
            if left > right and (halves := self._halves(left)):
                before, left = left, halves[1]
            elif halves := self._halves(right):
                before, right = right + 1, halves[0]
            elif halves := self._halves(left):
                before, left = left, halves[1]
            else:
                return True

    def _keep(self, state: int, byte: int, packed: bytes, sent: tuple[int, ...]) -> int:
        """The move from a state, kept: to the state of that content, with the tokens that leave."""
        to = self.number.setdefault(packed, len(self.states))
        if to == len(self.states):
            self.states.append(packed)
        if len(sent) > 1:
            move = -len(self.many)
            self.many.append((to, sent))
        else:
            move = to | (sent[0] + 1 << 32 if sent else 0)
        self.moves[state << 8 | byte] = move
        return move

    def _move(self, state: int, byte: int) -> int:
        states, number, moves, many = self.before
        if (own := number.get(self.states[state])) is not None and (move := moves.get(own << 8 | byte)) is not None:
            to, sent = many[-move] if move < 0 else (move & 0xFFFFFFFF, ((move >> 32) - 1,) if move >> 32 else ())
            return self._keep(state, byte, states[to], sent)
        flat = memoryview(self.states[state]).cast("i").tolist()
        before, at = flat[0], flat[1]
        child, token_at, inner, fits, places = self.child, self.token_at, self.inner, self.fits, len(self.fits)
        still, found, last = [], False, 0
        flat += (at, 0)
        for i in range(3 + 2 * at, len(flat), 2):
            node = child.get(flat[i + 1] << 8 | byte)
            if node is None:
                continue
            start = flat[i]
            if inner[node]:
                still.append((start, node))
            if not found and (token := token_at[node]) >= 0:
                left = flat[2 + 2 * start] if start else before
                key = left << 24 | token
                seen = fits[key % places]
                if seen >> 1 != key:
                    seen = fits[key % places] = key << 1 | self._fit(left, token)
                if seen & 1:
                    found, last = True, (start, token)
        if not found:
            raise ValueError("the vocabulary lacks a byte")
        # The link of place q, (place before, token), stands at 1 + 2 q and the next.
        flat[3 + 2 * at : 5 + 2 * at] = last
        at += 1
        # What every open start and the end have in common can leave; walking back from the highest
        # of the ends that are left keeps them all above the common place.
        ends = bytearray(at + 1)
        ends[at] = left_over = 1
        for start, _ in still:
            if not ends[start]:
                ends[start] = 1
                left_over += 1
        q = at
        while left_over > 1:
            if ends[q]:
                ends[q] = 2
                back = flat[1 + 2 * q]
                if ends[back]:
                    left_over -= 1
                else:
                    ends[back] = 1
            q -= 1
        while ends[q] != 1:
            q -= 1
        common, sent, p = q, [], q
        while p:
            sent.append(flat[2 + 2 * p])
            p = flat[1 + 2 * p]
        if common != at and not any(start == common for start, _ in still):
            before = NEVER_ASKED
        elif sent:
            before = sent[0]
        new = [before, at - common, len(still)]
        for q in range(common + 1, at + 1):
            new += (flat[1 + 2 * q] - common, flat[2 + 2 * q]) if ends[q] == 2 else NO_LINK
        for start, node in still:
            new += (start - common, node)
        return self._keep(state, byte, array("i", new).tobytes(), tuple(sent[::-1]))

    def _end(self, state: int) -> tuple[int, ...]:
        flat = memoryview(self.states[state]).cast("i").tolist()
        at, left = flat[1], []
        while at:
            left.append(flat[2 + 2 * at])
            at = flat[1 + 2 * at]
        return tuple(left[::-1])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        moves, state, out = self.moves, 0, []
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) >= MOST_STATES * self.share:
                    state = self._forget(state)
                    moves = self.moves
                move = self._move(state, byte)
            if move < 0:
                state, sent = self.many[-move]
                out += sent
            else:
                state = move & 0xFFFFFFFF
                if token := move >> 32:
                    out.append(token - 1)
        return (*out, *self._end(state))


class Utf8Stream:
    """Text from byte pieces cut anywhere: whole characters leave at once, an open one waits."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _tail(data: bytes) -> int:
        """How many bytes at the end begin a character that is not yet whole."""
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if need > back else 0
        return 0

    def push(self, data: bytes) -> str:
        data = self.open + data
        wait = self._tail(data)
        self.open = data[len(data) - wait :] if wait else b""
        return data[: len(data) - wait].decode("utf-8", errors="replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", errors="replace")


class Codec:
    """A vocabulary with its pattern; keeps the ids of pieces already met, as decimal numbers joined by a space."""

    kept: dict[tuple[str, str, float], Codec] = {}

    def __init__(self, ranks_path: str, pattern: str, share: float = 1.0):
        self.share = share
        self.transducer = Transducer(read_ranks(ranks_path), share)
        self.split = regex.compile(pattern).findall
        self.bytes_of = self.transducer.bytes_of
        self.bytes_named = {str(i): b for i, b in self.bytes_of.items()}
        self.pieces: dict[str, str] = {}
        self.pieces_before: dict[str, str] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str, share: float = 1.0) -> Codec:
        if (key := (ranks_path, pattern, share)) not in cls.kept:
            cls.kept[key] = cls(*key)
            shared.keeps(KEPT_AS, cls.kept.clear)
        return cls.kept[key]

    def _new(self, piece: str) -> str:
        numbers = self.pieces_before.get(piece) or " ".join(map(str, self.transducer.encode(piece.encode())))
        if len(piece) <= LONG_PIECE:
            if len(self.pieces) >= CACHE_PIECES * self.share:
                self.pieces_before, self.pieces = self.pieces, {}
            self.pieces[piece] = numbers
        return numbers

    def numbers(self, text: str) -> str:
        """The ids as decimal numbers joined by a space."""
        new = self._new
        return " ".join([self.pieces.get(p) or new(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.numbers(text).split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_numbers(self, numbers: str) -> Iterator[str]:
        """The text of ids written as decimal numbers, run by run."""
        stream, named = Utf8Stream(), numbers.split()
        for at in range(0, len(named), 4096):
            yield stream.push(b"".join(map(self.bytes_named.__getitem__, named[at : at + 4096])))
        yield stream.close()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        stream = Utf8Stream()
        for i in ids:
            if text := stream.push(self.bytes_of[i]):
                yield text
        if text := stream.close():
            yield text


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    shared.bound_batches(docs.sparkSession, 4 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), shared.text_column(docs).alias("text")).mapInArrow(shared.trimmed(work, KEPT_AS), "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids, by the incremental UTF-8 decoder."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            texts = ["".join(codec.decode_stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(shared.trimmed(work, KEPT_AS), "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, share: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded again, as digests.

    share: of the states and pieces that a worker may keep, for jobs whose other stages leave it less memory; it changes no result.
    """
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    shared.bound_batches(docs.sparkSession, 4 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern, share)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(1).slice(at, 64).to_pylist():
                    numbers = codec.numbers(text or "")
                    counts.append(numbers.count(" ") + bool(numbers))
                    id_digests.append(hashlib.sha256(numbers.encode()).hexdigest())
                    digest = hashlib.sha256()
                    for run in codec.decode_numbers(numbers):
                        digest.update(run.encode())
                    text_digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), shared.text_column(docs).alias("text"))
    return rows.mapInArrow(shared.trimmed(work, KEPT_AS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
