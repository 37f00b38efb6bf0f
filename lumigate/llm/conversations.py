"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then user-assistant pairs.

A conversation is read as a string of codes, one byte a row (role and fault). State-cost vectors run
backward over it: what the rest costs from each of four states (nothing yet, after system, after user, after
assistant). Only the vectors at checkpoints, about the square root of the rows apart, are kept; the walk forward
recomputes one block of vectors at a time and takes, of the edits that are tight, the letter least in ASCII.
As a letter decides the state it leads to, that is the least of all cheapest audits.

At scale: digests of rows, not texts, are dealt by ranges of (conversation, turn), so that a conversation with a
third of all rows is many tasks; each packs runs of codes, and only these bytes meet by conversation, where the audit
(a letter a row, which the result holds anyway) is made. Rows alike in conversation, turn, role and text are
counted before anything is sorted. Texts then stream once, in order, past their audit: nothing but a batch of
them is held at a time. The digest of a repaired conversation is one running hash, so this last stream is one task a conversation.

Defined cases: a null role or text is one blank; a null conv_id is a conversation of its own; null turns come first;
rows of one turn stand in the order of a hash of role and text, copies next to each other; a role whose first letter
is not s, u or a (an empty one too) can only be changed or deleted; texts of any length are read whole; a conversation without rows has an
empty audit; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BLANKS = " \t\n\x0b\f\r"
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
PACK = 1 << 16  # codes in a packed run
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # states; the last three are also role codes less one
OTHER = 3
#: The state an inserted or changed row leads to: user everywhere but after user.
PUT = (USER, USER, ASSISTANT, USER)
#: (state, role code) -> state, for rows kept as they are; absent where the row may not stand there.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
NAMES = {USER: "user", ASSISTANT: "assistant"}


class Costs:
    """State-cost vectors, each less its minimum, numbered as they are met, with their moves by code."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.walks: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._own(self._inserted([0, 1 << 20, 1 << 20, 0]))[0]

    def _own(self, vector: list[int]) -> tuple[int, int]:
        least = min(vector)
        key = tuple(w - least for w in vector)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], least

    @staticmethod
    def _inserted(vector: list[int]) -> list[int]:
        for _ in range(2):  # no cheapest audit inserts more than two rows in one place
            vector = [min(w, INSERT + vector[PUT[s]]) for s, w in enumerate(vector)]
        return vector

    @staticmethod
    def _edits(code: int, after: tuple[int, ...], s: int) -> Iterator[tuple[int, str, int]]:
        """(cost with what follows, letter, next state) of the edits of one row in state s, in the order of letters."""
        role, fault = code & 3, code >> 2
        yield DELETE + after[s], "D", s
        if fault not in (BLANK, DUPLICATE):
            own = CUT_OFF if fault == TRUNCATED else 0
            if (s, role) in KEPT:
                yield own + after[KEPT[s, role]], "K", KEPT[s, role]
            yield REROLE + own + after[PUT[s]], "R", PUT[s]

    def _before(self, after: tuple[int, ...], code: int) -> list[int]:
        return self._inserted([min(cost for cost, _, _ in self._edits(code, after, s)) for s in range(4)])

    def back(self, number: int, code: int) -> tuple[int, int]:
        """The number of the vector before a row from that after it, and what is added to all its costs."""
        key = number << 4 | code
        found = self.moves.get(key)
        if found is None:
            found = self.moves[key] = self._own(self._before(self.vectors[number], code))
        return found

    def walk(self, number: int, code: int, s: int) -> tuple[str, int]:
        """The least tight letters of a row (inserted rows before it too) in state s, and the next state; number: the vector after it."""
        key = number, code, s
        found = self.walks.get(key)
        if found is None:
            after = self.vectors[number]
            before, letters = self._before(after, code), ""
            while True:
                tight = [(letter, to) for cost, letter, to in self._edits(code, after, s) if cost == before[s]]
                if INSERT + before[PUT[s]] == before[s]:
                    tight.append(("I", PUT[s]))
                letter, s = min(tight)
                letters += letter
                if letter != "I":
                    break
            found = self.walks[key] = letters, s
        return found

    def finish(self, s: int) -> str:
        """The rows inserted after the last one."""
        letters, left = "", self.vectors[self.end]
        while left[s]:
            letters, s = letters + "I", PUT[s]
        return letters


COSTS = Costs()  # a table of the automaton: it does not grow with the data


def cheapest(codes: bytes, costs: Costs = COSTS) -> tuple[int, str]:
    """(cost, audit) of a conversation's codes; vectors are kept at checkpoints only, and recomputed block by block."""
    n = len(codes)
    block = math.isqrt(n) + 1
    checkpoints, now, total = [], costs.end, 0
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 or i == n - 1:
            checkpoints.append(now)
        now, more = costs.back(now, codes[i])
        total += more
    total += costs.vectors[now][START]
    s, audit = START, []
    for start in range(0, n, block):
        own = codes[start : start + block]
        after = [checkpoints.pop()]
        for code in reversed(own[1:]):
            after.append(costs.back(after[-1], code)[0])
        for code, number in zip(own, reversed(after)):
            letters, s = costs.walk(number, code, s)
            audit.append(letters)
    audit.append(costs.finish(s))
    return total, "".join(audit)


def illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


# --- rows ---------------------------------------------------------------------------------------------


def _plain(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, n (how often the row stands there), with blanks for nulls."""
    c = conversations
    blank = F.lit(" ")
    return c.select(
        c["conv_id"].alias("conv"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), blank).alias("role"),
        F.coalesce(c["text"].cast("string"), blank).alias("text"), F.lit(1).alias("n"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by the crc32 of `conv_id:turn` mod 20, as conv, turn, role, text, n.

    0 drops a row (it stays with n = 0, so that its conversation is known), 1 empties its text, 2 removes its . ! and ?,
    3 repeats it next to itself, 4 sets its role to user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return _plain(conversations).select("conv", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def _digest() -> Column:
    """A hash of role and text; rows of one turn are sorted by it."""
    return F.when(F.col("n") > 0, F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))))


def _turn() -> Column:
    return F.when(F.col("n") > 0, F.col("turn"))


def _codes(rows: DataFrame, steps: shared.Steps) -> DataFrame:
    """conv, turn, h, n, first (the fault and role of the first of n copies), rest (of the others)."""
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    one = rows.select("conv", _turn().alias("turn"), _digest().alias("h"), "n", role.alias("role"), fault.alias("fault"))
    one = steps.write(one.groupBy("conv", "turn", "h").agg(F.sum("n").cast("long").alias("n"), F.first("role").alias("role"), F.first("fault").alias("fault")), "digests")
    turn = F.struct("turn")
    several = one.filter("n > 0").groupBy("conv", "h").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first <> last")
    several = steps.write(several.select(F.col("conv").alias("dc"), F.col("h").alias("dh"), F.col("first.turn").alias("first_turn")), "several")
    met = one.join(shared.broadcast_if_small(several), one["conv"].eqNullSafe(F.col("dc")) & (one["h"] == F.col("dh")), "left")
    again = F.col("dh").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    code = F.col("role") + 4 * F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    rest = F.col("role") + 4 * F.when(F.col("fault") != BLANK, DUPLICATE).otherwise(F.col("fault"))
    return steps.write(met.select("conv", "turn", "h", "n", code.alias("code"), rest.alias("rest")), "codes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches as tuples."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 4096, most_letters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= most_rows or letters >= most_letters:
            yield _out(held, schema)
            held, letters = [], 0
    if held:
        yield _out(held, schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, turn, h, seq, codes, first turn, last turn, distinct turns) of runs of sorted rows of one conversation.

    A run is named by the row it begins with; seq counts the runs that begin within the copies of that row.
    """
    conv = start = None
    codes, low, high, turns = bytearray(), None, None, 0
    for key, turn, h, n, code, rest in _runs(batches):
        if start is not None and (key != conv or len(codes) >= PACK):
            yield conv, *start, bytes(codes), low, high, turns
            start = None
        if start is None:
            conv, start, codes, low, high, turns = key, (turn, h, 0), bytearray(), None, None, 0
        if n:
            codes.append(code)
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            left = n - 1
            while left:
                if len(codes) >= PACK:
                    yield conv, *start, bytes(codes), low, high, turns
                    seq = start[2] if start[:2] == (turn, h) else 0
                    start, codes, low, high, turns = (turn, h, seq + 1), bytearray(), turn, turn, int(turn is not None)
                some = min(left, PACK - len(codes))
                codes += bytes([rest]) * some
                left -= some
    if start is not None:
        yield conv, *start, bytes(codes), low, high, turns


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    conv, codes, low, high, turns, begun = None, bytearray(), None, None, 0, False

    def done() -> tuple:
        own = bytes(codes)
        faults = [sum(own.count(role + 4 * fault) for role in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        gaps = high - low + 1 - turns if turns else 0
        cost, audit = cheapest(own)
        return conv, gaps, *faults, illegal(own), cost, audit

    for key, _, _, _, more, first, last, n in _runs(batches):
        if begun and key != conv:
            yield done()
            codes, low, high, turns = bytearray(), None, None, 0
        conv, begun = key, True
        codes += more
        if n:
            turns += n - (high is not None and first == high)
            low, high = first if low is None else low, last
    if begun:
        yield done()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _reports(rows: DataFrame, steps: shared.Steps) -> DataFrame:
    kind = rows.schema["conv"].dataType
    packed = T.StructType().add("conv", kind).add("turn", "long").add("h", "binary").add("seq", "long").add("codes", "binary").add("low", "long").add("high", "long").add("turns", "long")
    out = T.StructType().add("conv", kind)
    for name in REPORT:
        out = out.add(name, "long")
    out = out.add("audit", "string")
    pack_arrow, out_arrow = _arrow(packed), _arrow(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_pack(batches), pack_arrow)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_audit(batches), out_arrow)

    codes = _codes(rows, steps)
    runs = codes.repartitionByRange("conv", "turn", "h").sortWithinPartitions("conv", "turn", "h").mapInArrow(shared.trimmed(pack), packed)
    return runs.repartition("conv").sortWithinPartitions("conv", "turn", "h", "seq").mapInArrow(shared.trimmed(audit), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def reports(rows: DataFrame) -> DataFrame:
    """Per conversation of conv, turn, role, text, n: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    with shared.Steps(rows.sparkSession) as steps:
        return steps.write(_reports(rows, steps), "audits", keep=True)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per conversation its report, then its repaired rows (place, edit, role, text): (report, None), (None, row) in order."""
    audit, at, s, place = "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, s, place
        while at < len(audit) and audit[at] == "I":
            at, s = at + 1, PUT[s]
            yield None, (place, "I", NAMES[s], "")
            place += 1

    for conv, header, _, _, role, text, n, report in _runs(batches):
        if header == 0:
            yield from inserted()
            yield (conv, report), None
            audit, at, s, place = report["audit"], 0, START, 0
            continue
        for _ in range(n):
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                s = PUT[s]
                role = NAMES[s]
            else:
                s = KEPT[s, "sua".index(role[:1])]
            yield None, (place, letter, role, text)
            place += 1
    yield from inserted()


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows behind their conversation's report, in order; a conversation's are next to each other in one partition."""
    report = F.struct(*REPORT, "audit").alias("report")
    heads = found.select("conv", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), report)
    own = rows.filter("n > 0").select("conv", F.lit(1).alias("head"), "turn", _digest().alias("h"), "role", "text", "n", F.lit(None).cast(heads.schema["report"].dataType).alias("report"))
    return heads.unionByName(own).repartition("conv").sortWithinPartitions("conv", "head", "turn", "h")


def repair(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text. rows: conv, turn, role, text, n, as `damaged` or `plain` give."""
    found = reports(rows) if found is None else found
    out = T.StructType().add("conv_id", rows.schema["conv"].dataType).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")
    arrow = _arrow(out)
    shared.bound_batches(rows.sparkSession, 4 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            conv = None
            for head, row in _walked(batches):
                if row is None:
                    conv = head[0]
                else:
                    yield conv, *row

        yield from _batched(each(), arrow)

    return _stream(rows, found).mapInArrow(shared.trimmed(work), out)


def repaired_digests(rows: DataFrame) -> DataFrame:
    """Per conversation its report and repaired_sha256: of its repaired `role:text`, joined by newlines."""
    found = reports(rows)
    out = T.StructType().add("conv_id", rows.schema["conv"].dataType)
    for name in REPORT:
        out = out.add(name, "long")
    out = out.add("audit", "string").add("repaired_sha256", "string")
    arrow = _arrow(out)
    shared.bound_batches(rows.sparkSession, 4 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            now = digest = None
            for head, row in _walked(batches):
                if row is None:
                    if now is not None:
                        yield now[0], *now[1].values(), digest.hexdigest()
                    now, digest = head, hashlib.sha256()
                else:
                    place, _, role, text = row
                    digest.update((("\n" if place else "") + role + ":" + text).encode())
            if now is not None:
                yield now[0], *now[1].values(), digest.hexdigest()

        yield from _batched(each(), arrow)

    return _stream(rows, found).mapInArrow(shared.trimmed(work), out)


def plain(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for `reports`, `repair` and `repaired_digests`."""
    return _plain(conversations)
