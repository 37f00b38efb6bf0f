"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest
from odd_columns import HELPERS

from lumigate.llm import conversations as C
from lumigate.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, head int, report string"
WANT = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def in_order(rows):
    def key(r):
        h = hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
        return (r[1] is not None, r[1] or 0, h)

    return sorted(rows, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, bad):
    """The least (cost, audit, repaired) by trying every edit; the pattern is checked on the whole of what comes out."""

    @functools.cache
    def rest(i, roles, inserted):
        found = [(0, "", ())] if i == len(rows) and WANT.match(roles) else []

        def put(cost, letter, line, j, role, k):
            if re.match(r"s?(ua)*u?\Z", roles + role):
                short = roles + role
                short = short.replace("ua", "", 1) if short.count("ua") > 1 else short
                c, a, r = rest(j, short, k)
                found.append((cost + c, letter + a, (line, *r)))

        if inserted < 3:
            for role in ("user", "assistant"):
                put(2, "I", f"{role}:", i, role[0], inserted + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = rest(i + 1, roles, 0)
            found.append((3 + c, "D" + a, r))
            if bad[i] not in ("blank", "duplicate"):
                own = bad[i] == "truncated"
                put(own, "K", f"{role}:{text}", i + 1, role[:1] or "-", 0)
                for new in ("user", "assistant"):
                    put(2 + own, "R", f"{new}:{text}", i + 1, new[0], 0)
        return min(found) if found else (1 << 30, "", ())

    return rest(0, "", 0)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in damage(rows) if r[0] == conv])
        bad = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, lines = search(own, bad)
        initials = [r[2][:1] for r in own]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [bad.count(kind) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, tmp_path=None):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = C.repaired_digests(C.damaged(table)).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


def test_repairs_equal_a_search_over_all_edits(spark):
    rng = random.Random(13)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "a. b", None, "Yes. ", "é.", "x\x1c"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = []
    for conv in [*range(400), None]:
        for turn in range(rng.randrange(1, 8)):
            turn = None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 5
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    assert found(spark, rows) == expected(rows)


def test_an_empty_table_gives_no_rows_and_a_dropped_conversation_one(spark):
    assert C.repaired_digests(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", none)}


def test_checkpoints_give_the_audit_of_vectors_kept_whole():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 10, 99, 1000, 5000):
        codes = bytes(rng.randrange(16) for _ in range(n))
        costs = C.Costs()
        vectors, now = [costs.end], costs.end
        for code in reversed(codes):
            now, _ = costs.back(now, code)
            vectors.append(now)
        s, audit = C.START, []
        for i, code in enumerate(codes):
            letters, s = costs.walk(vectors[n - 1 - i], code, s)
            audit.append(letters)
        audit.append(costs.finish(s))
        cost, got = C.cheapest(codes)
        assert got == "".join(audit)
        price = {"D": 3, "I": 2, "K": 0, "R": 2}
        kept = [(letter, code) for letter, code in zip(got.replace("I", ""), codes)]
        assert cost == sum(map(price.get, got)) + sum(letter != "D" and code >> 2 == C.TRUNCATED for letter, code in kept)


@pytest.mark.parametrize("pack", [1, 3, 64])
def test_a_long_conversation_in_small_packs(spark, monkeypatch, pack):
    rows = [("user assistant".split()[i % 2], f"Line {i // 3}." if i % 7 else "cut") for i in range(900)]
    rows = [(5, i // 2, role, text) for i, (role, text) in enumerate(rows)] + [(5, 1000, "user", "Same.")] * 300 + [(6, 0, "user", "Hi.")]
    want = found(spark, rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    lots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = {r.conv_id: r for r in C.repaired_digests(C.damaged(table)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", lots)
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for k, r in again.items()} == want
    # the packing alone, in runs of a few codes
    monkeypatch.setattr(C, "PACK", pack)
    import pyarrow as pa

    sorted_rows = [(1, t, bytes([t]), n, 1, 9) for t, n in ((0, 1), (1, 200), (2, 1), (3, 3))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*sorted_rows)], names=list("abcdef"))
    runs = list(C._pack(iter([batch])))
    assert b"".join(r[4] for r in runs) == b"\1\1" + b"\t" * 199 + b"\1\1\t\t" and max(len(r[4]) for r in runs) <= pack
    assert [r[1:4] for r in runs] == sorted(r[1:4] for r in runs) and len({r[1:4] for r in runs}) == len(runs)


def test_repaired_rows_and_columns_of_any_name(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "More."), (1, 3, "assistant", "A."), (2, 0, "assistant", "A.")]
    table = spark.createDataFrame([(*r, *range(len(HELPERS))) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{h}` int" for h in HELPERS))
    got = sorted((r.conv_id, r.place, r.edit, r.role, r.text) for r in C.repair(C.plain(table)).collect())
    assert got == [
        (1, 0, "K", "system", "S."), (1, 1, "K", "user", "Q?"), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "More."), (1, 4, "K", "assistant", "A."),
        (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "A."),
    ]


def test_the_query_equals_the_search_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = Q.QUERIES["op13_conversations"](spark, sf)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()} == expected(rows)
