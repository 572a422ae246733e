import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from snapscope.llm import conversations
from snapscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int, matrix string, digest string, conv string"
SHAPE = re.compile("(s?(ua)+)?")


def digest(role, text):
    return hashlib.sha256(f"{role}\0{text}".encode()).digest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edit strings by dynamic programming over (row, role initials so far as a state), least cost, then least string; with the lines."""
    start = {"": (0, "", [])}  # initials' end ('' / s / u / a) -> best (cost, edits, lines)

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for state, (cost, edits, lines) in list(table.items()):
                to = "a" if state == "u" else "u"
                better(table, to, (cost + 5, edits + "I", lines + [("user" if to == "u" else "assistant", "")]))
        return table

    # Prefixes of equal cost in one state have the same futures, so the least of them stays; a longer one can't be less later on
    # unless one is a prefix of the other, and then their costs differ.
    now = inserted(dict(start))
    for (role, text), fault in zip(rows, found):
        table = {}
        for state, (cost, edits, lines) in now.items():
            better(table, state, (cost + 2, edits + "D", lines))
            if fault in (1, 2):
                continue
            short, to = 5 * (fault == 3), "a" if state == "u" else "u"
            if role[:1] == to or (role[:1] == "s" and state == ""):
                better(table, role[:1], (cost + short, edits + "K", lines + [(role, text)]))
            better(table, to, (cost + short + 1, edits + "R", lines + [("user" if to == "u" else "assistant", text)]))
        now = inserted(table)
    return min((now[s] for s in ("", "a") if s in now), key=lambda e: e[:2])


def brute(original):
    now, out = damaged(original), {}
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in now if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[2], r[3])))
        turns = {r[1] for r in rows} - {None}
        said = [(r[2], r[3]) for r in rows]
        found = faults(said)
        cost, audit, lines = cheapest(said, found)
        assert SHAPE.fullmatch("".join(r[:1] for r, _ in lines))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, found.count(1), found.count(2), found.count(3), illegal, cost, audit, sha)
    return out


def rows_of(frame):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def made(seed, n, conv, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "well", "", " \n", None, "A line.\nAnother", "é."] + [f"Text {k}." for k in range(40)]
    return [(conv, r.choice([None, k, k, k, k + 3, k // 2]), r.choice(roles), r.choice(texts)) for k in range(n)]


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", "d", "c") for r in rows], SCHEMA)


def every_edit(rows, found):
    """All ways to edit a few rows, with at most two rows put in at a place."""
    def go(at, initials, cost, edits, put):
        if at == len(rows) and SHAPE.fullmatch(initials):
            yield cost, edits
        if put < 2:
            for c in "ua":
                yield from go(at, initials + c, cost + 5, edits + "I", put + 1)
        if at < len(rows):
            yield from go(at + 1, initials, cost + 2, edits + "D", 0)
            if found[at] not in (1, 2):
                short = 5 * (found[at] == 3)
                yield from go(at + 1, initials + rows[at][0][:1], cost + short, edits + "K", 0)
                for c in "ua":
                    yield from go(at + 1, initials + c, cost + short + 1, edits + "R", 0)
    return min(go(0, "", 0, "", 0))


def test_walk_finds_the_cheapest_and_least_edits():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "x"]), str(k)) for k in range(r.randrange(0, 5))]
        found = [r.choice([0, 0, 0, 1, 2, 3]) for _ in rows]
        coded = [(role[:1], fault, 0) for (role, _), fault in zip(rows, found)]
        cost = conversations.through(coded, conversations.END)[0]
        edits = "".join(conversations.walk(coded, 0, conversations.END, True)[0]) if rows else ""
        assert (cost, edits) == every_edit(rows, found) == cheapest(rows, found)[:2]


def test_blocks_together_are_one_conversation():
    r = random.Random(6)
    for _ in range(100):
        rows = [(r.choice("suax"), r.choice([0, 0, 0, 1, 2, 3]), r.choice([0, 0, 2])) for _ in range(r.randrange(2, 60))]
        whole, _ = conversations.walk(rows, 0, conversations.END, True)
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(3))})
        blocks = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        after, ends = conversations.END, []
        for block in reversed(blocks):
            ends.append(after)
            assert conversations.applied(conversations.block_matrix(block), after) == conversations.through(block, after)
            after = conversations.applied(conversations.block_matrix(block), after)
        state, edits = 0, []
        for k, (block, end) in enumerate(zip(blocks, reversed(ends))):
            done, state = conversations.walk(block, state, end, k == len(blocks) - 1)
            edits += done
        assert edits == whole


@pytest.mark.parametrize("partitions", [2, 7])
def test_rows_of_odd_conversations(spark, partitions):
    rows = [r for conv in range(40) for r in made(conv, conv % 9, conv)]
    rows += made(99, 400, 1000) + [(1001, 5, "user", "Same.")] * 150 + [(1001, None, "assistant", "Fine.")] * 20 + made(7, 5, None) + [(1002, None, None, None)]
    rows += [(1003, k, "user", "Hm.") for k in range(100)] + [(1004, k, ("user", "assistant")[k % 2], "x " * 20_000 + f"{k}.") for k in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = framed(spark, rows)
        assert rows_of(conversations.report(conversations.damaged(frame), frame)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repaired_rows(spark):
    rows = made(1, 30, 1, ("system", "user", "assistant"))
    frame = conversations.damaged(framed(spark, rows))
    lines = sorted(conversations.repaired(frame).collect(), key=lambda r: r.place)
    sha = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
    assert brute(rows)[1][-1] == sha and {r.edit for r in lines} <= set("KRI")


def test_empty_table_and_conversations_that_lose_all(spark):
    nothing = framed(spark, [])
    assert conversations.report(conversations.damaged(nothing), nothing).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = framed(spark, [(gone, 0, "user", "Hi.")])
    assert rows_of(conversations.report(conversations.damaged(frame), frame)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")) == brute(rows)
