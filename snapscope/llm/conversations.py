"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

The state is the last role that stands: none yet, system, user or assistant. From each state one role can follow, so
an edit is one letter: Delete a row, Insert an empty one of the role that follows, Keep a row, give it that Role. With the
costs to the end known for each state (a vector of four), the walk forward takes at each place the
ASCII-least edit that costs no more than it must.

The backward vectors are stored only at checkpoints, at every square root of a block's rows; the walk recomputes
the rows between two of them. Conversations are sorted by range over all tasks, whatever their size, and one that spans
several tasks has a block in each. A block's effect on the vector is a four by four (min, plus) matrix, so the vectors at the
blocks' ends follow from these matrices, one small row per block; each such block is walked from all four states, and the states at
the ends pick the walk that holds. Texts take no part in this: rows travel as digests, equal rows of one turn as one row
with their number, and texts are joined to the rows that stay.

Order within a conversation: turn (nulls first), role, digest of role and text; equal rows are adjacent. First faults: blank,
duplicate (role and text seen earlier), truncated. Blank and duplicate rows must go.

Defined results: a null role or text is one blank, so a null text is blank and a null role is neither system, user nor
assistant; a null conv_id is one conversation; null turns come first and count for no gap; an empty table gives no row. A role
counts by its first letter. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, join_small_groups, stored

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5

NONE, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
# The state after the role that follows each state, and that role.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {USER: "u", ASSISTANT: "a"}

Vector = tuple[int, int, int, int]
Row = tuple[str, int, int]  # first letter of the role, first fault (0: none), copies that follow and must go


def with_inserts(v: Vector) -> Vector:
    """The costs where rows may be inserted first."""
    none, system, user, assistant = v
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(none, INSERT + user), min(system, INSERT + user), user, assistant


END = with_inserts((0, NEVER, NEVER, 0))


def _keeps(row: Row, state: int) -> int | None:
    """The state after a row that stays as it is; None where it can't."""
    if row[0] == _INITIAL[_NEXT[state]]:
        return _NEXT[state]
    return SYSTEM if state == NONE and row[0] == "s" else None


def before(row: Row, after: Vector) -> Vector:
    """The costs before a row from those after it."""
    copies = DELETE * row[2]
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if row[1] not in (BLANK, DUPLICATE):
            short = CUT_SHORT if row[1] == TRUNCATED else 0
            best = min(best, short + REROLE + after[_NEXT[state]])
            kept = _keeps(row, state)
            if kept is not None:
                best = min(best, short + after[kept])
        costs.append(min(best + copies, NEVER))
    return with_inserts(tuple(costs))


def through(rows: list[Row], after: Vector) -> Vector:
    for row in reversed(rows):
        after = before(row, after)
    return after


def block_matrix(rows: list[Row]) -> list[Vector]:
    """For each state after the block, the costs before it."""
    return [through(rows, tuple(0 if k == state else NEVER for k in range(4))) for state in range(4)]


def applied(matrix: list[Vector], after: Vector) -> Vector:
    return tuple(min(min(after[end] + matrix[end][start] for end in range(4)), NEVER) for start in range(4))


def step(row: Row | None, state: int, here: Vector, after: Vector) -> tuple[str, int]:
    """The edits before and of one row (None: what follows the last row), and the state behind it."""
    edits = ""
    while True:
        cost = here[state]
        if row is None:
            if cost == 0 and state in (NONE, ASSISTANT):
                return edits, state
        else:
            rest = [x + DELETE * row[2] for x in after]
            short = CUT_SHORT if row[1] == TRUNCATED else 0
            if cost == DELETE + rest[state]:
                return edits + "D" * (1 + row[2]), state
            if cost != INSERT + here[_NEXT[state]]:
                kept = _keeps(row, state)
                if kept is not None and cost == short + rest[kept]:
                    return edits + "K" + "D" * row[2], kept
                return edits + "R" + "D" * row[2], _NEXT[state]
        edits, state = edits + "I", _NEXT[state]


def walk(rows: list[Row], state: int, after: Vector, last: bool) -> tuple[list[str], int]:
    """The edits of each row of a block, and the state behind it, from the state before and the costs after it.

    `last`: nothing follows, so what is inserted behind the last row belongs to it.
    """
    n = max(1, isqrt(len(rows)))
    checkpoints, vector = {}, after
    for at in range(len(rows) - 1, -1, -1):
        if (at + 1) % n == 0 or at == len(rows) - 1:
            checkpoints[at // n] = vector  # the costs behind the rows from at // n * n on
        vector = before(rows[at], vector)
    edits = []
    for k in range(-(-len(rows) // n)):
        part = rows[k * n : (k + 1) * n]
        vectors = [checkpoints[k]]
        for row in reversed(part):
            vectors.append(before(row, vectors[-1]))
        vectors.reverse()
        for row, here, behind in zip(part, vectors, vectors[1:]):
            done, state = step(row, state, here, behind)
            edits.append(done)
    if last:
        done, state = step(None, state, after, after)
        edits[-1] += done
    return edits, state


# --- rows and blocks on Spark -------------------------------------------------------------------

_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with every fifth or so damaged, by a checksum of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (
        rows.withColumn("_kind", kind).where("_kind <> 0")
        .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
        .drop("_copy")
    )


def _conversation() -> Column:
    """A key that is never null; see _conv_id."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _conv_id(kind: str) -> Column:
    return F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        _conversation().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))


def ordered_rows(keyed: DataFrame) -> DataFrame:
    """One row per turn, role and text with its first fault and its number, in order within each part, stored.

    The first row of a block that reaches an edge of its part has the block's matrix.
    """
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    folded = keyed.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.max(fault).alias("fault"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = folded.groupBy("conv", "role", "digest").agg(F.min(place).alias("_first"), F.count("*").alias("_rows"))
    met = join_small_groups(folded, first, ["conv", "role", "digest"], "_rows", F.xxhash64("turn"))
    fault = F.when((F.col("fault") != BLANK) & (place != F.col("_first")), DUPLICATE).otherwise(F.col("fault"))
    marked = met.select("conv", "turn", "role", "digest", "copies", fault.alias("fault"))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    spread = marked.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for block, edge in _with_edges(_blocks(batches)):
            matrix = [None] * len(block)
            if edge:
                matrix[0] = [x for vector in block_matrix(_rows(block)) for x in vector]
            columns = [*block.columns, pa.array(range(at, at + len(block)), pa.int64()), pa.array(matrix, pa.list_(pa.int64()))]
            at += len(block)
            yield from pa.table(columns, names=[*block.schema.names, "pos", "matrix"]).to_batches()

    schema = "conv string, turn long, role string, digest binary, copies long, fault int, part int, pos long, matrix array<long>"
    return stored(spread.mapInArrow(run, schema), "conversation-rows")


def _rows(block: pa.Table) -> list[Row]:
    """What the costs depend on; copies beyond the first must go."""
    initials = (r[:1] for r in block.column("role").to_pylist())
    return list(zip(initials, block.column("fault").to_pylist(), (n - 1 for n in block.column("copies").to_pylist())))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (part, conversation), which lie together; no more than one block is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = list(zip(batch.column("part").to_pylist(), batch.column("conv").to_pylist()))
        start = 0
        for at in range(1, len(names) + 1):
            if at < len(names) and names[at] == names[start]:
                continue
            piece = batch.slice(start, at - start)
            if held and (held[0].column("part")[0].as_py(), held[0].column("conv")[0].as_py()) != names[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            start = at
    if held:
        yield pa.Table.from_batches(held)


def _with_edges(blocks: Iterator[pa.Table]) -> Iterator[tuple[pa.Table, bool]]:
    """Each block, and whether it is the first or the last of its part, so that its conversation may go on elsewhere."""
    before, first = None, True
    for block in blocks:
        if before is not None:
            yield before, first
            first = False
        before = block
    if before is not None:
        yield before, True


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FOUND = ["conv", "part", "pos", "turn", "role", "digest", "copies", "fault"]
_EDITED = pa.schema([
    ("conv", pa.string()), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
    ("copies", pa.int64()), ("fault", pa.int32()), ("edits", pa.string()), ("new_role", pa.string()),
    ("ahead", pa.list_(pa.string())), ("behind", pa.list_(pa.string())),
])
EDITED = (
    "conv string, part int, pos long, turn long, role string, digest binary, copies long, fault int, edits string, new_role string, "
    "ahead array<string>, behind array<string>"
)


def _ends(key: tuple, blocks: pa.Table) -> pa.Table:
    """The costs behind each block of one conversation, from the matrices of those that follow."""
    rows = sorted(zip(blocks.column("part").to_pylist(), blocks.column("matrix").to_pylist()), reverse=True)
    after, out = END, []
    for part, flat in rows:
        out.append((key[0].as_py(), part, list(after), len(out) == 0, len(rows) > 1))
        after = applied([tuple(flat[k : k + 4]) for k in range(0, 16, 4)], after)
    kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv", "part", "after", "last", "several"])


def _starts(key: tuple, blocks: pa.Table) -> pa.Table:
    """The state before each block of one conversation, from the states that the blocks before lead to."""
    state, out = NONE, []
    for part, reached in sorted(zip(blocks.column("part").to_pylist(), blocks.column("reached").to_pylist())):
        out.append((key[0].as_py(), part, state))
        state = reached[state]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.int32()))], names=["conv", "part", "state"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state before a block, the state behind it."""
    for block in _blocks(batches):
        after, last = tuple(block.column("after")[0].as_py()), block.column("last")[0].as_py()
        ends = [walk(_rows(block), state, after, last)[1] for state in range(4)]
        yield pa.RecordBatch.from_arrays(
            [block.column("conv")[:1].combine_chunks(), block.column("part")[:1].combine_chunks(), pa.array([ends], pa.list_(pa.int32()))],
            names=["conv", "part", "reached"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        after, last, state = (block.column(n)[0].as_py() for n in ("after", "last", "state"))
        after, last, state = (END, True, NONE) if after is None else (tuple(after), last, state or NONE)
        done, _ = walk(_rows(block), state, after, last)
        out = []
        for row, edits in zip(zip(*(block.column(n).to_pylist() for n in _FOUND)), done):
            new_role, ahead, behind, seen = None, [], [], False
            for edit in edits:
                if edit == "I":
                    state = _NEXT[state]
                    (behind if seen else ahead).append(_ROLE[state])
                    continue
                seen = True
                if edit == "K":
                    new_role, state = row[4], _keeps((row[4][:1], 0, 0), state)
                elif edit == "R":
                    state = _NEXT[state]
                    new_role = _ROLE[state]
            out.append((*row, edits, new_role, ahead, behind))
        for at in range(0, len(out), 10_000):
            columns = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED)], schema=_EDITED)


def edited_rows(rows: DataFrame) -> DataFrame:
    """Every row of ordered_rows with its edits, the role it gets (null: deleted) and the roles of rows put before and behind.

    A part has two blocks at most that may go on in other parts, the first and the last, so what is known of these is sent
    to all tasks.
    """
    def blocks_with(facts: DataFrame, how: str) -> DataFrame:
        return rows.drop("matrix").join(F.broadcast(facts), ["conv", "part"], how).repartition("part").sortWithinPartitions("part", "pos")

    edges = rows.where("matrix IS NOT NULL").select("conv", "part", "matrix")
    ends = stored(edges.groupBy("conv").applyInArrow(_ends, "conv string, part int, after array<long>, last boolean, several boolean"), "conversation-ends")
    reached = blocks_with(ends.where("several"), "inner").mapInArrow(_reached, "conv string, part int, reached array<int>")
    starts = reached.groupBy("conv").applyInArrow(_starts, "conv string, part int, state int")
    facts = ends.drop("several").join(starts, ["conv", "part"], "left")
    return blocks_with(facts, "left").mapInArrow(_edits, EDITED)


def _with_texts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), edited, with the texts of those that stay. No row that stays has its role and text twice
    in a conversation, so neither side of the join repeats a key."""
    keyed = _keyed(rows)
    edited = stored(edited_rows(ordered_rows(keyed)), "conversation-edits")
    texts = keyed.dropDuplicates(["conv", "role", "digest"]).select("conv", "role", "digest", "text")
    stay = edited.where("new_role IS NOT NULL").join(texts, ["conv", "role", "digest"], "left")
    return stay.unionByName(edited.where("new_role IS NULL").withColumn("text", F.lit(None).cast("string")))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of all conversations after repair; sorting by place gives their order."""
    put_in = lambda name: F.transform(name, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.when(F.col("new_role").isNotNull(), F.array(F.struct(
        F.col("new_role").alias("role"), "text", F.when(F.col("edits").contains("R"), "R").otherwise("K").alias("edit")))).otherwise(F.array())
    lines = _with_texts(rows).select("conv", "part", "pos", F.posexplode(F.concat(put_in("ahead"), own, put_in("behind"))).alias("k", "line"))
    return lines.select(_conv_id(rows.schema["conv_id"].dataType.simpleString()), F.struct("part", "pos", "k").alias("place"), "line.role", "line.text", "line.edit")


_REPORT = pa.schema([("conv", pa.string())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                    + [("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Conversation:
    """What is reported of one conversation, taken up row by row."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.sha = conv, [], hashlib.sha256()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.lines = 0
        self.low = self.high = self.initial = None

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def take(self, turn, role, copies, fault, edits, new_role, ahead, behind, text) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += copies if fault == BLANK else 0
        self.duplicate += copies if fault == DUPLICATE else copies - 1 if fault != BLANK else 0
        self.truncated += fault == TRUNCATED
        pair = None if self.initial is None else self.initial + role[:1]
        self.illegal += (pair is not None and pair not in ("su", "ua", "au")) + copies - 1
        self.initial = role[:1]
        self.audit.append(edits)
        self.cost += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R")
        for name in ahead:
            self.line(name, "")
        if new_role is not None:
            self.cost += CUT_SHORT if fault == TRUNCATED else 0
            self.line(new_role, text)
        for name in behind:
            self.line(name, "")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _report_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "role", "copies", "fault", "edits", "new_role", "ahead", "behind", "text"))
        for conv, *row in zip(*columns):
            if now is None or now.conv != conv:
                out += [now.row()] if now is not None else []
                now = _Conversation(conv)
            now.take(*row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPORT)], schema=_REPORT)
            out = []
    out += [now.row()] if now is not None else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPORT)], schema=_REPORT)


def report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """Faults, cost, edits and the hash of the repaired text of every conversation of `original`, `rows` being its rows as they are now.

    One hash runs over a whole conversation, so its rows go by one task in order; that task holds one batch of them and
    the letters of the edits.
    """
    bounded_batches(rows)
    lines = _with_texts(rows).select("conv", "part", "pos", "turn", "role", "copies", "fault", "edits", "new_role", "ahead", "behind", "text")
    kinds = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = lines.repartition("conv").sortWithinPartitions("conv", "part", "pos").mapInArrow(_report_of, kinds)
    every = original.select(_conversation().alias("conv")).distinct()
    zeros = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        _conv_id(original.schema["conv_id"].dataType.simpleString()), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
