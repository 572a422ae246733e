"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words go into one automaton per block of at most BLOCK_WORDS words. Documents are streamed word by word;
the state tells the longest match that ends here. A match of `window` words or more marks the last `window` words
and names the items that hold them; an item shorter than the window is marked where all of it occurs.

The benchmark is the stated query set: it is fetched block by block and each block is sent to all executors. A
worker with several blocks scans each batch once per block and keeps one automaton in memory at a time.

Defined results: null or wordless texts have no words and no hits; items without words hit nothing; a null item_id
counts as the empty id; several items of one id count once; repeated rows are judged row by row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches

WINDOW = 10
BLOCK_WORDS = 500_000
# A document of which more than this share of the words is hit goes as a whole.
MAX_COVERAGE = 0.8

# A-Z to a-z, all other ASCII but 0-9 and a-z to a blank; bytes of other characters stay.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """States with transitions, suffix links and longest lengths; for states that hold a window, their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]) for i, text in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for item, codes in coded:
            state = 0
            for k, c in enumerate(codes):
                state = self.next[state][c]
                if k + 1 >= window:
                    self.items.setdefault(self.holder(state), set()).add(item)
            if 0 < len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.short.setdefault(state, set()).add(item)

    def _new(self, length: int, copied: int | None = None) -> int:
        self.next.append({} if copied is None else dict(self.next[copied]))
        self.link.append(-1 if copied is None else self.link[copied])
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, c: int) -> int:
        """The state of the longest word of `state` followed by c, cut off from longer ones if need be."""
        to = self.next[state][c]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(self.length[state] + 1, to)
        self.link[to] = copy
        while state >= 0 and self.next[state].get(c) == to:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, state = self._new(self.length[last] + 1), last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, c)
        return new

    def holder(self, state: int) -> int:
        """The state of the last `window` words of what state holds."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [from, to) in words, joined where they touch, and the items that occur."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        state, n = 0, 0
        move, link, length, window, short = self.next, self.link, self.length, self.window, self.short

        def mark(start: int, end: int) -> None:
            while runs and runs[-1][1] >= start:
                start, end = min(start, runs[-1][0]), max(end, runs[-1][1])
                runs.pop()
            runs.append((start, end))

        for at, c in enumerate(map(self.vocabulary.get, text_words)):
            if c is None:
                state = n = 0
                continue
            while state and c not in move[state]:
                state = link[state]
                n = length[state]
            if c not in move[state]:
                continue
            state = move[state][c]
            n += 1
            if n >= window:
                mark(at - window + 1, at + 1)
                found |= self.items[self.holder(state)]
            if short:
                above = state
                while above > 0:
                    if above in short and length[above] <= n:
                        mark(at + 1 - length[above], at + 1)
                        found |= short[above]
                    above = link[above]
        return runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text less the bytes from the first to the last word of each run; a blank stays in the place."""
    ends = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for start, end in runs:
        out.append(text[at : ends[start][0]])
        at = ends[end - 1][1]
    return b" ".join([*(x.strip(b" ") for x in out), text[at:].strip(b" ")]).strip(b" ")


_KEPT: dict[tuple, Automaton] = {}


def _automaton(block, window: int) -> Automaton:
    key = (block.id if hasattr(block, "id") else id(block), id(block.value), window)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Automaton(block.value, window)
    return _KEPT[key]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list:
    """The items (id, text), sent out in blocks of bounded size."""
    bounded_batches(benchmark)
    spark, out, block, held = benchmark.sparkSession, [], [], 0
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for row in items.toLocalIterator():
        block.append((row["i"], row["text"].encode()))
        held += len(row["text"]) // 2 + 1
        if held >= block_words:
            out.append(spark.sparkContext.broadcast(block))
            block, held = [], 0
    if block:
        out.append(spark.sparkContext.broadcast(block))
    return out


FOUND = "struct<n_words: long, n_hit: long, items: array<string>, clean: string>"


def found_in(sent: list, window: int = WINDOW, clean: bool = False) -> Column:
    """Of the column `text`: words, hit words, items, and with `clean` the text less its hits where it has any."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        counts: list[int] = [0] * len(raw)
        runs: list[list] = [[] for _ in counts]
        items: list[set] = [set() for _ in counts]
        for block in sent or [None]:
            automaton = block and _automaton(block, window)
            for at, text in enumerate(raw):
                if text.is_valid:
                    ws = words(text.as_py())
                    counts[at] = len(ws)
                    if automaton and ws:
                        hit, found = automaton.scan(ws)
                        runs[at] += hit
                        items[at] |= found
        runs = [merged(r) if r else r for r in runs]
        cleaned = [None] * len(runs)
        if clean:
            for at, hit in enumerate(runs):
                text = raw[at].as_py()
                while hit:  # what a cut brings together may hold a window again
                    text = without_runs(text, hit)
                    hit = merged([r for block in sent for r in _automaton(block, window).scan(words(text))[0]])
                    cleaned[at] = text.decode("utf-8", "ignore")
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(cleaned, pa.string()),
            ],
            names=["n_words", "n_hit", "items", "clean"],
        )

    return find("text")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = docs.select("doc_id", "text").select("doc_id", found_in(blocks(benchmark), window).alias("f"))
    return found.select(
        "doc_id", "f.n_words", "f.n_hit", F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without documents whose hit words exceed the coverage limit, and without the hit spans of the others."""
    found = docs.withColumn("_found", found_in(blocks(benchmark), window, clean=True))
    kept = found.where(F.col("_found.n_hit") <= max_coverage * F.col("_found.n_words"))
    return kept.withColumn("text", F.coalesce("_found.clean", "text")).select(docs.columns)
