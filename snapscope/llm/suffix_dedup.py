"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it starts at two places or more, in one document or in two. Each
such string (window) has one anchor, its GRAM bytes with the least hash; neighbouring windows share it, and their run
and its bytes are the anchor's context. Equal windows have equal anchors at equal places, so only anchors that occur
twice matter, and windows need comparing only among the contexts of one anchor:

1. Anchors are counted; those that occur twice or more are kept with the hash of their context.
2. Contexts that occur twice have all their windows repeated, which counting shows (copies collapse here, before any
   text moves). The distinct contexts of an anchor, one of each, are fetched from their texts.
3. Their windows are sorted as suffixes: a merge sort whose comparisons find the common extension of two suffixes by
   binary search over prefix polynomial hashes. Neighbours of equal hash are repeated once their bytes agree.
4. An anchor with more than MANY contexts isn't sorted in one place: its windows are dealt out by their digest and
   meet there. The spans of each document are joined and cut from its bytes.

All rows are keyed by a hash of id and text, so equal rows share a result; each of them counts as a start of its own.

Defined results: null is empty; texts shorter than LENGTH keep all; empty tables give no rows; texts of any length are
read in parts that overlap by LENGTH - 1 bytes, so no window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, few_files, join_small_groups, stored

LENGTH = 200
GRAM = 50
REACH = LENGTH - GRAM + 1  # grams of a window
PART = 1 << 20  # bytes hashed at a time
PLACE = np.uint64(PART - 1)
MANY = 5000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of INVERSE."""

    def of(base: np.uint64) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)

    return of(BASE), of(INVERSE)


class PrefixHashes:
    """Polynomial hashes of all prefixes of a buffer, modulo 2**64; so of any of its substrings."""

    def __init__(self, data: np.ndarray):
        # A part has PART bytes at most; the contexts of one anchor may have a few times as many.
        power, self.inverse = _powers(1 << max(20, int(len(data) + LENGTH).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def parts_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of parts below PART bytes; each window lies in exactly one."""
    step = PART - LENGTH
    for at in range(0, max(len(text) - LENGTH + 1, 0), step):
        yield at, text[at : at + step + LENGTH - 1]


def anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(part, anchor hash, anchor place, first and last window start) of each run of windows; places in the part.

    The parts are hashed as one buffer of at most PART bytes; windows across a border are left out.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    owner = np.repeat(np.arange(len(parts)), sizes)
    grams = mixed(PrefixHashes(data).of(np.arange(len(data) - GRAM + 1), GRAM))
    # The least hash; of equal ones the first. Which of them depends on the window's bytes alone.
    least = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), REACH)
    place = (least & PLACE).astype(np.int64)
    start = np.flatnonzero(owner[: len(place)] == owner[LENGTH - 1 :])
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    place, part = place[start], owner[start]
    new = np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    part, at = part[first], place[first]
    return part, grams[at].view(np.int64), at - begins[part], start[first] - begins[part], start[last] - begins[part]


def _gathered(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row numbers, offsets and parts of texts, as many at a time as PART bytes hold."""
    rows, offsets, parts, held = [], [], [], 0
    for row, text in enumerate(texts):
        for offset, part in parts_of(text):
            if held + len(part) > PART:
                yield rows, offsets, parts
                rows, offsets, parts, held = [], [], [], 0
            rows.append(row)
            offsets.append(offset)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, offsets, parts


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


# A place in a text with its run: anchor place, and how far before it the first and last window start (below 256).
def packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at << 16) | ((at - first) << 8) | (at - last)


def unpacked(place: int) -> tuple[int, int, int]:
    """(anchor, first window start, last window start)"""
    at = place >> 16
    return at, at - (place >> 8 & 255), at - (place & 255)


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, parts in _gathered(_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(parts)[1])], names=["h"])

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, c, rid, place) of every anchor; c is a hash of its context's bytes and of its place in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(1).to_numpy()
            for rows, offsets, parts in _gathered(_bytes(batch.column(0))):
                part, h, at, first, last = anchors(parts)
                rid, offset = rids[rows][part], np.array(offsets)[part]
                views = [memoryview(p) for p in parts]
                digest = xxhash.xxh3_64_intdigest
                c = np.fromiter(
                    (digest(views[k][a : b + LENGTH], seed=p - a) for k, p, a, b in zip(part.tolist(), at.tolist(), first.tolist(), last.tolist())),
                    np.uint64, len(part),
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, rid, packed(at + offset, first + offset, last + offset))], names=["h", "c", "rid", "place"])

    return docs.select("text", "rid").mapInArrow(run, "h long, c long, rid long, place long")


class SuffixSort:
    """Orders suffixes of a buffer by their first LENGTH bytes, within groups that stand together."""

    def __init__(self, data: np.ndarray):
        self.data, self.hashes = data, PrefixHashes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, LENGTH at most."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        low[self.hashes.of(x, LENGTH) == self.hashes.of(y, LENGTH)] = LENGTH
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) // 2
            same = self.hashes.of(x, middle) == self.hashes.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """x stands before y; equal ones by `ties`."""
        n = self.common(x, y)
        differ = n < LENGTH
        at = np.minimum(n, LENGTH - 1)
        return np.where(differ, self.data[x + at] < self.data[y + at], ties)

    def sort(self, suffixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Merge sort: begin and end give each suffix the bounds of its group. Returns the suffixes' new order."""
        order = np.arange(len(suffixes))
        run = 1
        longest = int((end - begin).max(initial=0))
        index = np.arange(len(suffixes))
        while run < longest:
            own = (index - begin) // run
            other_begin = begin + (own ^ 1) * run
            other_end = np.minimum(other_begin + run, end)
            moving = np.flatnonzero(other_begin < end)
            low, high = other_begin[moving], other_end[moving]
            left = (own[moving] & 1) == 0
            me = suffixes[order[moving]]
            while True:  # how many of the other run come first: its elements before me, or for the right run not after me
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                first = self.before(suffixes[order[middle]], me[open_], ~left[open_])
                low[open_] = np.where(first, middle + 1, low[open_])
                high[open_] = np.where(first, high[open_], middle)
            pair = begin[moving] + (own[moving] // 2) * 2 * run
            inside = moving - (begin[moving] + own[moving] * run)
            target = pair + inside + (low - other_begin[moving])
            merged = order.copy()
            merged[target] = order[moving]
            order = merged
            run *= 2
        return order


def repeated_windows(contexts: list[tuple[int, int, bytes]], groups: list[int]) -> np.ndarray:
    """For the windows of all contexts in turn: whether an equal one is in another context of its group.

    contexts: (offset of the anchor in the first window, number of windows, bytes); those of a group are neighbours.
    """
    data = np.frombuffer(b"".join(c[2] for c in contexts), np.uint8)
    sizes = np.array([len(c[2]) for c in contexts])
    windows = np.array([c[1] for c in contexts])
    bases = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(contexts)), windows)
    step = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = bases[which] + step
    # Equal windows hold the anchor at the same offset: only those need comparing.
    anchor = np.array([c[0] for c in contexts])[which] - step
    key = np.array(groups)[which] * 256 + anchor
    by_key = np.argsort(key, kind="stable")
    sorted_key = key[by_key]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    heads = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    begin, end = heads[number], np.r_[heads[1:], len(key)][number]
    sorter = SuffixSort(data)
    order = by_key[sorter.sort(suffix[by_key], begin, end)]
    full = sorter.hashes.of(suffix[order], LENGTH)
    alike = np.flatnonzero((full[1:] == full[:-1]) & ~first[1:])
    out = np.zeros(len(key), bool)
    wrong = False
    for at in range(0, len(alike), 8192):
        pairs = alike[at : at + 8192]
        x, y = suffix[order[pairs]], suffix[order[pairs + 1]]
        spread = np.arange(LENGTH)
        equal = (data[x[:, None] + spread] == data[y[:, None] + spread]).all(axis=1)
        wrong |= not equal.all()
        out[order[pairs[equal]]] = out[order[pairs[equal] + 1]] = True
    if wrong:  # two strings of one hash: the bytes themselves decide for all of these windows
        seen: dict[tuple[int, bytes], int] = {}
        for i in range(len(key)):
            text = (int(key[i]), data[suffix[i] : suffix[i] + LENGTH].tobytes())
            if text in seen:
                out[i] = out[seen[text]] = True
            else:
                seen[text] = i
    return out


SPANS = "rid long, start long, stop long"
_SPANS_ARROW = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
UNITS = "h long, sub long, rid long, place long, known boolean, step int, bytes binary"
_UNITS_ARROW = pa.schema([("h", pa.int64()), ("sub", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("known", pa.bool_()), ("step", pa.int32()), ("bytes", pa.binary())])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted contexts of each text: whole, or for an anchor with many contexts window by window as digests."""
    for batch in batches:
        names = batch.schema.names
        rids, wanted = batch.column(names.index("rid")).to_pylist(), batch.column(names.index("wanted"))
        rows: list[tuple] = []
        held = 0
        for k, text in enumerate(batch.column(names.index("text")).cast(pa.binary())):
            text, rid = text.as_py(), rids[k]
            for w in wanted[k].as_py():
                at, first, last = unpacked(w["place"])
                if w["contexts"] <= MANY:
                    rows.append((w["h"], 0, rid, w["place"], w["known"], -1, text[first : last + LENGTH]))
                    held += last - first + LENGTH
                else:
                    units = w["contexts"] * REACH // MANY + 1
                    for start in range(first, last + 1):
                        digest = xxhash.xxh3_128_digest(text[start : start + LENGTH], seed=at - start)
                        rows.append((w["h"], int.from_bytes(digest[:6], "little") % units + 1, rid, w["place"], w["known"], start - first, digest))
                    held += 40 * (last - first + 1)
            if held > 4 << 20:
                yield _rows(rows, _UNITS_ARROW)
                rows, held = [], 0
        yield _rows(rows, _UNITS_ARROW)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _spans_of(rid: int, first: int, marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Spans that the marked windows cover; the first window starts at `first`."""
    starts = np.flatnonzero(marks)
    if len(starts):
        cuts = np.flatnonzero(np.diff(starts) > LENGTH)
        for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(starts) - 1]):
            yield rid, first + int(starts[a]), first + int(starts[b]) + LENGTH


def _sorted_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from contexts that come ordered by (h, sub); many small units are sorted together."""
    contexts: list[tuple[int, int, bytes]] = []
    groups: list[int] = []
    owners: list[tuple[int, int, bool]] = []
    out: list[tuple] = []
    held, unit, open_unit = 0, None, 0

    def flush(n: int) -> None:
        """Sorts the first n contexts, whole units all of them."""
        nonlocal held
        if n > 1:
            marks = repeated_windows(contexts[:n], groups[:n])
            at = 0
            for (_, windows, _), (rid, first, known) in zip(contexts[:n], owners[:n]):
                if not known:
                    out.extend(_spans_of(rid, first, marks[at : at + windows]))
                at += windows
        del contexts[:n], groups[:n], owners[:n]
        held = sum(len(c[2]) for c in contexts)

    seen: dict[bytes, tuple | None] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for h, sub, rid, place, known, step, data in zip(*columns):
            if (h, sub) != unit:
                unit, open_unit = (h, sub), len(contexts)
                seen.clear()
            at, first, last = unpacked(place)
            if sub:
                span = None if known else (rid, first + step, first + step + LENGTH)
                if data not in seen:
                    seen[data] = span or ()
                else:
                    if seen[data]:
                        out.append(seen[data])
                    seen[data] = ()
                    if span:
                        out.append(span)
                continue
            if held + len(data) > PART and open_unit:
                flush(open_unit)
                open_unit = 0
            contexts.append((at - first, last - first + 1, data))
            groups.append(len(groups) and groups[-1] + (open_unit == len(contexts) - 1))
            owners.append((rid, first, known))
            held += len(data)
        if out:
            yield _rows(out, _SPANS_ARROW)
            out.clear()
    flush(len(contexts))
    yield _rows(out, _SPANS_ARROW)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(rid, spans): the byte ranges of each keyed document that windows found twice or more cover."""
    bounded_batches(docs)
    counts = stored(few_files(anchor_counts(docs).where("n > 1")), "anchors")
    rows = join_small_groups(anchor_rows(docs), counts.withColumn("_n", F.col("n")), ["h"], "_n", F.col("rid")).where("n IS NOT NULL").drop("n")
    rows = stored(rows, "repeated-anchors")
    contexts = rows.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("rid", "place")).alias("one"))
    contexts = stored(few_files(contexts.select("h", "c", "times", "one.*")), "contexts")
    several = contexts.groupBy("h").agg(F.count("*").alias("contexts"), F.max("times").alias("most"))
    known = contexts.where("times > 1").select("h", "c", "times", F.lit(True).alias("known"))
    whole = join_small_groups(rows, known, ["h", "c"], "times", F.col("rid")).where("known")
    at = F.shiftright("place", 16)
    whole = whole.select("rid", (at - F.shiftright("place", 8).bitwiseAND(255)).alias("start"), (at - F.col("place").bitwiseAND(255) + LENGTH).alias("stop"))
    mixed_ = join_small_groups(contexts, several.where("contexts > 1").withColumn("_n", F.col("contexts")), ["h"], "_n", F.col("rid")).where("contexts IS NOT NULL")
    wanted = mixed_.groupBy("rid").agg(F.collect_list(F.struct("h", "place", "contexts", (F.col("times") > 1).alias("known"))).alias("wanted"))
    fetched = texts.join(wanted, "rid").mapInArrow(_fetched, UNITS)
    units = fetched.repartition("h", "sub").sortWithinPartitions("h", "sub").mapInArrow(_sorted_units, SPANS)
    spans = whole.union(units).distinct()
    return spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


CUT = "struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, clean: string>"


def cut(text: str, spans: str, clean: bool) -> Column:
    """Counts and digest of what is left; with `clean` also the text, less broken characters at the cuts."""

    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, ranges in zip(texts.cast(pa.binary()), spans):
            text = text.as_py() or b""
            out, at, removed = [], 0, 0
            ranges = merged(ranges.as_py())
            for start, stop in ranges:
                out.append(text[at:start])
                at, removed = stop, removed + stop - start
            kept = b"".join([*out, text[at:]])
            rows.append((len(text), removed, len(ranges), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if clean and ranges else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "clean"])

    return F.arrow_udf(of, CUT)(text, spans)


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    texts = keyed(docs.select("doc_id", "text"))
    found = texts.join(repeated_spans(texts, texts), "rid", "left").select("doc_id", cut("text", "spans", False).alias("c"))
    return found.select("doc_id", "c.n_bytes", "c.n_removed", "c.n_spans", "c.kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their texts less the repeated strings."""
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("_rest")
    texts = keyed(docs.select("doc_id", "text", rest))
    found = texts.join(repeated_spans(texts.select("doc_id", "text", "rid"), texts), "rid", "left")
    clean = F.coalesce(cut("text", "spans", True)["clean"], F.col("text")).alias("text")
    return found.select("_rest.*", clean).select(*docs.columns)
