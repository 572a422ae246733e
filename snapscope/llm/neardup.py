"""Near duplicates by bottom-k sketches from one hash function.

1. Each text becomes the set of its hashed word shingles; equal sets are one class. The RETAINED smallest hashes of a
   class enter inverted lists; SKETCH of them form its sketch.
2. The members of a list are compared by the union of their sketches, and pairs estimated at threshold minus six
   standard deviations or more are joined into coarse groups. A pair over the threshold shares a retained value but
   for a chance below (1 - threshold) ** RETAINED. Values of more than HOT_LIST classes say little: their lists are
   used only by classes that have few others, so that common lines don't bring unrelated texts together.
3. Inside a coarse group exact Jaccard over the full sets decides. Long lists and groups are cut into blocks, and
   every pair of blocks is one unit of work, pruned by set size; a unit gives the fewest links that connect what
   is alike in it, so rows stay linear however many pairs are alike. No pair is left out and nothing is capped.
4. Components of the exact links give each document the smallest id that can be reached.

Defined results: null, empty and wordless texts have no set and are linked with nothing; a text with fewer words
than a shingle is one shingle; a null id never is the smallest unless the whole component has none; equal rows are
linked like other copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, few_files, join_small_groups, stored
from snapscope.llm.components import components

SKETCH = 40
RETAINED = 20
FEW = 14
HOT_LIST = 1000
LIST_BLOCK = 256
SET_BLOCK, SET_BLOCK_SHINGLES = 256, 120_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Shingler:
    """Distinct hashed shingles of a text, in ascending order."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def _mixed(self, h: np.ndarray) -> np.ndarray:
        for shift, factor in zip((30, 27), _MULTIPLIERS[1:]):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.translate(_LOWER).split(), self.known
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        h = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            h = h * np.uint64(_MULTIPLIERS[0]) + codes[k : len(words) - width + 1 + k]
        return np.unique(self._mixed(h))


def node_of(values: np.ndarray) -> int:
    """A class's id: hash of its whole set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes()))))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def row_id(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, rid, text_hash, n_shingles, node, sketch) of every row; node is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in batch.column(3).cast(pa.binary()):
                values = shingles(text.as_py() or b"")
                sizes.append(len(values))
                nodes.append(node_of(values) if len(values) else None)
                sketches.append(values[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "rid", "text_hash", "n_shingles", "node", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id("doc_id", "text").alias("rid"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, rid long, text_hash long, n_shingles long, node long, sketch binary")


def links(n: int, pairs: list[list[int]], block: list) -> list[tuple[int, int]]:
    """A least set of links that connects what the pairs connect, each between the least members of two parts.

    Where there are two blocks, what the pairs inside a block connect is taken as known, for other units tell it:
    only the links across are returned. So a dense group gives few links, however many blocks it has.
    """
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    across = len(set(block)) > 1
    out = []
    for i, j in sorted(pairs, key=lambda p: block[p[0]] != block[p[1]]):
        a, b = sorted((find(i), find(j)))
        if a != b:
            parent[b] = a
            if across and block[i] != block[j]:
                out.append((a, b))
    return out if across else [(find(k), k) for k in range(n) if find(k) != k]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: incidence of the values that occur twice or more, multiplied by itself in parts."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    out = np.zeros((n, n))
    if len(rows):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for start in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, (start, start + 4096))
            part = np.zeros((n, min(4096, int(column[-1]) + 1 - start)), np.float32)
            part[rows[a:b], column[a:b] - start] = 1
            out += part @ part.T
    return out.astype(np.int64)


def alike_sketches(sketches: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs whose similarity, estimated on all values that both sketches know of, is `least` or more."""
    n = len(sketches)
    # A sketch that isn't full is the whole set, so it knows of all values.
    ends = np.array([s[-1] if len(s) == SKETCH else np.uint64(0xFFFFFFFFFFFFFFFF) for s in sketches])
    within = np.array([np.searchsorted(s, ends, side="right") for s in sketches])  # [i, j]: values of i up to the end of j
    sizes = np.array([len(s) for s in sketches])
    counts = np.minimum(within, sizes[:, None])
    both = overlaps(sketches)
    known = np.where(ends[:, None] <= ends[None, :], sizes[:, None] + counts.T, counts + sizes[None, :])
    i, j = np.nonzero(np.triu(both >= least * np.maximum(known - both, 1), 1) & np.triu(both > 0, 1))
    return np.stack([i, j], axis=1)


def alike_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs with 100 * intersection >= percent * union."""
    both = overlaps(sets)
    sizes = np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    return np.stack([i, j], axis=1)


EDGES = "a long, b long"
_EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges_of_units(rows: DataFrame, unit: list[str], side: str, pairs_of) -> DataFrame:
    """Spanning edges of each unit of work. rows: unit columns, node, values (binary); they come sorted by unit.

    side: column of a row's block; a unit has one block or two.
    """
    columns = [*unit, "node", "values", side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        members: dict[int, tuple[np.ndarray, object]] = {}
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(members) > 1:
                nodes = sorted(members)
                pairs = pairs_of([members[n][0] for n in nodes])
                out.extend((nodes[i], nodes[j]) for i, j in links(len(nodes), pairs.tolist(), [members[n][1] for n in nodes]))
            members.clear()

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(len(unit))))
            nodes, values = batch.column(len(unit)).to_pylist(), batch.column(len(unit) + 1)
            sides = batch.column(len(unit) + 2).to_pylist()
            for at, key in enumerate(keys):
                if key != held:
                    close()
                    held = key
                members[nodes[at]] = (np.frombuffer(values[at].as_py(), np.uint64), sides[at])
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES_ARROW)
                out.clear()
        close()
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES_ARROW)

    return rows.select(*columns).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, EDGES)


def _block_pairs(own: Column, blocks: Column) -> Column:
    """Pairs (least, greatest) of one's own block with each of the blocks 0 to blocks - 1."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("lo"), F.greatest(own, k).alias("hi")))


def coarse_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges between classes (node, sketch) that may be linked, from the inverted lists of retained values."""
    least = threshold - 6 * (threshold * (1 - threshold) / SKETCH) ** 0.5
    numbers = F.transform(F.sequence(F.lit(0), F.least(F.length("sketch") / 8, F.lit(RETAINED)).cast("int") - 1), lambda k: F.hex(F.substring("sketch", k * 8 + 1, F.lit(8))))
    values = classes.select("node", F.explode(numbers).alias("hex")).select("node", F.xxhash64("hex").alias("value"))
    lists = values.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    listed = join_small_groups(values, lists.withColumn("size", F.col("members")), ["value"], "members", F.col("node")).where("size IS NOT NULL")
    # A class with enough values of its own leaves the hot lists.
    hot = F.sum((F.col("size") > HOT_LIST).cast("int")).over(Window.partitionBy("node"))
    used = listed.withColumn("_hot", hot).join(classes.select("node", "sketch"), "node")
    used = used.where((F.col("size") <= HOT_LIST) | (F.least(F.length("sketch") / 8, F.lit(RETAINED)) - F.col("_hot") < FEW))
    blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks.cast("long")).cast("int")
    units = used.select("value", "node", F.col("sketch").alias("values"), own.alias("own"), F.explode(_block_pairs(own, blocks)).alias("p"))
    units = units.select("value", "p.lo", "p.hi", "node", "values", "own")
    return _edges_of_units(units, ["value", "lo", "hi"], "own", lambda sketches: alike_sketches(sketches, least))


def exact_edges(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Spanning edges of the exact links in each group. members: (rid, node, n_shingles, g) of classes in groups."""
    # Sizes fall into bands; a set can only be linked with one of its own band or the two next to it on either side.
    ratio = (percent / 100) ** -0.5
    banded = members.withColumn("band", F.floor(F.log("n_shingles") / F.log(F.lit(ratio))).cast("int"))
    bands = banded.groupBy("g", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    bands = bands.withColumn("blocks", F.ceil(F.greatest(F.col("n") / SET_BLOCK, F.col("weight") / SET_BLOCK_SHINGLES)).cast("int"))
    groups = bands.groupBy("g").agg(F.sum("n").alias("size"), F.sum("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    small = (F.col("size") <= SET_BLOCK) & (F.col("weight") <= SET_BLOCK_SHINGLES)
    groups = groups.select("g", "size", small.alias("small"), F.when(~small, F.col("blocks")).alias("blocks"))
    placed = join_small_groups(banded, groups, ["g"], "size", F.col("node"))
    own = F.when(F.col("small"), F.struct(F.lit(0).alias("band"), F.lit(0).alias("block"))).otherwise(
        F.struct(F.col("band"), F.pmod(F.xxhash64("node", F.lit(1)), F.element_at("blocks", F.col("band")).cast("long")).cast("int").alias("block"))
    )
    near = F.flatten(F.transform(
        F.sequence(F.col("band") - 2, F.col("band") + 2),
        lambda b: F.when(F.element_at("blocks", b).isNull(), F.array().cast("array<struct<band:int,block:int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda k: F.struct(b.alias("band"), k.alias("block")))),
    ))
    units = placed.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("small"), F.array("own")).otherwise(near)))
    units = units.select("rid", "node", "g", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    wanted = units.groupBy("rid", "node").agg(F.collect_list(F.struct("g", "own", "lo", "hi")).alias("units"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            out = [shingles(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            # A text that has come by a repeated id isn't the one that was asked for.
            right = pa.array([len(v) > 0 and node_of(v) == n for v, n in zip(out, batch.column(0).to_pylist())], pa.bool_())
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in out], pa.binary())], names=["node", "units", "values"])
            yield made.filter(right)

    texts = docs.select(row_id("doc_id", "text").alias("rid"), "text").join(wanted, "rid").select("node", "units", "text")
    kind = "array<struct<g:long,own:struct<band:int,block:int>,lo:struct<band:int,block:int>,hi:struct<band:int,block:int>>>"
    full = texts.mapInArrow(sets, f"node long, units {kind}, values binary")
    full = full.select("node", "values", F.explode("units").alias("u")).select(
        "node", "values", "u.g", F.to_json("u.lo").alias("lo"), F.to_json("u.hi").alias("hi"), F.to_json("u.own").alias("own"))
    return _edges_of_units(full, ["g", "lo", "hi"], "own", lambda s: alike_sets(s, percent))


def in_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node, rid, text_hash, root) of every document; root is a component's own id, null without words."""
    bounded_batches(docs)
    rows = stored(sketched(docs, width), "sketches")
    classes = rows.where("node IS NOT NULL").groupBy("node", "sketch", "n_shingles").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "rid")).alias("first"))
    classes = stored(few_files(classes.select("node", "sketch", "n_shingles", "copies", "first_id", F.col("first.rid").alias("rid"))), "classes")
    groups = components(coarse_edges(classes, percent / 100)).withColumnRenamed("root", "g")
    members = stored(few_files(classes.select("rid", "node", "n_shingles").join(groups, "node")), "groups")
    linked = components(exact_edges(docs, members, width, percent))
    found = classes.select("node", "copies", "first_id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_classes"))
    facts = join_small_groups(found.select("root", "node", "copies"), smallest, ["root"], "_classes", F.col("node")).select("node", "copies", "component_id", "root")
    out = join_small_groups(rows.drop("sketch"), stored(few_files(facts), "components"), ["node"], "copies", F.xxhash64("doc_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "node", "rid", "text_hash", "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node, rid) of every document."""
    return in_components(docs, width, percent).drop("text_hash", "root")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that with the smallest id, once; rows without words all stay.

    Ids may repeat with other texts, so a row is known by its id and the hash of its text. Of a component's texts with
    the smallest id, that of least hash stays.
    """
    found = in_components(docs, width, percent).where("kept")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("rid", "text_hash")).alias("first"))
    stay = first.select("first.*", F.lit(False).alias("_empty")).union(found.where("root IS NULL").select("rid", "text_hash", F.lit(True)).distinct())
    stay = stay.select(F.col("rid").alias("_id"), F.col("text_hash").alias("_hash"), "_empty")
    rows = docs.join(stay, (row_id("doc_id", "text") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    again = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("text"))
    return rows.withColumn("_copy", F.row_number().over(again)).where("_copy = 1 OR _empty").select(*docs.columns)
