"""What a stored index moves and keeps: rows that occur once stay, ids are computed, lists hold the places of many rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from snapscope.operators import posting_lists as pl
from snapscope.operators import search as q
from snapscope.operators import text_index as ix


def facts(index):
    return sorted((r.table_name, r.row_id, r.content_norm, r.row_json, r.copies) for r in index.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [0, 1, 100])
def test_only_repeated_rows_are_moved(spark, monkeypatch, sent):
    monkeypatch.setattr(ix, "REPEATED_SENT", sent)
    rows = [(i, f"name {i}") for i in range(40)]
    once = ix.index_rows("t", spark.createDataFrame(rows, "id INT, name STRING"))
    assert "Exchange" not in plan(ix.folded_apart(once)) and facts(ix.folded_apart(once)) == facts(ix.folded(once))
    twice = ix.index_rows("t", spark.createDataFrame([*rows, *rows[:2], rows[0], (None, None), (None, None)], "id INT, name STRING"))
    assert facts(ix.folded_apart(twice)) == facts(ix.folded(twice))
    assert ("BroadcastHashJoin" in plan(ix.folded_apart(twice))) == (sent >= 3)


def test_lists_hold_places_of_many_rows(spark, tmp_path):
    texts = [(i, f"valve {i}") for i in range(300)] + [(300, "\U00020000\U00020001\U00020002\U00020003 ab"), (301, None), (302, "")]
    index = ix.index_rows("t", spark.createDataFrame(texts, "id INT, txt STRING").repartition(2))
    stored = pl.write_postings(index, str(tmp_path), part_rows=50)
    counts = {r.gram: r.n for r in stored.counts.collect()}
    every = [{w[k : k + 3] for w in r.content_norm.split(" ") for k in range(len(w) - 2)} for r in index.collect()]
    assert counts == {g: sum(g in x for x in every) for x in every for g in x}
    assert counts["val"] == 300 and stored.lists.count() < sum(counts.values()) / 2
    assert "row_id" not in spark.read.parquet(f"{tmp_path}/rows").columns
    assert facts(stored.rows) == facts(index)
    found = q.candidates(stored, q.SearchArgs("\U00020001\U00020002\U00020003")).select("pk_value").collect()
    assert [r.pk_value for r in found] == ["300"] and pl.candidate_keys(stored, ["\U00020001\U00020002\U00020003"]).count() == 1


def test_one_text_in_many_blocks_and_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pl, "BLOCK", 4)
    index = ix.index_rows("t", spark.createDataFrame([(i, "abc " * (i % 7)) for i in range(60)], "id INT, txt STRING").coalesce(1))
    keys, texts = zip(*[(i, r.content_norm) for i, r in enumerate(index.collect())])
    made = pl._lists(np.array(keys), list(texts)).to_pylist()
    places = sorted(x["block"] * 4 + p for x in made if x["gram"] == "abc" for p in x["places"])
    assert places == [k for k in keys if "abc" in texts[k]] and all(0 <= p < 4 for x in made for p in x["places"])


def test_lists_are_written_where_rows_are_read_as_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pl, "SIGNS", 50)
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 3 * pl.BLOCK, 400), [0, 127, 128, 16383, 16384, pl.BLOCK - 1, pl.BLOCK]]))
    texts = [" ".join(["abc"] * (k % 2) + ["bcd"] * (k % 5 == 0) + [f"x{k}y"]) for k in keys.tolist()]
    mixed = rng.permutation(len(keys))
    batch = pa.RecordBatch.from_arrays([pa.array(keys[mixed]), pa.array([texts[i] for i in mixed])], names=["row_key", "content_norm"])
    read = [(r["gram"], r["row_key"]) for b in pl._keys_of(pl._lists_of(iter([batch]))) for r in b.to_pylist()]
    assert sorted(read) == sorted({(w[i : i + 3], k) for k, t in zip(keys.tolist(), texts) for w in t.split() for i in range(len(w) - 2)})
    index = ix.index_rows("t", spark.createDataFrame([(i, f"valve {i}") for i in range(300)], "id INT, txt STRING").repartition(3))
    stored = pl.write_postings(index, str(tmp_path), part_rows=50)
    assert "Exchange" not in plan(pl.lists_of_rows(stored.rows)) and "places" not in stored.lists.columns
    assert stored.lists.where("gram = 'val'").agg({"n": "sum"}).first()[0] == 300
    found = q.candidates(stored, q.SearchArgs("valve 17")).select("pk_value").collect()
    assert len(found) == 300 and pl.candidate_keys(stored, ["217"]).count() == 1


def test_a_task_deals_its_blocks_over_few_open_parts_without_a_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pl, "OPEN_PARTS", 3)
    index = ix.index_rows("t", spark.createDataFrame([(i, f"valve {i}") for i in range(300)], "id INT, txt STRING").coalesce(1))
    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, *rest, **more):
        seen.append((path, spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(self, path, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    stored = pl.write_postings(index, str(tmp_path), part_rows=20)
    assert int(dict(seen)[f"{tmp_path}/rows"]) > stored.parts and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert stored.parts == 3 and facts(stored.rows) == facts(index)
    files = stored.rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("row_key").alias("low"), F.max("row_key").alias("high")).collect()
    assert len(files) == 15 and all(f.n == 20 and f.high - f.low == 19 for f in files)
    assert pl.candidate_keys(stored, ["217"]).select("part").first() == stored.rows.where("pk_value = '217'").select("part").first()
    assert [r.pk_value for r in pl.narrowed(stored, ["217"]).collect()] == ["217"]


def test_a_text_that_its_row_tells_is_not_stored_and_every_other_is(spark, tmp_path):
    kind = "id INT, txt STRING, at TIMESTAMP, ratio DOUBLE, price DECIMAL(9,2), deep STRUCT<a: STRING>"
    told = [
        (1, 'a "quoted, " line\nÉlan \\n {"k": "T"}', "2024-01-31 08:00:00", 1.5e9, None, None), (2, None, "2024-01-31 08:00:01.5001", None, None, None),
        (3, "null,", "2024-01-31 00:00:00.17", 0.25, None, None), (4, "abc,\\" * 30_000, None, -0.0, None, None), (5, "a\u0301b\u0001c \U00020000x", None, 7.0, None, None),
    ]
    kept = [(6, "2024-01-31T08:00:00", None, None, None, None), (7, "other", None, None, "5.10", None), (8, "x", None, None, None, ("deep one",))]
    made = spark.createDataFrame(told + kept, kind.replace("TIMESTAMP", "STRING").replace("DECIMAL(9,2)", "STRING"))
    made = made.withColumn("at", F.col("at").cast("timestamp")).withColumn("price", F.col("price").cast("decimal(9,2)"))
    plain = ix.index_rows("t", made.select("id", "txt", "at", "ratio")).unionByName(ix.index_rows("u", made.where("id > 6")))
    free = spark.createDataFrame([("f", None, "9", "free", "not in the row", "{}", 1), ("f", None, "10", "bare", "", None, 1)], ix.INDEX_SCHEMA)
    index = plain.unionByName(free)
    stored = pl.write_postings(index, str(tmp_path), part_rows=3)
    texts = {(r.table_name, r.pk_value): r.content_norm for r in index.collect()}
    assert {(r.table_name, r.pk_value): r.content_norm for r in stored.rows.collect()} == texts
    on_disk = {(r.table_name, r.pk_value): r.content_norm for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert {k for k, text in on_disk.items() if text is not None} == {("t", "6"), ("u", "7"), ("u", "8"), ("f", "9")}
    # Without keys to send, the rows are read.
    for index_read in (stored, pl.read_postings(spark, str(tmp_path), keys_sent=0)):
        for asked in ("elan", "row", "ab", "00", "txt", "t08", "null"):
            found = q.candidates(index_read, q.SearchArgs(asked)).select("table_name", "pk_value").collect()
            assert sorted(map(tuple, found)) == sorted(k for k, text in texts.items() if asked in text), asked


def test_a_ranked_search_keeps_no_candidates_on_disk_unless_a_limit_bounds_them(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(["valve"] * (i % 4 > 0) + ["pump"] * (i % 3) + [f"x{i % 11}"])) for i in range(200)]
    index = ix.index_rows("t", spark.createDataFrame(rows, "id INT, txt STRING"))
    stored, kept = pl.write_postings(index, str(tmp_path), part_rows=50), []
    monkeypatch.setattr(q, "settled", lambda df: kept.append(df) or df)
    for args, n in [(q.SearchArgs("valve pump", per_table=7), 0), (q.SearchArgs("valve x3", per_table=500, min_score=40), 0), (q.SearchArgs("pump", candidate_limit=30), 1)]:
        got = q.search(stored, args).collect()
        assert got and got == q.search(index, args, stored=False).select(*q.search(stored, args).columns).collect()
        assert len(kept) == 2 * n
        kept.clear()


def test_the_count_that_tells_repeated_rows_leaves_no_shuffle_files(spark):
    rows = ix.index_rows("t", spark.range(50_000).repartition(3))
    # Where a local session keeps its blocks.
    folders = [f.toString() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    once, more = ix.told_apart(rows)
    assert not shuffled() - before and once.count() == 50_000 and more.count() == 0
