"""The stored index in step with its files: what is read, what is taken off, and what a broken update leaves."""

import pytest
from snapscope.operators import index_upkeep as up
from snapscope.operators import text_index as ix
from snapscope.streaming.index_stream import follow_folder, stream_index


@pytest.fixture
def folder(spark, tmp_path):
    """Five files of ten rows; row 0 is in all of them, twice in the last."""
    for k in range(5):
        rows = [(i if i == 0 else 10 * k + i, f"name {i if i == 0 else 10 * k + i}") for i in range(10)] + ([(0, "name 0")] if k == 4 else [])
        spark.createDataFrame(rows, "id INT, name STRING").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/al pha")
    return tmp_path


def facts(index):
    return sorted((r.table_name, r.row_id, r.content_norm, r.copies) for r in index.collect())


def fresh(spark, folder):
    return facts(ix.folded(ix.build_index({"al pha": spark.read.parquet(f"{folder}/in/al pha")})))


def test_only_new_files_are_read_and_gone_ones_taken_off(spark, folder):
    import os

    source, path = {"al pha": f"{folder}/in/al pha"}, f"{folder}/ix"
    assert up.current_index(spark, path).count() == 0 and up.indexed_files(spark, path).count() == 0
    first = up.update_index(spark, source, path)
    assert (len(first.read), first.gone, first.version) == (5, 0, 1)
    assert facts(up.current_index(spark, path)) == fresh(spark, folder)
    assert up.update_index(spark, source, path) == up.Update((), 0, None)

    spark.createDataFrame([(0, "name 0"), (99, "new")], "id INT, name STRING").coalesce(1).write.mode("append").parquet(source["al pha"])
    second = up.update_index(spark, source, path)
    assert len(second.read) == 1 and second.version == 2
    assert facts(up.current_index(spark, path)) == fresh(spark, folder)
    assert up.indexed_files(spark, path).count() == 6

    gone = sorted(f for f in os.listdir(source["al pha"]) if f.endswith(".parquet"))[:2]
    for name in gone:
        os.remove(f"{source['al pha']}/{name}")
    third = up.update_index(spark, source, path)
    assert (third.read, third.gone) == ((), 2)
    assert facts(up.current_index(spark, path)) == fresh(spark, folder)

    assert up.compact_index(spark, path) == 4 and up.compact_index(spark, path) is None
    one = up.current_index(spark, path)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert facts(one) == fresh(spark, folder)
    # A file that goes after the compaction can still be taken off.
    os.remove(f"{source['al pha']}/" + sorted(f for f in os.listdir(source["al pha"]) if f.endswith(".parquet"))[0])
    assert up.update_index(spark, source, path).gone == 1
    assert facts(up.current_index(spark, path)) == fresh(spark, folder)


def test_stream_and_updates_agree(spark, folder):
    source = f"{folder}/in/al pha"
    up.update_index(spark, {"al pha": source}, f"{folder}/ix")
    follow_folder(spark, source, "al pha", "id INT, name STRING", f"{folder}/st", f"{folder}/cp", files_per_batch=2).awaitTermination(120)
    assert facts(stream_index(spark, f"{folder}/st")) == facts(up.current_index(spark, f"{folder}/ix"))


def test_what_a_broken_update_leaves_is_not_read(spark, folder, monkeypatch):
    source, path = {"al pha": f"{folder}/in/al pha"}, f"{folder}/ix"

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(up, "_publish", fails)
        with pytest.raises(RuntimeError):
            up.update_index(spark, source, path)
    assert up.current_index(spark, path).count() == 0
    assert len(up.update_index(spark, source, path).read) == 5
    assert facts(up.current_index(spark, path)) == fresh(spark, folder)
    # A second publisher of a version that is taken is ignored as a whole.
    log = up.read_log(spark, path)
    up._part_line(spark, "other").select(*up.LINE).coalesce(1).write.parquet(f"{path}/log/v=1/attempt=zzz")
    assert up.read_log(spark, path).count() == log.count()


def test_folder_values_and_tables_that_go(spark, folder):
    for day in ("2024-01-01", "2024-01-02"):
        spark.createDataFrame([(1, "x")], "id INT, name STRING").write.parquet(f"{folder}/in/beta/day={day}")
    sources, path = {"al pha": f"{folder}/in/al pha", "beta": f"{folder}/in/beta"}, f"{folder}/ix"
    up.update_index(spark, sources, path)
    both = ix.folded(ix.build_index({n: spark.read.parquet(p) for n, p in sources.items()}))
    assert facts(up.current_index(spark, path)) == facts(both)
    assert up.update_index(spark, {"beta": sources["beta"]}, path).gone == 5
    assert {r.table_name for r in up.current_index(spark, path).collect()} == {"beta"}
    with pytest.raises(ValueError):
        up.update_index(spark, {}, path)
