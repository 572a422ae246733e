"""Rows of a stored index that came from one place name their file; only the others have places."""

import os

from pyspark.sql import functions as F
from snapscope.operators import index_upkeep as up
from snapscope.operators import text_index as ix

from tests.test_stored_index import facts


def test_only_repeated_rows_have_places(spark, tmp_path):
    source, path = {"a": f"{tmp_path}/in/a"}, f"{tmp_path}/ix"

    def add(*rows):
        spark.createDataFrame(rows, "id INT, txt STRING").coalesce(1).write.mode("append").parquet(source["a"])
        up.update_index(spark, source, path)

    def fresh():
        return facts(ix.folded(ix.index_rows("a", spark.read.parquet(source["a"]))))

    def live_places():
        part = up._parts(up._latest(up.read_log(spark, path)))
        return sorted(r.copies for r in up._places(spark, path, part).collect())

    add((1, "x"), (1, "x"), (2, "y"), (3, "z"))
    assert live_places() == [2]
    add((2, "y"), (4, "w"), (4, "w"), (4, "w"))
    assert live_places() == [2, 3] and facts(up.current_index(spark, path)) == fresh()
    up.compact_index(spark, path)
    assert live_places() == [1, 1, 2, 3] and facts(up.current_index(spark, path)) == fresh()
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(up._parts(up._latest(up.read_log(spark, path)))))
    assert {r.pk_value: r.file_key is None for r in rows.collect()} == {"1": True, "2": True, "3": False, "4": True}
    # What came from the first file goes, by its places and by the files that rows name.
    first = min((f for f in os.listdir(source["a"]) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{source['a']}/{f}"))
    os.remove(f"{source['a']}/{first}")
    up.update_index(spark, source, path)
    assert facts(up.current_index(spark, path)) == fresh()
    up.compact_index(spark, path)
    assert facts(up.current_index(spark, path)) == fresh() and live_places() == [1, 3]


def test_texts_are_counted_by_hashes(spark, monkeypatch):
    index = ix.build_index({"t": spark.sql("SELECT id % 7 AS id, 'X' AS txt FROM range(40)"), "u": spark.range(30), "v": spark.range(0)})
    index = index.unionByName(spark.createDataFrame([("w", None, None, "1", None, "{}", 2), ("w", None, None, "2", "", "{}", 1)], ix.INDEX_SCHEMA))
    expected = index.groupBy("table_name").agg(F.count("*").alias("row_count"), F.sum("copies").alias("copies"), F.count_distinct("content_norm").alias("texts"))
    for sent in (0, 3, 100):
        monkeypatch.setattr(ix, "REPEATED_SENT", sent)
        got = ix.text_counts(index)
        assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
