"""What an update and a compaction of the stored index move."""

import os

from pyspark.sql import functions as F
from snapscope.operators import index_upkeep as up
from snapscope.operators import text_index as ix

from tests.test_stored_index import facts, plan


def test_an_update_moves_only_repeated_rows_and_a_compaction_only_tables_with_gone_files(spark, tmp_path):
    for name, rows in (("a", [(1, "x"), (1, "x"), (2, "y")]), ("b", [(1, "z"), (2, "z")])):
        spark.createDataFrame(rows, "id INT, txt STRING").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    spark.createDataFrame([(1, "x"), (3, "w")], "id INT, txt STRING").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/a")
    sources, path = {n: f"{tmp_path}/in/{n}" for n in "ab"}, f"{tmp_path}/ix"
    up.update_index(spark, {"a": sources["a"]}, path)
    up.update_index(spark, sources, path)
    log = up.read_log(spark, path)
    assert facts(up.current_index(spark, path)) == facts(ix.folded(ix.build_index({n: spark.read.parquet(p) for n, p in sources.items()})))
    assert "row_id" not in spark.read.parquet(f"{path}/rows").columns and log.count() == 5
    files = sorted(f for f in os.listdir(sources["a"]) if f.endswith(".parquet"))
    os.remove(f"{sources['a']}/{files[0]}")
    up.update_index(spark, sources, path)
    left = facts(ix.folded(ix.build_index({n: spark.read.parquet(p) for n, p in sources.items()})))
    assert facts(up.current_index(spark, path)) == left
    up.compact_index(spark, path)
    now = up.current_index(spark, path)
    assert facts(now) == left and "Exchange" not in plan(now)
    os.remove(f"{sources['a']}/{files[1]}")
    up.update_index(spark, sources, path)
    gone = up.current_index(spark, path)
    assert facts(gone) == [x for x in left if x[0] == "b"] and "Exchange" not in plan(gone.where(F.col("table_name") == "b"))
