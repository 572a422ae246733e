"""Offsets by id: rows are moved once, and stand in the order of their ids whatever these are."""

import pytest
from pyspark.sql import functions as F
from snapscope.operators import text_index as ix

from tests.test_stored_index import plan


def test_offsets_by_id_move_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ix, "settled", lambda _: pytest.fail("rows are stored"))
    index = ix.index_rows("t", spark.range(300)).unionByName(ix.index_rows("u", spark.range(40)))
    index = index.withColumn("copies", F.when(F.col("pk_value") == "7", 3).otherwise(1).cast("bigint")).select("table_name", "row_id", "copies")
    odd = spark.createDataFrame([("t", i, 2) for i in ("", "9Z", "a!", "a:0", "ag", "ffffg", "G", "g", "0", "\u00e9", "A\nb", "00fF")], index.schema)
    both = index.unionByName(odd).repartition(5)
    found = ix.with_row_offset(both, [])
    got = found.collect()
    rows, expected, at = sorted(both.collect()), [], {}
    for r in rows:
        expected.append((*r, at.get(r.table_name, 0)))
        at[r.table_name] = expected[-1][3] + r.copies
    assert sorted(map(tuple, got)) == expected and found.columns == ["table_name", "row_id", "copies", "row_offset"]
    assert "rangepartitioning" not in plan(found)


def test_rows_are_sent_once_for_both_readers(spark):
    index = ix.folded(ix.index_rows("t", spark.range(500))).select("table_name", "row_id", "copies").repartition(3)
    found = ix.with_row_offset(index, [])
    found.collect()
    assert "ReusedExchange" in plan(found)


@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_ranges_are_in_the_order_of_texts(spark, ranges):
    texts = ["", "!", "0", "00", "0000", "0001", "00g", "09", "0:", "0a", "0f", "0g", "1", "9", "9fff", "9ffff", "9g", ":", "Z", "a", "a000", "ab", "ffff", "fffg", "g", "\u00e9", "\U00020000"]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", ix._range_of(F.col("t"), ranges).alias("r"))
    found = [r.r for r in frame.orderBy("t").collect()]
    assert found == sorted(found) and min(found) == 0 and max(found) == ranges - 1
