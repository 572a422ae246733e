from pyspark.sql import functions as F
from snapscope.llm import common


def test_hot_keys_get_their_facts_in_every_part(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k, 0 if k < 300 else k, None if k % 7 else 1) for k in range(400)], "id long, key long, other long")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key < 350")
    got = common.join_small_groups(rows, facts, ["key"], "n", F.col("id")).collect()
    assert len(got) == 400 and all(r.top == (299 if r.key == 0 else r.key if r.key < 350 else None) for r in got)
    assert common.join_small_groups(rows, facts.limit(0), ["key"], "n", F.col("id")).count() == 400
