import pytest
from pyspark.sql import functions as F

from snapscope.operators import track as t
from snapscope.operators.filters import equals_value, matches, parse_conditions


@pytest.fixture(scope="module")
def world(spark):
    catalog = spark.createDataFrame([(0, "s1"), (1, "s2"), (2, "s3"), (3, "s4")], "order_idx INT, snapshot STRING")
    points = spark.createDataFrame(
        [("s2", 1, 2304, "aux unidad"), ("s3", 1, 2304, "other"), ("s3", 1, 2304, "aux"), ("s4", 2, 2305, "x")],
        "snapshot STRING, RTUNO INT, PNTNO INT, PNTNAM STRING")
    people = spark.createDataFrame([("s1", 1, "A10", "foo"), ("s1", 2, "B20", "bar"), ("s2", 3, "2304", "baz")], "snapshot STRING, id INT, code STRING, label STRING")
    return catalog, {"people": people, "POINTS": points}


def test_parse_conditions():
    assert parse_conditions('A=1,B=2.5, C="x",D=\'7\',E=abc,"F=u,05"') == [
        ("A", 1), ("B", 2.5), ("C", "x"), ("D", "7"), ("E", "abc"), ("F", "u,05")]
    assert parse_conditions("") == []
    with pytest.raises(ValueError):
        parse_conditions("A")


@pytest.mark.parametrize("text,want", [
    ("i=5", [0]), ("i=5.0", [0]), ("s=5", [0, 2]), ("s='5'", [0]), ("s=x", [1]), ("i=x", []), ("i='5'", [0]), ("d=0.5", [1]), ("S=5,i=5", [0]),
    ("i=99999999999999999999", []),
])
def test_typed_equality(spark, text, want):
    df = spark.createDataFrame([(0, 5, "5", None), (1, 6, "x", 0.5), (2, None, "5.0", 1.0)], "r INT, i INT, s STRING, d DOUBLE")
    assert [r.r for r in df.filter(matches(df, parse_conditions(text))).orderBy("r").collect()] == want
    assert df.filter(equals_value(df.i, df.schema["i"].dataType, None)).count() == 1


def test_find_record(world):
    catalog, tables = world
    rows = {r.snapshot: r for r in t.find_record(catalog, tables, parse_conditions("RTUNO=1,PNTNO=2304")).collect()}
    assert [rows[s].found for s in ("s1", "s2", "s3", "s4")] == [False, True, True, False]
    assert rows["s2"].table_name == "POINTS" and rows["s2"].sample == '{"RTUNO":1,"PNTNO":2304,"PNTNAM":"aux unidad"}'
    assert rows["s3"].match_count == 2 and rows["s1"].error is None
    shown = t.find_record(catalog, tables, parse_conditions("PNTNO=2304"), show=["pntnam"]).filter("snapshot = 's2'").first()
    assert shown.sample == '{"PNTNAM":"aux unidad"}'


def test_broken_tables_are_errors_and_later_ones_win(spark, world, tmp_path):
    catalog, tables = world
    broken = tables["POINTS"].withColumn("PNTNO", F.when(F.col("snapshot") == "s3", F.raise_error(F.lit("torn page")).cast("int")).otherwise(F.col("PNTNO")))
    given = {"gone": lambda: spark.read.parquet(f"{tmp_path}/nothing"), "torn": broken, "people": tables["people"], "POINTS": tables["POINTS"]}
    rows = {r.snapshot: r for r in t.find_record_past_errors(catalog, given, parse_conditions("RTUNO=1,PNTNO=2304")).collect()}
    assert (rows["s2"].table_name, rows["s2"].error) == ("torn", None)
    assert (rows["s3"].table_name, rows["s3"].match_count, rows["s3"].error) == ("POINTS", 2, None)
    assert rows["s1"].error == "gone: PATH_NOT_FOUND" and not rows["s4"].found
    del given["POINTS"]
    rows = {r.snapshot: r for r in t.find_record_past_errors(catalog, given, parse_conditions("RTUNO=1,PNTNO=2304")).collect()}
    assert rows["s3"].error.startswith("gone: PATH_NOT_FOUND; torn: ") and rows["s2"].found
    whole = t.find_record_past_errors(catalog, tables, parse_conditions("PNTNO=2304"), show=["pntnam"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, t.find_record(catalog, tables, parse_conditions("PNTNO=2304"), show=["pntnam"]).collect()))
    assert {r.error for r in t.find_record_past_errors(catalog, tables, [("nope", 1)]).collect()} == {t.NO_COLUMN}


def test_first_table_wins_and_errors(spark, world):
    catalog, tables = world
    both = {"b": tables["POINTS"], "a": tables["POINTS"]}
    assert {r.table_name for r in t.find_record(catalog, both, [("RTUNO", 1)]).filter("found").collect()} == {"b"}
    assert {r.error for r in t.find_record(catalog, tables, [("nope", 1)]).collect()} == {t.NO_COLUMN}
    assert {r.error for r in t.find_record(catalog, tables, [("id", 1)], table="gone").collect()} == {t.NO_TABLE}
    presence = spark.createDataFrame([("s2", "POINTS", ["RTUNO", "PNTNO"]), ("s3", "POINTS", ["rtuno"])], "snapshot STRING, table_name STRING, columns ARRAY<STRING>")
    rows = t.find_record(catalog, tables, parse_conditions("RTUNO=9,PNTNO=9"), table="POINTS", presence=presence).collect()
    assert {r.snapshot: r.error for r in rows} == {"s1": t.NO_TABLE, "s2": None, "s3": t.NO_COLUMN, "s4": t.NO_TABLE}
    with pytest.raises(ValueError):
        t.find_record(catalog, tables, [])
    errors = spark.createDataFrame([("s1", i, f"t{i}", "bad") for i in range(5)], "snapshot STRING, place INT, table_name STRING, message STRING")
    assert t.joined_errors(errors, "snapshot").first().error == "; ".join(f"t{i}: bad" for i in range(5))
    assert t.joined_errors(errors, "snapshot", 2).first().error == "t0: bad; t1: bad"


def test_limits(world):
    catalog, tables = world
    assert tuple(t.track_limits(catalog, 1).first()) == (4, 1, True)
    assert t.find_record(catalog, tables, [("RTUNO", 1)], max_snapshots=2).count() == 2


@pytest.mark.parametrize("text,want", [
    ("RTUNO=1", (2, 4, "s2", "s1", "s3", "s4", "appeared", "disappeared")),
    ("RTUNO=2", (1, 4, "s4", "s3", "s4", None, "appeared", "still_present")),
    ("RTUNO=77", (0, 4, None, None, None, None, "never", "never")),
])
def test_timeline(world, text, want):
    catalog, tables = world
    assert tuple(t.presence_timeline(t.find_record(catalog, tables, parse_conditions(text))).first()) == want


def test_find_value(world):
    catalog, tables = world
    rows = {r.snapshot: r for r in t.find_value(catalog, tables, "B20").collect()}
    assert (rows["s1"].found, rows["s1"].table_name, rows["s1"].column_name) == (True, "people", "code") and not rows["s2"].found
    rows = {r.snapshot: r for r in t.find_value(catalog, tables, "2304", all_columns=True).collect()}
    assert (rows["s2"].table_name, rows["s2"].column_name) == ("people", "code") and rows["s3"].column_name == "PNTNO"
    assert t.find_value(catalog, tables, "aux", all_columns=True, table_like="poin").filter("found").first().column_name == "PNTNAM"
    assert t.find_value(catalog, tables, "x", table_like="none").filter("found").count() == 0


def test_ledger_and_summary(spark, world):
    catalog, tables = world
    files = spark.createDataFrame([("s2", "/x/s2", 10, "ab")], "snapshot STRING, path STRING, size_kb INT, quick_sha1 STRING").selectExpr("*", "current_timestamp() mtime")
    track = t.find_record(catalog, tables, [("RTUNO", 1)])
    row = t.track_ledger(track, files).filter("order_idx = 1").first()
    assert (row.path, row.found, row.table, row["count"]) == ("/x/s2", True, "POINTS", 1)
    assert tuple(t.found_summary(track).first()) == (2, 4)
