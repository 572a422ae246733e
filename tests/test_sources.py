import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from snapscope.operators import browse, validate
from snapscope.operators.diff import keyed_diff
from snapscope.plans import report
from snapscope.sources import catalog, export, ingest
from tests.test_signals import NEW, OLD, SCHEMA


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("snaps"))
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING")
    people.write.parquet(f"{base}/2024-01-05_DB/people.parquet")
    people.limit(1).write.option("header", True).csv(f"{base}/2024-02-05_DB/people.csv")
    people.withColumn("extra", F.lit(1)).write.json(f"{base}/nested/2024-01-20_DB/people.json")
    people.write.orc(f"{base}/nested/2024-01-20_DB/msys_x.orc")
    with open(f"{base}/notes.txt", "w") as fh:
        fh.write("not data")
    return base


def test_catalog(spark, folder):
    files = catalog.file_catalog(spark, folder)
    snaps = catalog.in_date_order(catalog.snapshots(files)).orderBy("order_idx").collect()
    assert [(s.snapshot, s.format) for s in snaps] == [("2024-01-05_DB", "parquet"), ("nested/2024-01-20_DB", "json"), ("2024-02-05_DB", "csv")]
    assert snaps[1].tables == ["msys_x", "people"] and snaps[0].snapshot_date == dt.date(2024, 1, 5)
    newest = [r.snapshot for r in catalog.newest_first(catalog.snapshots(files)).collect()]
    assert newest[0] == "2024-02-05_DB"
    assert {r.snapshot for r in catalog.suggest_two(catalog.snapshots(files), "parquet").collect()} == set(newest[:2])
    assert catalog.filter_catalog(catalog.snapshots(files), " CSV").count() == 1
    with pytest.raises(ValueError):
        catalog.suggest_two(catalog.snapshots(files).limit(1))
    assert list(catalog.read_snapshot(spark, files, "nested/2024-01-20_DB")) == ["people"]
    whole = catalog.read_across_snapshots(spark, folder)["people"]
    assert set(whole.columns) == {"snapshot", "id", "name", "extra"}
    counts = {r.snapshot: r["count"] for r in whole.groupBy("snapshot").count().collect()}
    assert counts == {"2024-01-05_DB": 2, "2024-02-05_DB": 1, "nested/2024-01-20_DB": 2}
    assert catalog.format_of("x.CSV") == "csv" and catalog.format_of("x.mdb") is None
    tables = {(r.snapshot, r.table_name): r.table_path for r in files.collect()}
    assert tables[("2024-01-05_DB", "people")].endswith("2024-01-05_DB/people.parquet")
    assert {r.folder for r in catalog.folders_with_data(files).collect()} >= {"2024-01-05_DB/people.parquet"}


def test_partitioned_table_is_one_table(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 2 AS half").write.partitionBy("half").parquet(f"{tmp_path}/s 2024-05-06/t.parquet")
    files = catalog.file_catalog(spark, str(tmp_path))
    assert {(r.snapshot, r.table_name) for r in files.collect()} == {("s 2024-05-06", "t")}
    assert catalog.read_snapshot(spark, files, "s 2024-05-06")["t"].filter("half = 1").count() == 2
    with pytest.raises(ValueError):
        catalog.two_different("/a", "/a/")


def test_pick_two_prefers_a_format(spark):
    rows = [("2024-03-01", "csv"), ("2024-02-01", "parquet"), ("2024-01-01", "parquet"), (None, "parquet")]
    snaps = spark.createDataFrame([(f"s{i}", d, k) for i, (d, k) in enumerate(rows)], "snapshot STRING, d STRING, format STRING").selectExpr(
        "snapshot", "format", "CAST(d AS DATE) snapshot_date", "TIMESTAMP'2024-01-01' mtime")
    assert [r.snapshot for r in catalog.suggest_two(snaps).collect()] == ["s1", "s2"]
    assert [r.snapshot for r in catalog.suggest_two(snaps.filter("snapshot IN ('s0', 's1')")).collect()] == ["s0", "s1"]


def test_fingerprint(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 70000)
    (tmp_path / "b.bin").write_bytes(b"")
    got = {os.path.basename(r.path): r.quick_sha1 for r in catalog.fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": hashlib.sha1(b"x" * 70000).hexdigest()}
    quick = catalog.fingerprints(spark, str(tmp_path), catalog.HASHED_BYTES).first().quick_sha1
    assert quick == hashlib.sha1(b"x" * 65536).hexdigest()


def test_one_scan_over_snapshots(spark, tmp_path):
    base = str(tmp_path)
    for i, columns in enumerate((["id"], ["id", "path"], ["id"])):
        spark.range(3).selectExpr("id", "'p' AS path").select(*columns).write.parquet(f"{base}/a b+c{i}/t.parquet")
    whole = catalog.read_across_snapshots(spark, base)["t"]
    assert {r.snapshot: r["count"] for r in whole.groupBy("snapshot").count().collect()} == {f"a b+c{i}": 3 for i in range(3)}
    assert whole.filter("path = 'p'").count() == 3
    spark.range(2).selectExpr("'x' AS id").write.parquet(f"{base}/clash/t.parquet")
    assert dict(catalog.read_across_snapshots(spark, base)["t"].dtypes)["id"] == "string"


def test_run_report(spark, tmp_path):
    items = spark.sql("SELECT * FROM VALUES (1, 'mdb', true, true, 2, 2, 1.5D, 0.5D), (2, NULL, true, false, 2, 1, 1.0D, 0.0D) "
                      "AS t(id, source_suffix, load_ok, copy_ok, load_tables, copy_tables, load_seconds, copy_seconds)")
    checked = ingest.reliability(items)
    totals = ingest.run_report(checked)
    assert tuple(totals.first()) == (2, 1, 1, 2, 1, 2.5, 0.5)
    export.write_run_report(checked, totals, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/items_json").count() == 2
    status = {r.metric: r.value for r in ingest.manifest_status(items).collect()}
    assert status == {"total_sources": 2, "load_ok": 2, "copy_ok": 1, "suffix:mdb": 1, "suffix:(none)": 1}


def test_union_versions(spark):
    a, b = spark.sql("SELECT 1 AS i, 'x' AS s"), spark.sql("SELECT 'q' AS i, 2 AS extra")
    assert sorted(map(tuple, catalog.union_versions([a, b]).collect())) == [("1", "x", None), ("q", None, 2)]


def test_ingest(spark, tmp_path):
    store = str(tmp_path)
    t = spark.createDataFrame([(1, "a")], "id INT, name STRING")
    broken = spark.range(1).select(F.raise_error(F.lit("broken header")).alias("x"))
    empty = spark.range(1).select(F.raise_error(F.lit("table has no data")).alias("x"))
    day = dt.date(2024, 1, 5)
    load = ingest.ingest_snapshot(spark, "db", {"t": t}, store, day)
    assert (load.ok, load.message, load.tables[0].status) == (True, "converted", "loaded")
    again = ingest.ingest_snapshot(spark, "db", {"t": t.union(t)}, store, day)
    assert again.tables[0].status == "kept"
    ledger = ingest.read_ledger(spark, f"{store}/_ledger").collect()
    assert [(r.table_name, r.row_count, r.file_date) for r in ledger] == [("t_20240105", 1, day)]
    later = ingest.ingest_snapshot(spark, "db", {"t": t.union(t)}, store, dt.date(2024, 2, 5))
    assert later.ok and spark.read.parquet(f"{store}/t").groupBy("snapshot_date").count().count() == 2
    bad = ingest.ingest_snapshot(spark, "db", {"x": broken, "e": empty}, store, day)
    assert not bad.ok and "x: " in bad.message and "1/2" in bad.message
    assert [t.status for t in bad.tables] == ["failed", "no_data"]
    assert ingest.ingest_snapshot(spark, "db", {"e": empty}, store, day).message == "all tables without data"
    assert ingest.ingest_snapshot(spark, "db", {"t2": t, "x": broken}, store, day, allow_skips=True).message == "converted (skipped=1)"
    text = ingest.ingest_snapshot(spark, "db", {"1 odd-name": t.withColumnRenamed("name", "my name")}, store, day, variant="text")
    assert text.ok and spark.read.parquet(f"{store}/T_1_odd_name").drop("snapshot_date").dtypes == [("id", "string"), ("my_name", "string")]


def test_ragged_and_mixed(spark):
    df = spark.sql("SELECT array(1,2) AS a, array('x') AS b, 7 AS c, CAST(NULL AS ARRAY<INT>) AS d")
    assert [tuple(r) for r in ingest.rows_from_lists(df).collect()] == [(1, "x", 7, None), (2, None, None, None)]
    mixed = spark.createDataFrame([('{"a": 1, "_p": 2}',), ('["x", 5]',), ('"word"',), ("[]",), ("3",)], "j STRING")
    fields = sorted(r.field for r in ingest.json_fields(mixed, "j").collect())
    assert fields == ["a", "col_0", "col_1", "value"]
    got = [tuple(r) for r in ingest.records_from_json(mixed, "j", fields).collect()]
    assert got == [("1", None, None, None), (None, "x", "5", None), (None, None, None, "word"), (None,) * 4, (None, None, None, "3")]


def test_type_classes(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, X'00' AS b, DATE'2024-01-01' AS t, 'x' AS s, true AS f")
    kinds = lambda target: [ingest.type_class(f.dataType, target) for f in df.schema.fields]
    assert kinds("four") == ["INTEGER", "REAL", "BLOB", "TEXT", "TEXT", "TEXT"]
    assert kinds("six") == ["BIGINT", "DOUBLE", "BLOB", "TIMESTAMP", "VARCHAR", "BOOLEAN"]
    assert dict(ingest.coerced(df).dtypes)["f"] == "string"


def test_copy_and_validate(spark, tmp_path):
    t1 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id INT, name STRING")
    ingest.copy_tables({"T1": t1}, str(tmp_path))
    copy = spark.read.parquet(f"{tmp_path}/T1")
    row = validate.validate_copy(spark, {"T1": t1}, {"T1": copy}).first()
    assert (row.status, row.rows_source, row.rows_copy, row.content_ok, row.issue) == ("ok", 3, 3, True, None)
    assert len(row.sample_hash_source) == 64 and row.sample_hash_source == row.sample_hash_copy
    changed = t1.replace("b", "x")
    row = validate.validate_copy(spark, {"T1": t1}, {"T1": changed}).first()
    assert row.status == "failed" and row.first_mismatch is not None and not row.content_ok
    twice = t1.union(t1.limit(1))
    other = t1.union(t1.filter("id = 2"))
    assert validate.row_differences(twice, other).count() == 2
    checked = validate.validate_copy(spark, {"A": t1, "T1": t1}, {"T1": t1.limit(2), "Z": t1})
    assert {r.table_name: r.status for r in checked.collect()} == {"A": "failed", "T1": "failed", "Z": "failed"}
    assert validate.verdict(checked).first().status == "failed"
    assert validate.table_sets(["a", "b"], ["b", "c"]) == {"missing": ["a"], "extra": ["c"]}


def test_sampled_rows_are_those_of_smallest_digest(spark):
    df = spark.range(50).selectExpr("id", "id % 7 AS v").union(spark.sql("SELECT 3L, 3L"))
    rows = validate.sampled_rows(df.repartition(4)).orderBy("position").collect()
    every = sorted(r.digest for r in validate.digests(df).collect())
    assert [r.digest for r in rows] == every[:9] and [r.position for r in rows] == list(range(9))
    assert all(hashlib.sha256(r.canonical.encode()).hexdigest() == r.digest for r in rows)


def test_browse(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alphabet"), (4, None), (5, r"a\lp%")], "id INT, note STRING")
    page = browse.table_page(df, "note", "ALP", "id", "DESC", limit=2)
    assert [r.id for r in page.rows.collect()] == [3, 1] and page.total == 2
    assert [r.id for r in browse.table_rows(df, sort="note").collect()] == [5, 1, 3, 2, 4]
    assert browse.contains_filter(df, "note", "\\l").count() == 1 and browse.contains_filter(df, None, "x").count() == 5
    for bad in ({"limit": 0}, {"offset": -1}, {"sort": "nope"}, {"column": "nope", "q": "x"}):
        with pytest.raises(ValueError):
            browse.table_rows(df, **bad)
    asked = browse.page_args({"col": "note", "q": "ALP", "sort": "id", "order": "desc", "limit": "2"})
    assert [r.id for r in browse.table_page(df, **vars(asked)).rows.collect()] == [3, 1]
    assert browse.page_args({}) == browse.PageArgs(None, None, None, "ASC", 50, 0)
    for bad in ({"limit": 0}, {"limit": 1001}, {"limit": "x"}, {"offset": -1}):
        with pytest.raises(ValueError):
            browse.page_args(bad)
    texts = spark.createDataFrame([(v,) for v in ["b10", "B2", "10", "9,5", "a", None]], "v STRING")
    assert [r.v for r in texts.orderBy(*browse.natural_order(F.col("v"))).collect()] == ["9,5", "10", None, "a", "B2", "b10"]


def test_report_and_export(spark, tmp_path):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    rows = keyed_diff(old, new, ["id"]).rows
    assert [r.key.id for r in browse.sort_report(rows, "score", "desc").collect()] == [3, 2, 4, 5]
    assert [r.key.id for r in browse.report_filter(rows, {"name": "beta"}).collect()] == [2]
    detail = report.table_detail(rows, "items", old.columns, ["id"])
    assert detail.schema["old"].dataType.names == ["name", "score", "stacon", "note"]
    two = report.two_lines(detail).filter("key_text = 'id=2'").orderBy("line_no").collect()
    assert [(r.type_label, r.side, r.line_values) for r in two] == [
        ("modificado", "velho", "name=beta-old | score=40 | stacon=OK | note=legacy"),
        ("modificado", "novo", "name=beta-new | score=55.5 | stacon=ALARM | note=")]
    assert report.text_lines(report.two_lines(detail)).count() == 8
    assert export.diff_csv_header(rows) == "K_id;type;A_name;B_name;A_score;B_score;A_stacon;B_stacon;A_note;B_note"
    line = export.diff_csv_lines(rows.filter("key.id = 2")).first().line
    assert line == "2;changed;beta-old;beta-new;40.0;55.5;OK;ALARM;legacy;"
    export.write_diff_csv(rows, f"{tmp_path}/d")
    back = spark.read.options(header=True, sep=";").csv(f"{tmp_path}/d")
    assert back.columns == export.diff_csv_header(rows).split(";") and back.count() == 4
    export.write_table_csv(old, f"{tmp_path}/t")
    assert spark.read.options(header=True).csv(f"{tmp_path}/t").count() == 4
    export.write_diff_report(rows, report.classified_summary(old, new, ["id"]), f"{tmp_path}/r", {"table": "items"})
    assert spark.read.json(f"{tmp_path}/r/rows").count() == 4 and spark.read.json(f"{tmp_path}/r/summary").first().source.table == "items"


def test_visible_columns():
    assert report.visible_columns("T", ["K", "C1", "C2", "C3", "C4", "C5"], ["K"], ["C3", "C4"]) == ["C3", "C4"]
    assert report.visible_columns("T", ["K", "C1", "C2", "C3", "C4", "C5"], ["K"], []) == ["C1", "C2", "C3", "C4"]
    assert report.forced_columns("X_SOANLG", ["scale", "RTUNO", "note"]) == ["RTUNO", "scale"]
    assert report.forced_columns("X_SOSTAT", ["scale", "PNT_NO"]) == ["PNT_NO"]


def test_compare_databases(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    result = report.compare_databases(spark, {"items": old, "same": old}, {"items": new, "same": old})
    assert result.keys == {"items": ["id"]} and result.summary.first().diff_tables == 1
    assert result.details["items"].count() == 4 and [r.table_name for r in result.changed.collect()] == ["items"]


def test_csv_loads_lose_nothing(spark, tmp_path):
    base = tmp_path / "land" / "db_2024-01-01"
    base.mkdir(parents=True)
    lines = [f"{i},{i * 2}" for i in range(3000)]
    lines[1500] = "1500,X1"
    lines[7] = "7,14,extra"
    lines[8] = "8"
    (base / "t.csv").write_text("id,v\n" + "\n".join(lines) + "\n")
    files = catalog.file_catalog(spark, str(tmp_path / "land"))
    table = catalog.read_snapshot(spark, files, "db_2024-01-01")["t"]
    assert table.count() == len(table.collect()) == 3000 and dict(table.dtypes) == {"id": "int", "v": "string"}
    load = ingest.ingest_snapshot(spark, "s", catalog.read_snapshot(spark, files, "db_2024-01-01", rejects=True), str(tmp_path / "store"))
    assert load.ok and load.message == "converted (rejected lines=2)" and load.tables[0].row_count == 2998
    line = ingest.read_ledger(spark, str(tmp_path / "store/_ledger")).first()
    assert (line.row_count, line.rejected_count) == (2998, 2)
    assert sorted(r._rejected_line for r in spark.read.parquet(str(tmp_path / "store/_rejected/t")).collect()) == ["7,14,extra", "8"]


def test_tables_in_two_formats_and_names_that_collide(spark, tmp_path):
    base = tmp_path / "land" / "db_2024-01-01"
    base.mkdir(parents=True)
    spark.range(7).selectExpr("CAST(id AS INT) AS id").write.parquet(str(base / "t.parquet"))
    (base / "t.csv").write_text("id\n8000000000\n")
    table = catalog.read_snapshot(spark, catalog.file_catalog(spark, str(tmp_path / "land")), "db_2024-01-01")["t"]
    assert table.count() == 8 and table.dtypes == [("id", "bigint")]
    two = {"a-b": spark.range(3), "a_b": spark.range(4)}
    load = ingest.ingest_snapshot(spark, "s", two, str(tmp_path / "store"), variant="text")
    names = ingest.stored_names("s", two, "text")
    assert len(set(names.values())) == 2 and sorted(t.row_count for t in load.tables) == [3, 4]
    assert sorted(spark.read.parquet(str(tmp_path / "store" / n)).count() for n in names.values()) == [3, 4]
