import pytest
from pyspark.sql import functions as F

from snapscope.operators.diff import (
    diff_after, diff_page, diff_spec, diff_summary, filter_diff, first_rows, flat_diff, keyed_diff, parse_key_filter,
    repeated_versions,
    page_request,
)

SCHEMA = "id INT, valor STRING"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def summary(a, b, keys, **kw):
    return diff_summary(a, b, keys, **kw).first().asDict()


def frames(spark, a, b, schema=SCHEMA):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def test_identical(spark):
    rows = [(1, "a"), (2, "b"), (3, "c")]
    a, b = frames(spark, rows, rows)
    assert keyed_diff(a, b, ["id"]).rows.count() == 0
    s = summary(a, b, ["id"])
    assert (s["rows_a"], s["rows_b"], s["keys_total"], s["same_count"]) == (3, 3, 3, 3)


def test_basic(spark):
    a, b = frames(spark, [(1, "a"), (2, "b"), (4, "x")], [(1, "a"), (3, "c"), (4, "y")])
    got = rows_of(flat_diff(keyed_diff(a, b, ["id"]).rows))
    assert got == [
        (2, "removed", "b", None, ""),
        (3, "added", None, "c", ""),
        (4, "changed", "x", "y", "valor"),
    ]
    assert summary(a, b, ["id"]) == {
        "rows_a": 3, "rows_b": 3, "keys_total": 4, "same_count": 1,
        "added_count": 1, "removed_count": 1, "changed_count": 1,
    }


def test_composite(spark):
    schema = "rtuno INT, pntno INT, valor STRING"
    a, b = frames(
        spark, [(1, 10, "a"), (1, 20, "x"), (2, 10, "foo")], [(1, 10, "a"), (1, 20, "y"), (3, 10, "bar")], schema
    )
    got = rows_of(flat_diff(keyed_diff(a, b, ["rtuno", "pntno"]).rows))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 20, "changed"), (2, 10, "removed"), (3, 10, "added")]
    assert summary(a, b, ["rtuno", "pntno"])["same_count"] == 1


def test_limit_keeps_totals(spark):
    a, b = frames(spark, [(i, f"a-{i}") for i in range(10)], [(i, f"b-{i}") for i in range(10)])
    assert [r.key.id for r in first_rows(keyed_diff(a, b, ["id"]).rows, 3).collect()] == [0, 1, 2]
    page = diff_page(keyed_diff(a, b, ["id"]).rows, 1, 3)
    assert len(page.rows.collect()) == 3 and page.total_rows == 10 and page.total_pages == 4
    assert summary(a, b, ["id"])["changed_count"] == 10


def test_pages(spark):
    a, b = frames(spark, [(1, "x"), (2, "b"), (4, "z")], [(1, "y"), (3, "c"), (4, "z")])
    rows = keyed_diff(a, b, ["id"]).rows
    second = diff_page(rows, 2, 1)
    first_row = second.rows.first()
    assert (first_row.key.id, first_row.change_type) == (2, "removed")
    assert (second.total_rows, second.total_pages) == (3, 3)
    assert diff_page(rows, 99, 1).page == 3
    assert diff_page(rows.limit(0), 5, 10).page == 1
    assert [r.key.id for r in diff_after(rows, {"id": 1}, 10).collect()] == [2, 3]
    assert [r.key.id for r in diff_after(rows, None, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        diff_page(rows, 0)
    with pytest.raises(ValueError):
        page_request({"page_size": 1001})
    assert page_request({}) == {"page": 1, "page_size": 200} and page_request({"page": "2", "row_limit": "7"}) == {"page": 2, "page_size": 7}
    for bad in ({"page": -1}, {"page_size": 0}, {"page_size": "x"}, {"row_limit": 5000}):
        with pytest.raises(ValueError):
            page_request(bad)


def test_changed_column(spark):
    schema = "id INT, v1 STRING, v2 STRING"
    a, b = frames(spark, [(1, "a", "x"), (2, "c", "y")], [(1, "b", "x"), (2, "c", "z"), (3, "n", "m")], schema)
    d = keyed_diff(a, b, ["id"], changed_column="v1")
    assert [r[0] for r in rows_of(flat_diff(d.rows))] == [1, 3]
    again = filter_diff(keyed_diff(a, b, ["id"]).rows, changed_column="v1")
    assert sorted(r.key.id for r in again.collect()) == [1, 3]
    s = summary(a, b, ["id"])
    assert (s["changed_count"], s["added_count"]) == (2, 1)
    with pytest.raises(ValueError):
        keyed_diff(a, b, ["id"], changed_column="nope")


@pytest.mark.parametrize(
    "types", [["added"], ["removed"], ["changed"], ["added", "removed"], ["changed", "added"], ["removed", "changed"]]
)
def test_change_types_narrow_the_join(spark, types):
    a, b = frames(spark, [(1, "a"), (2, "b"), (4, "x"), (None, "n")], [(1, "a"), (3, "c"), (4, "y"), (None, "n")])
    whole = keyed_diff(a, b, ["id"]).rows
    some = keyed_diff(a, b, ["id"], change_types=types).rows
    assert rows_of(some) == rows_of(whole.filter(F.col("change_type").isin(types)))
    assert rows_of(filter_diff(whole, change_types=types)) == rows_of(some)


def test_null_keys_never_match(spark):
    a, b = frames(spark, [(None, "n"), (1, "a")], [(None, "n"), (1, "a")])
    got = rows_of(flat_diff(keyed_diff(a, b, ["id"]).rows))
    assert got == [(None, "added", None, "n", ""), (None, "removed", "n", None, "")]
    s = summary(a, b, ["id"])
    assert (s["keys_total"], s["added_count"], s["removed_count"], s["same_count"]) == (3, 1, 1, 1)


def test_repeated_keys_pair_like_a_join(spark):
    a, b = frames(spark, [(1, "a"), (1, "b"), (2, "q"), (2, "q")], [(1, "a"), (1, "c"), (1, "c")])
    got = rows_of(flat_diff(keyed_diff(a, b, ["id"]).rows))
    assert [r[1:4] for r in got].count(("changed", "a", "c")) == 2
    assert [r[1:4] for r in got].count(("changed", "b", "c")) == 2
    assert [r[1:4] for r in got].count(("removed", "q", None)) == 2
    s = summary(a, b, ["id"])
    assert (s["keys_total"], s["same_count"], s["changed_count"], s["removed_count"]) == (8, 1, 5, 2)


def test_hot_keys_are_dealt_out_and_complete(spark):
    rows_a = [(1, f"v{i % 5}") for i in range(40)] + [(2, f"w{i}") for i in range(60)] + [(3, "x")] * 50 + [(5, "k")]
    rows_b = [(1, f"v{i % 7}") for i in range(30)] + [(2, "w3")] + [(4, "z")] * 45 + [(5, "l")]
    a, b = frames(spark, rows_a, rows_b)
    whole = rows_of(keyed_diff(a, b, ["id"], unique_keys=True).rows)
    for hot_rows in (1, 20, 1000):
        assert rows_of(keyed_diff(a, b, ["id"], hot_rows=hot_rows).rows) == whole
    versions = {(r.version.valor): (r.rows_a, r.rows_b) for r in repeated_versions(a, b, ["id"]).filter("key.id = 1").collect()}
    n_a, n_b = sum(x for x, _ in versions.values()), sum(y for _, y in versions.values())
    assert (n_a, n_b) == (40, 30)
    plain = keyed_diff(a, b, ["id"]).rows
    assert n_a * n_b - sum(x * y for x, y in versions.values()) == plain.filter("key.id = 1").count()
    assert summary(a, b, ["id"])["changed_count"] == plain.filter("change_type = 'changed'").count()
    for types in (["added"], ["removed"], ["changed"], ["changed", "removed"], ["changed", "added"]):
        some = keyed_diff(a, b, ["id"], change_types=types, hot_rows=20).rows
        assert rows_of(some) == rows_of(plain.filter(F.col("change_type").isin(types)))


def test_odd_names(spark):
    a = spark.createDataFrame([(1, "a"), (2, "x")], "`key id` INT, `value-name` STRING")
    b = spark.createDataFrame([(1, "a"), (2, "y")], "`key id` INT, `value-name` STRING")
    assert [r.changed_columns for r in keyed_diff(a, b, ["key id"]).rows.collect()] == [["value-name"]]


def test_mirror_and_no_compare_columns(spark):
    a, b = frames(spark, [(1, "a"), (2, "b"), (4, "x")], [(1, "a"), (3, "c"), (4, "y")])
    there, back = summary(a, b, ["id"]), summary(b, a, ["id"])
    assert there["added_count"] == back["removed_count"] and there["changed_count"] == back["changed_count"]
    only_keys = keyed_diff(a, b, ["id"], compare=[])
    assert sorted(r.change_type for r in only_keys.rows.select("change_type").collect()) == ["added", "removed"]


def test_types_may_differ(spark):
    a = spark.createDataFrame([(1, "7"), (2, "x")], "id INT, v STRING")
    b = spark.createDataFrame([(1, 7), (2, 9)], "id BIGINT, v INT")
    assert [r.key.id for r in keyed_diff(a, b, ["id"]).rows.collect()] == [2]


def test_maps_are_compared(spark):
    a = spark.createDataFrame([(1, {"x": 1, "y": 2})], "id INT, m MAP<STRING,INT>")
    b = spark.createDataFrame([(1, {"y": 2, "x": 1})], "id INT, m MAP<STRING,INT>")
    assert keyed_diff(a, b, ["id"]).rows.count() == 0


def test_bad_arguments(spark):
    a, b = frames(spark, [(1, "a")], [(1, "a")])
    for keys, compare in (([], None), (["id", "id"], None), (["nope"], None), (["id"], ["valor", "valor"]), (["id"], ["z"])):
        with pytest.raises(ValueError):
            diff_spec(a, b, keys, compare)
    for types in ([], ["other"], [""]):
        with pytest.raises(ValueError):
            keyed_diff(a, b, ["id"], change_types=types)
    with pytest.raises(ValueError):
        keyed_diff(a, b, ["id"], key_filter={"valor": "a"})


def test_key_filter(spark):
    assert parse_key_filter("id=3, k='x'", ["id", "k"]) == {"id": "3", "k": "'x'"}
    for text in ("id", "=3", "id=", "other=1", "id=1,id=2"):
        with pytest.raises(ValueError):
            parse_key_filter(text, ["id"])
    a, b = frames(spark, [(1, "a"), (2, "b")], [(1, "b"), (2, "c")])
    assert [r.key.id for r in keyed_diff(a, b, ["id"], key_filter={"id": "2"}).rows.collect()] == [2]
    assert keyed_diff(a, b, ["id"], key_filter={"id": "02"}).rows.count() == 0
    assert filter_diff(keyed_diff(a, b, ["id"]).rows, key_filter={"id": "1"}).count() == 1


def test_bucketed_versions_need_no_shuffle(spark, tmp_path):
    from snapscope.sources.ingest import write_bucketed

    a, b = frames(spark, [(i, "a") for i in range(20)], [(i, "b") for i in range(5, 25)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("version_a", a), ("version_b", b)):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            write_bucketed(df, name, ["id"], 4)
        rows = keyed_diff(spark.table("version_a"), spark.table("version_b"), ["id"], unique_keys=True).rows
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("version_a", "version_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_values_of_different_types_are_compared_by_value(spark):
    def changes(left, right):
        a, b = (spark.sql(f"SELECT stack({len(v)}, {', '.join(f'{i}, {x}' for i, x in enumerate(v))}) AS (id, v)") for v in (left, right))
        return sorted(r.key.id for r in keyed_diff(a, b, ["id"]).rows.collect())

    assert changes(["DATE'2024-01-01'", "DATE'2024-01-01'"], ["TIMESTAMP'2024-01-01 00:00:00'", "TIMESTAMP'2024-01-01 00:00:01'"]) == [1]
    assert changes(["true", "false", "true"], ["1", "0", "2"]) == [2]
    assert changes(["5", "5", "-3", "7", "0"], ["'5.0'", "'5.5'", "' -03 '", "'x'", "'.0'"]) == [1, 3]
    assert changes(["5.0D", "0.25D", "1D"], ["'5'", "'.25'", "'1e0'"]) == []
    assert changes(["9007199254740993L", "9007199254740992L", "5L", "5L"], ["9007199254740992D", "9007199254740992D", "double('inf')", "1e300D"]) == [0, 2, 3]
    assert changes(["CAST(5.10 AS DECIMAL(10,2))", "CAST(0.50 AS DECIMAL(10,2))"], ["'5.1'", "'.5'"]) == []


def test_keys_of_different_types_match_exactly(spark):
    a = spark.sql("SELECT 9007199254740993L AS id, 1 AS v UNION ALL SELECT 4L, 1")
    b = spark.sql("SELECT 9007199254740992D AS id, 1 AS v UNION ALL SELECT 4D, 2")
    assert sorted(r.change_type for r in keyed_diff(a, b, ["id"]).rows.collect()) == ["added", "changed", "removed"]


def test_walk_meets_every_row_once(spark):
    a, b = frames(spark, [(2, "a"), (2, "a"), (2, "b"), (None, "n"), (None, "n"), (1, "x"), (3, None)], [(2, "c"), (3, "z"), (None, None), (4, "q")])
    rows = keyed_diff(a, b, ["id"]).rows
    seen, last = [], None
    while page := diff_after(rows, last, 2).collect():
        seen += page
        last = page[-1]
    assert rows_of(rows) == sorted([tuple(r)[:-1] for r in seen], key=str) or len(seen) == rows.count()
    assert len(seen) == rows.count() == 9
