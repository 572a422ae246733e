import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions import names, numbers, text
from snapscope.functions.dates import date_in_name
from snapscope.functions.serial import canonical_row, flatten_nested, row_json
from snapscope.functions.similarity import common_subsequence_length, with_token_set_ratio
from snapscope.functions.text import normalize_query


def values(spark, data, build, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i INT, v {kind}")
    return [r.x for r in df.orderBy("i").select(build(F.col("v")).alias("x")).collect()]


def test_normalize(spark):
    raw = ["Ação-Média_42!", "  A  b\tc ", None, "ŒUVRE é ñ", "x²½", "日本 が", "İstanbul", "áb", "don't"]
    want = ["acao media 42", "a b c", "", "œuvre e n", "x²½", "日本 か", "istanbul", "ab", "don t"]
    assert values(spark, raw, text.normalize_text) == want
    assert [normalize_query(r or "") for r in raw] == want


def test_parse_number(spark):
    raw = ["119", " 1 234,56 % ", "('119',)", "(119,)", "Decimal('1.5')", "1_000", "1d", "1,234,567", "1.234,5", "", "x",
           "1e3", "-.5", "inf", "-Infinity", "NaN", "True", None, "5."]
    got = values(spark, raw, numbers.parse_number)
    want = [119.0, 1234.56, 119.0, 119.0, 1.5, 1000.0, None, None, None, None, None, 1000.0, -0.5, math.inf, -math.inf, "nan",
            None, None, 5.0]
    assert ["nan" if isinstance(g, float) and math.isnan(g) else g for g in got] == want
    assert values(spark, [True], lambda c: numbers.parse_number(c, T.BooleanType()), "BOOLEAN") == [None]


def test_nice_number(spark):
    data = [119.0, 119.5, 0.1 + 0.2, 1e15, 123456.789012345, 1.5e-7, -2.0, 1234567890123.5, float("nan"), float("inf"), None, 0.00012]
    want = [("nan" if x is not None and math.isnan(x) else "inf" if x == math.inf else None if x is None
             else str(int(round(x))) if abs(x - round(x)) < 1e-12 else f"{x:.12g}") for x in data]
    assert values(spark, data, numbers.nice_number, "DOUBLE") == want


def test_clean_value(spark):
    assert values(spark, ["1,50", " abc ", "('x',)", "7.0", None], numbers.clean_value) == ["1.5", "abc", "x", "7", None]
    assert values(spark, [True, False], lambda c: numbers.clean_value(c, T.BooleanType()), "BOOLEAN") == ["1", "0"]


def test_display_value(spark):
    def show(kind, name=""):
        return lambda c: numbers.display_value(c, kind, name)

    raw = ["105.", "1.50", "7.000", "-0012.0", "abc ", None, "", "0.10"]
    assert values(spark, raw, show(T.StringType())) == ["105", "1.5", "7", "-12", "abc", "", "", "0.1"]
    assert values(spark, ["1.50", "105."], show(T.StringType(), "RTUNO")) == ["1.50", "105"]
    assert values(spark, [0.0, 2.5, 1 / 3, None], show(T.DoubleType()), "DOUBLE") == ["0", "2.5", "0.333333333333333", ""]
    assert values(spark, [Decimal("1.50"), Decimal("3.00")], show(T.DecimalType(10, 2)), "DECIMAL(10,2)") == ["1.5", "3"]
    assert values(spark, [True], show(T.BooleanType()), "BOOLEAN") == ["1"]


def test_small_number_texts(spark):
    assert values(spark, [1.0, 1.23456, None, float("nan")], numbers.short_number, "DOUBLE") == ["1", "1.235", "", ""]
    assert values(spark, [10, 2048, 3 * 1024**2, 5 * 1024**3, 5000 * 1024**3], numbers.size_text, "BIGINT") == [
        "10.0B", "2.0KB", "3.0MB", "5.0GB", "5000.0GB"]
    assert values(spark, ["1,5", "x", "inf", " 2 ", "1e2"], numbers.finite_number) == [1.5, None, None, 2.0, 100.0]


def test_text_bits(spark):
    assert values(spark, ["=1+1", " -x", "a;b", 'q"', "ok", None], text.semicolon_cell) == [
        "'=1+1", "' -x", '"a;b"', '"q"""', "ok", ""]
    assert values(spark, ['a"b', None], text.quoted_cell) == ['"a""b"', '""']
    assert values(spark, ["alphabet alpha", None], lambda c: text.highlight(c, ["alpha", "alphabet"])) == [
        "<mark>alphabet</mark> <mark>alpha</mark>", ""]
    assert values(spark, ["Sim", " off", "x", None], text.flag) == [True, False, None, None]
    assert values(spark, ["Table has NO DATA", "boom", None], text.is_no_data_message) == [True, False, False]
    assert values(spark, ["x" * 100], text.short_value) == ['"' + "x" * 76 + "..."]
    assert values(spark, ["a\"b", None], text.json_text) == ['"a\\"b"', "null"]


@pytest.mark.parametrize("name,rule,want", [
    ("x 2026-02-01.parquet", "loose", "2026-02-01"), ("db20260201", "loose", "2026-02-01"), ("2026_ 02_01", "loose", "2026-02-01"),
    ("2026-13-40", "loose", None), ("2026-02-01_a", "prefix", "2026-02-01"), ("a_2026-02-01", "prefix", None),
    ("01-02-2026", "any", "2026-02-01"), ("2026_02_01", "any", "2026-02-01"), ("01022026", "any", "2026-02-01"),
    ("20260201", "any", "2026-02-01"), ("2026-13-40", "any", None), ("31112026", "any", None),
    ("01_02_2026", "separated", "2026-02-01"), ("01-02_2026", "separated", None),
])
def test_dates(spark, name, rule, want):
    got = values(spark, [name], lambda c: date_in_name(c, rule).cast("string"))
    assert got == [want]


def test_rows_as_json(spark):
    df = spark.sql("SELECT 1 AS i, CAST(2.50 AS DECIMAL(5,2)) AS d, TIMESTAMP'2024-01-02 03:04:05' AS t, "
                   "DATE'2024-01-02' AS dt, X'6162' AS b, CAST(NULL AS STRING) AS n, true AS f, 1.5D AS x")
    assert df.select(row_json(df)).first()[0] == (
        '{"i":1,"d":2.5,"t":"2024-01-02T03:04:05","dt":"2024-01-02","b":"ab","n":null,"f":true,"x":1.5}')
    assert df.select(canonical_row(df)).first()[0] == (
        '{"i":"1","d":"2.50","t":"2024-01-02 03:04:05","dt":"2024-01-02","b":"6162","n":null,"f":"1","x":"1.5"}')


def test_flatten(spark):
    df = spark.sql("SELECT named_struct('b', array(2,3), 'a', 1) AS s, X'0102' AS b, map('z', 1, 'a', 2) AS m, array(1,2) AS l")
    assert tuple(flatten_nested(df).first()) == ('{"a":1,"b":[2,3]}', "0102", '{"a":2,"z":1}', "[1,2]")


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_similarity(spark):
    for a, b in [("abc", "axbyc"), ("", "x"), ("kitten", "sitting"), ("aaaa", "aa"), ("motor", "tumor or")]:
        assert common_subsequence_length(a, b) == lcs(a, b)

    def score(query, content):
        df = spark.createDataFrame([(content,)], "t STRING")
        return with_token_set_ratio(df, query.split(), "t").first().ratio

    assert score("alpha", "alpha beta") == 100.0
    assert score("alpha", "") == 0.0
    assert score("abc", "abd") == pytest.approx(100 * (1 - 2 / 6))
    # Shared "fuzzy": leftovers "was" / "wuzzy bear", compared by subsequence and against the shared part.
    d1, d2, s = "was", "bear wuzzy", 5
    l1, l2 = s + 1 + len(d1), s + 1 + len(d2)
    r0 = 100 * (1 - (len(d1) + len(d2) - 2 * lcs(d1, d2)) / (l1 + l2))
    want = max(r0, 100 * (1 - (1 + len(d1)) / (s + l1)), 100 * (1 - (1 + len(d2)) / (s + l2)))
    assert score("fuzzy was", "fuzzy wuzzy bear") == pytest.approx(want)


def test_names(spark):
    assert names.safe_table_name("1 a-b") == "T_1_a_b"
    assert names.user_tables([" items ", "items", "", "_FULLTEXT", "MSysX", "sqlite_y"]) == ["items"]
    assert names.display_order(spark, ["note", "ITEMNB", "x_id", "name"]) == ["ITEMNB", "x_id", "name", "note"]
    catalog = names.column_catalog(spark, {"T": ["PNT-NAM", "STACON", "zzz"], "U": ["h.w"]}).collect()
    assert [(r.table_name, r.column_group, r.is_wide) for r in catalog] == [
        ("T", "IDENTIFICACAO", True), ("T", "STATUS", False), ("T", "OUTROS", False), ("U", "LOCAL", False)]
    assert names.quoted("a`b") == "`a``b`"
    with pytest.raises(ValueError):
        names.known_name("ID", ["id"])
    with pytest.raises(ValueError):
        names.reject_case_clashes(["Id", "id"])
