"""An index of tables keeps the values of their rows; texts, JSON and ids are formed when rows are read."""

from datetime import datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from snapscope.functions.serial import iso_time
from snapscope.operators import posting_lists as pl
from snapscope.operators import search as q
from snapscope.operators import text_index as ix

from tests.test_stored_index import facts


@pytest.fixture(scope="module")
def tables(spark):
    kind = "part INT, row_key STRING, copies DOUBLE, at TIMESTAMP, day DATE, `a b.c` DECIMAL(9,2), flag BOOLEAN, raw BINARY, many ARRAY<FLOAT>"
    at = datetime(2024, 1, 31, 8, 0, 1, 500100)
    rows = [
        (1, "Élan valve", 0.25, at, at.date(), None, True, b"pump", [0.5, -0.0]), (2, None, None, None, None, None, None, None, None),
        (3, "Pump 3a\n{}", 1e-7, at.replace(microsecond=0), at.date(), Decimal(5), False, b"\xff\xc3", []), (2, None, None, None, None, None, None, None, None),
    ]
    plain = spark.createDataFrame([*rows, *rows[:1], *rows[:1]], kind)
    broken = spark.sql("SELECT 7 AS id, CAST(X'ff41' AS STRING) AS txt UNION ALL SELECT 7, '\ufffdA' UNION ALL SELECT 8, 'abcd'")
    deep = spark.createDataFrame([(1, ("deep valve",)), (1, ("deep valve",)), (2, None)], "id INT, deep STRUCT<a: STRING>")
    return {"plain": plain, "broken": broken, "deep": deep, "empty": plain.limit(0), "msys_own": plain}


@pytest.mark.parametrize("sent", [0, 1, 100])
def test_rows_are_formed_from_their_values(spark, tmp_path, tables, monkeypatch, sent):
    monkeypatch.setattr(ix, "REPEATED_SENT", sent)
    index = ix.folded(ix.build_index(tables))
    stored = pl.write_postings(tables, str(tmp_path), part_rows=2)
    assert facts(stored.rows) == facts(index) and {t.name for t in stored.tables} == {"plain", "broken", "empty"}
    values = spark.read.parquet(f"{tmp_path}/values/1")
    assert values.columns == [*[f"c{i}" for i in range(9)], "copies", "row_key", "part"] and values.count() == 3
    assert stored.rows.select("row_key").distinct().count() == stored.rows.count() == index.count()
    counts = {r.gram: r.n for r in stored.counts.collect()}
    every = [{w[k : k + 3] for w in r.content_norm.split(" ") for k in range(len(w) - 2)} for r in index.collect()]
    assert counts == {g: sum(g in x for x in every) for x in every for g in x}


def test_searches_over_values_find_what_is_in_index_rows(spark, tmp_path, tables):
    index = ix.folded(ix.build_index(tables))
    stored = pl.write_postings(tables, str(tmp_path), part_rows=2)
    texts = sorted((r.table_name, r.row_id, r.content_norm) for r in index.collect())
    for read in (stored, pl.read_postings(spark, str(tmp_path), keys_sent=0)):
        for asked in ("elan", "pump", "500", "5001", "tru", "alse", "0e", "e 7", "nan", "a", "valve pump", "2024 va"):
            for mode in ("any", "all"):
                both = any if mode == "any" else all
                found = q.candidates(read, q.SearchArgs(asked, token_mode=mode)).select("table_name", "row_id", "content_norm").collect()
                assert sorted(map(tuple, found)) == [x for x in texts if both(t in x[2] for t in asked.split())], (asked, mode)
        args = q.SearchArgs("valve pump", per_table=2)
        got = q.search(read, args).collect()
        assert got and got == q.search(index, args, stored=False).select(*q.search(read, args).columns).collect()


def test_times_stay_as_they_were_stored_in_every_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = spark.sql("SELECT explode(array(0L, 1500000L, 1698537600000000L, 1698541200000000L, 1711845000123000L)) AS us").select(F.timestamp_micros("us").alias("at"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        before = facts(ix.folded(ix.index_rows("t", times)))
        pl.write_postings({"t": times}, str(tmp_path))
        # These two have one text there, so they are one row.
        assert len(before) == 4 and {x[4] for x in before} == {1, 2}
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert facts(pl.read_postings(spark, str(tmp_path)).rows) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_text_of_a_time_is_its_form_in_json(spark):
    at = F.timestamp_micros("us")
    whole, exact = (F.date_format(at, f) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    times = spark.sql("SELECT explode(array(0L, -1L, 1500000L, 10L, -62135596800000001L, 253402300800000000L, NULL)) AS us")
    before = F.when(F.date_trunc("second", at) != at, exact).otherwise(whole)
    assert times.where(~before.eqNullSafe(iso_time(at))).count() == 0


@pytest.mark.parametrize("signs", [1, 40, 1 << 20])
def test_lists_of_plain_and_other_texts_as_they_are(monkeypatch, signs):
    monkeypatch.setattr(pl, "SIGNS", signs)
    rng = np.random.default_rng(3)
    letters = list("ab1 B-\n") + ["é", "\U00020000"]
    texts = ["".join(rng.choice(letters[: 7 if k % 3 else 9], rng.integers(0, 9))) for k in range(400)] + ["", "a", "ab", "abc"]
    # Texts with other signs come without capitals and marks.
    texts = [t if t.isascii() else " ".join(t.lower().replace("-", " ").split()) for t in texts]
    keys = np.sort(rng.choice(3 * pl.BLOCK, len(texts), replace=False))
    mixed = rng.permutation(len(texts))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[m]), pa.array([texts[i] for i in m])], names=["row_key", "content_norm"]) for m in np.array_split(mixed, 7)]
    made = [b for b in pl._lists_of(iter(batches))]
    read = [(r["gram"], r["row_key"]) for b in pl._keys_of(iter(made)) for r in b.to_pylist()]
    words = {(w[i : i + 3], k) for k, t in zip(keys.tolist(), texts) for w in t.lower().replace("-", " ").split() for i in range(len(w) - 2)}
    assert sorted(read) == sorted(words)
    # Batches are put together before they are cut.
    assert signs < 1 << 20 or len(made) == 2
