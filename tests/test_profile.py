import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snapscope.operators import profile as p
from snapscope.operators import rollup


def make(spark, n=400):
    rng = random.Random(7)
    rows = [(i, f"2024-01-{1 + i % 3:02d}", rng.choice(["1,5", "2", "('2',)", "x", None, " 2.0 "]), rng.choice([None, rng.gauss(1e6, 3)]), i % 2 == 0)
            for i in range(n)]
    return spark.createDataFrame(rows, "i INT, day STRING, t STRING, d DOUBLE, f BOOLEAN"), rows


CLEAN = {"1,5": "1.5", "2": "2", "('2',)": "2", "x": "x", " 2.0 ": "2"}


def test_profile_against_brute_force(spark):
    df, rows = make(spark)
    got = {r.coluna: r for r in p.profile(df).collect()}
    texts = [CLEAN[r[2]] for r in rows if r[2] is not None]
    numbers = [float(t) for t in texts if t != "x"]
    t = got["t"]
    assert (t.linhas_lidas, t.nulos, t.value_count) == (len(rows), len(rows) - len(texts), len(numbers))
    assert t.tipo_aparente == ("numérico" if len(numbers) >= 0.6 * len(texts) else "texto")
    assert t.distinct_est == 3 and not t.distinct_cap_excedido
    assert t.mean == pytest.approx(statistics.fmean(numbers)) and t.variancia == pytest.approx(statistics.pvariance(numbers))
    assert (t.top1_val, t.top1_count) == Counter(texts).most_common(1)[0]
    assert t.top1_pct_of_column == round(100 * t.top1_count / len(texts), 3) and t.top1_domina
    d = [r[3] for r in rows if r[3] is not None]
    assert got["d"].variancia_amostral == pytest.approx(statistics.variance(d), rel=1e-6)
    assert got["d"].coef_variacao == pytest.approx(statistics.pstdev(d) / statistics.fmean(d), rel=1e-6)
    assert got["d"].median_approx == statistics.median(d)
    assert (got["f"].tipo_aparente, got["f"].top1_val) == ("texto", "0") and got["day"].tipo_aparente == "texto"
    capped = p.profile(df, distinct_cap=2, columns=["t"]).first()
    assert (capped.distinct_est, capped.distinct_cap_excedido) == (3, True)


def test_exact_quantiles(spark):
    df, rows = make(spark)
    got = {r.coluna: r for r in p.profile(df.repartition(3), quantiles="exact").collect()}
    d = [r[3] for r in rows if r[3] is not None]
    want = statistics.quantiles(d, n=4, method="inclusive")
    assert [got["d"].q25_approx, got["d"].median_approx, got["d"].q75_approx] == pytest.approx(want, rel=1e-12)
    assert got["day"].median_approx is None
    one = spark.createDataFrame([("5",), ("7",), ("7",)], "v STRING")
    assert p.exact_quantiles(p.cells(one)).first()[1:] == (6.0, 7.0, 7.0)


def test_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v STRING")
    row = p.profile(df).first()
    assert (row.tipo_aparente, row.nulos, row.distinct_est, row.top1_val, row.top1_count, row.top1_pct_of_column, row.mean) == ("", 2, 0, "", 0, None, 0.0)


def test_top_values_and_others(spark):
    rows = [(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"]]
    df = spark.createDataFrame(rows, "v STRING")
    top = p.top_values(p.value_counts(p.cells(df)), 2)
    assert [(r.valor, r.contagem) for r in top.orderBy("posicao").collect()] == [("a", 5), ("b", 3)]
    full = p.with_others(top, p.profile(df))
    assert [(r.valor, r.contagem) for r in full.orderBy("posicao").collect()] == [("a", 5), ("b", 3), ("OUTROS", 4)]
    everything = p.top_values(p.value_counts(p.cells(df)), 10)
    assert p.with_others(everything, p.profile(df)).count() == 4


def test_bands(spark):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "v STRING")
    assert p.profile_bands(p.profile(df)).first().faixa == "baixa"
    assert p.profile_bands(p.profile(df.limit(20))).first().faixa == "media"


def test_rollup_equals_direct_moments(spark):
    df, rows = make(spark)
    parts = p.profile(df, by=["day"], columns=["t", "d"])
    pooled = {r.coluna: r for r in rollup.pooled_moments(parts).collect()}
    d = [r[3] for r in rows if r[3] is not None]
    assert pooled["d"].mean_global == pytest.approx(statistics.fmean(d))
    assert pooled["d"].var_pop_global == pytest.approx(statistics.pvariance(d), rel=1e-6)
    assert (pooled["d"].min_global, pooled["d"].max_global) == (min(d), max(d))
    counts = rollup.global_counts(p.top_values(p.value_counts(p.cells(df, ["day"], ["t"]), ["day"]), 2, ["day"]), "day")
    best = {r.valor: (r.count_total, r.files_count) for r in counts.collect()}
    texts = Counter(CLEAN[r[2]] for r in rows if r[2] is not None)
    assert best["2"] == (texts["2"], 3)
    summary = {r.coluna: r for r in rollup.global_summary(parts, counts).collect()}
    assert summary["t"].valor_mais_frequente_global == "2" and summary["d"].valor_mais_frequente_global == ""
    assert rollup.global_top(counts, 1).first().valor == "2"


def test_store_replaces(spark, tmp_path):
    counts = spark.createDataFrame([("c", "v", 3, 1)], "coluna STRING, valor STRING, count_total INT, files_count INT")
    for _ in range(2):
        rollup.write_global_counts(counts, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g").count() == 1
    assert spark.read.parquet(f"{tmp_path}/g").filter(F.col("valor") == "v").count() == 1
