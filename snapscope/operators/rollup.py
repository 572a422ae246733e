"""Profiles of many snapshots rolled up into one: pooled moments, global value counts, global modes.

Inputs are profile rows (`profile(..., by=[snapshot])`) and top-value rows of the same snapshots, so
the work here is proportional to the number of profiles, not to the data behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapscope.functions.names import col


def global_counts(top_rows: DataFrame, snapshot: str) -> DataFrame:
    """Per (coluna, valor): occurrences over all snapshots and the number of snapshots that list it."""
    per_snapshot = top_rows.groupBy("coluna", "valor", col(snapshot)).agg(F.sum("contagem").alias("n"))
    return per_snapshot.groupBy("coluna", "valor").agg(
        F.sum("n").alias("count_total"), F.count("*").alias("files_count")
    )


def pooled_moments(profiles: DataFrame) -> DataFrame:
    """Per column: summed coverage, commonest type, exact pooled mean and variance, global extremes.

    mean = sum(n mean) / sum(n); variance = sum(n (variance + (mean_i - mean)^2)) / sum(n). The second
    pass needs the pooled mean, which is joined back (one row per column).
    """
    n = F.col("value_count").cast("double")
    sums = profiles.groupBy("coluna").agg(
        F.sum("linhas_lidas").alias("linhas_lidas_sum"),
        F.sum("nulos").alias("nulos_sum"),
        F.sum("linhas_nao_nulas").alias("nao_nulos_sum"),
        F.sum("value_count").alias("value_count_global"),
        F.coalesce(F.sum(n * F.col("mean")) / F.nullif(F.sum(n), F.lit(0.0)), F.lit(0.0)).alias("mean_global"),
        F.min("min").alias("min_global"),
        F.max("max").alias("max_global"),
    )
    votes = profiles.filter("tipo_aparente <> ''").groupBy("coluna", "tipo_aparente").agg(F.count("*").alias("votes"))
    kinds = votes.groupBy("coluna").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), F.col("tipo_aparente").alias("kind"))).getField("kind").alias("kind")
    )
    deviations = (
        profiles.join(sums.select("coluna", "mean_global"), "coluna")
        .groupBy("coluna")
        .agg(F.sum(n * (F.col("variancia") + F.pow(F.col("mean") - F.col("mean_global"), 2))).alias("m2"))
    )
    variance = F.when(F.col("value_count_global") > 0, F.col("m2") / F.col("value_count_global")).otherwise(0.0)
    std = F.sqrt(F.col("var_pop_global"))
    return (
        sums.join(deviations, "coluna")
        .join(kinds, "coluna", "left")
        .withColumn("var_pop_global", variance)
        .select(
            "coluna",
            F.coalesce("kind", F.lit("")).alias("tipo_aparente_mais_comum"),
            "linhas_lidas_sum",
            "nulos_sum",
            "nao_nulos_sum",
            _percent(F.col("nulos_sum"), F.col("linhas_lidas_sum")).alias("nulos_pct_global"),
            "value_count_global",
            "mean_global",
            "var_pop_global",
            std.alias("std_pop_global"),
            F.when(F.col("mean_global") != 0, std / F.col("mean_global")).otherwise(0.0).alias("cv_global"),
            "min_global",
            "max_global",
        )
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def global_summary(profiles: DataFrame, counts: DataFrame, exact_distinct: DataFrame | None = None) -> DataFrame:
    """One row per column, fewest NULLs first.

    `distinct_global` counts the values that survived into some top list; pass
    `exact_distinct(coluna, distinct_global)` to replace that lower bound.
    """
    modes = counts.groupBy("coluna").agg(
        F.min(
            F.struct(
                (-F.col("count_total")).alias("c"), (-F.col("files_count")).alias("f"), F.col("valor").alias("valor")
            )
        ).alias("best"),
        F.count_distinct("valor").alias("listed"),
    )
    moments = pooled_moments(profiles)
    joined = moments.join(modes, "coluna", "full_outer")
    distinct = F.coalesce("listed", F.lit(0))
    if exact_distinct is not None:
        joined = joined.join(exact_distinct.select("coluna", "distinct_global"), "coluna", "left")
        distinct = F.coalesce("distinct_global", distinct)

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)).alias(name)

    return joined.select(
        "coluna",
        F.coalesce("tipo_aparente_mais_comum", F.lit("")).alias("tipo_aparente"),
        distinct.alias("distinct_global"),
        zero("nulos_pct_global"),
        zero("mean_global"),
        zero("std_pop_global"),
        zero("var_pop_global"),
        zero("cv_global"),
        F.coalesce("best.valor", F.lit("")).alias("valor_mais_frequente_global"),
        F.coalesce(_percent(-F.col("best.c"), F.col("nao_nulos_sum")), F.lit(0.0)).alias(
            "pct_valor_mais_freq_nao_nulos_global"
        ),
    ).orderBy(F.col("nulos_pct_global").asc(), F.col("distinct_global").desc(), F.col("coluna"))


def global_top(counts: DataFrame, top: int = 50) -> DataFrame:
    """Per column the values listed by most snapshots, then by occurrences; two-step so no column sits in one task."""
    best = [F.col("files_count").desc(), F.col("count_total").desc(), F.col("valor").asc()]
    spread = counts.withColumn("bucket", F.pmod(F.xxhash64("valor"), F.lit(64)))
    first = (
        spread.withColumn("r", F.row_number().over(Window.partitionBy("coluna", "bucket").orderBy(*best)))
        .filter(F.col("r") <= top)
        .drop("r", "bucket")
    )
    ranked = first.withColumn("posicao", F.row_number().over(Window.partitionBy("coluna").orderBy(*best)))
    return ranked.filter(F.col("posicao") <= top)


def write_global_counts(counts: DataFrame, path: str) -> None:
    """Replace the stored counts; (coluna, valor) is unique by construction."""
    counts.select("coluna", "valor", "count_total", "files_count").write.mode("overwrite").parquet(path)
