"""Column profiles: coverage, apparent type, moments, quantiles, distinct values, most frequent values.

All columns (and all snapshots) of a table are profiled together. The table is read as cells
`(column, number, cleaned text)`; two aggregations that combine before their shuffle do the rest:
one per column for coverage, moments and quantile sketches, one per (column, value) for frequencies.
The second one carries at most the distinct values, however often a single value occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.names import col
from snapscope.functions.numbers import as_text, digits_only, float_of, nice_number, unwrap
from snapscope.operators.positions import with_positions

# Labels and thresholds of the profile.
NUMERIC, TEXT, OTHERS = "numérico", "texto", "OUTROS"
NUMERIC_SHARE = 0.6
DOMINANT_PCT = 50.0
DISTINCT_CAP = 200_000
QUANTILES = [0.25, 0.5, 0.75]
SUMMARY_COLUMNS = [
    "coluna", "tipo_aparente", "linhas_lidas", "nulos", "linhas_nao_nulas", "distinct_est", "distinct_cap_excedido",
    "value_count", "mean", "M2", "variancia", "desvio_padrao_pop", "variancia_amostral", "desvio_padrao_amostral",
    "coef_variacao", "min", "q25_approx", "median_approx", "q75_approx", "max", "top1_val", "top1_count",
    "top1_pct_of_column", "top1_domina",
]


def cells(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None, mode: str = "clean") -> DataFrame:
    """A row per value: `by` columns, coluna, is_null, number, valor.

    mode 'clean' counts numbers in one spelling; 'raw' keeps the text of the value as stored. Columns
    are put under one another first and parsed afterwards, step by step, so the parsing is compiled
    once however many columns there are.
    """
    names = [c for c in (columns or df.columns) if c not in by]
    out = []
    for name in names:
        kind, value = df.schema[name].dataType, col(name)
        numeric = isinstance(kind, T.NumericType)
        parsed = isinstance(kind, (T.StringType, T.BinaryType))
        text = value.cast("int").cast("string") if isinstance(kind, T.BooleanType) and mode == "clean" else as_text(value, kind)
        out.append(
            F.struct(
                F.lit(name).alias("coluna"),
                value.isNull().alias("is_null"),
                F.lit(parsed).alias("parsed"),
                (value.cast("double") if numeric else F.lit(None).cast("double")).alias("typed"),
                (F.lit(None).cast("string") if numeric and mode == "clean" else text).alias("text"),
            )
        )
    keep = [col(c) for c in by]
    rows = df.select(*keep, F.explode(F.array(*out)).alias("cell")).select(*keep, "cell.*")
    kept = [*keep, "coluna", "is_null", "typed"]
    rows = rows.select(*kept, "text", "parsed", F.when(F.col("parsed"), unwrap(F.col("text"))).otherwise(F.col("text")).alias("bare"))
    # Only text with a digit, or one of the words inf and nan, can be a number.
    hopeful = F.col("parsed") & F.col("bare").rlike("(?i)[0-9]|inf|nan")
    rows = rows.select(*kept, "text", "bare", F.when(hopeful, digits_only(F.col("bare"))).alias("digits"))
    rows = rows.select(*kept, "text", "bare", F.coalesce("typed", float_of(F.col("digits"))).alias("number"))
    shown = F.col("text") if mode == "raw" else F.coalesce(nice_number(F.col("number")), F.col("bare"))
    return rows.select(*keep, "coluna", "is_null", "number", shown.alias("valor"))


def value_counts(cell_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each value per column."""
    return (
        cell_rows.filter(~F.col("is_null"))
        .groupBy(*[col(c) for c in by], "coluna", "valor")
        .agg(F.count("*").alias("contagem"))
    )


def top_values(counts: DataFrame, top: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The `top` most frequent values per column, ties by value, with their `posicao`.

    A column may have any number of distinct values, so it is cut down in two steps: the best of
    each bucket of values, then the best of those.
    """
    group = [*by, "coluna"]
    best = [F.col("contagem").desc(), F.col("valor").asc()]
    spread = counts.withColumn("bucket", F.pmod(F.xxhash64("valor"), F.lit(256)))
    in_bucket = Window.partitionBy(*[col(c) for c in group], "bucket").orderBy(*best)
    first = spread.withColumn("r", F.row_number().over(in_bucket)).filter(F.col("r") <= top).drop("r", "bucket")
    overall = Window.partitionBy(*[col(c) for c in group]).orderBy(*best)
    return first.withColumn("posicao", F.row_number().over(overall)).filter(F.col("posicao") <= top)


def _column_stats(cell_rows: DataFrame, by: Sequence[str], accuracy: int) -> DataFrame:
    number = F.when(~F.isnan("number"), F.col("number"))
    return cell_rows.groupBy(*[col(c) for c in by], "coluna").agg(
        F.count("*").alias("linhas_lidas"),
        F.count_if("is_null").alias("nulos"),
        F.count("number").alias("parsed"),
        F.count(number).alias("value_count"),
        F.avg(number).alias("mean"),
        F.var_pop(number).alias("variancia"),
        F.var_samp(number).alias("variancia_amostral"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.percentile_approx(number, QUANTILES, accuracy).alias("quantiles"),
    )


def exact_quantiles(cell_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles of the parsed numbers per column, interpolated between neighbours: q25, median, q75.

    Works on value counts and their positions, so it is exact at any size and no task sees a whole column.
    """
    group = [*by, "coluna"]
    keys = [col(c) for c in group]
    numbers = cell_rows.filter(F.col("number").isNotNull() & ~F.isnan("number"))
    counts = numbers.groupBy(*keys, "number").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = with_positions(counts, ["number"], group, "n").join(totals, group)
    first, last = F.col("position"), F.col("position") + F.col("n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col("number")))

    picked = []
    for i, share in enumerate(QUANTILES):
        rank = (F.col("total") - 1) * share
        picked += [at(F.floor(rank)).alias(f"lo{i}"), at(F.ceil(rank)).alias(f"hi{i}")]
    found = placed.groupBy(*keys, "total").agg(*picked)

    def between(i: int) -> Column:
        rank = (F.col("total") - 1) * QUANTILES[i]
        return F.col(f"lo{i}") + (rank - F.floor(rank)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))

    return found.select(*keys, between(0).alias("q25"), between(1).alias("median"), between(2).alias("q75"))


def profile(
    df: DataFrame,
    distinct_cap: int = DISTINCT_CAP,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    mode: str = "clean",
    accuracy: int = 10_000,
    quantiles: str = "exact",
) -> DataFrame:
    """One row per column (and per `by` group, e.g. a snapshot date), in the order of `SUMMARY_COLUMNS`.

    `distinct_est` is exact; the flag tells that it exceeds `distinct_cap`. Quartiles are interpolated exact
    ones, which takes an order of the distinct numbers, or with `quantiles='sketch'` values picked by a sketch.
    """
    cell_rows = cells(df, by, columns, mode)
    stats = _column_stats(cell_rows, by, accuracy)
    per_value = value_counts(cell_rows, by)
    # Both sides have one row per column and group.
    key = [*by, "coluna"]
    joined = stats.join(_mode(per_value, by), key, "left")
    if quantiles == "exact":
        exact = exact_quantiles(cell_rows, by).select(*[col(c) for c in key], F.array("q25", "median", "q75").alias("quantiles"))
        joined = joined.drop("quantiles").join(exact, key, "left")
    return _summary(joined, by, distinct_cap)


def _mode(per_value: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct count and most frequent value (first by value among ties): a minimum, not a ranking, so no sort."""
    best = F.min(F.struct((-F.col("contagem")).alias("neg"), F.col("valor")))
    return per_value.groupBy(*[col(c) for c in by], "coluna").agg(F.count("*").alias("distinct"), best.alias("best"))


def _summary(joined: DataFrame, by: Sequence[str], distinct_cap: int) -> DataFrame:
    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    non_null = F.col("linhas_lidas") - F.col("nulos")
    numeric = (non_null > 0) & (F.col("parsed") >= NUMERIC_SHARE * non_null)
    kind = F.when(numeric, NUMERIC).when(non_null > 0, TEXT).otherwise("")
    over = F.coalesce(F.col("distinct") > distinct_cap, F.lit(False))
    top1 = F.coalesce(-F.col("best.neg"), F.lit(0))
    pct = F.when((non_null > 0) & (top1 > 0), F.bround(100.0 * top1 / non_null, 3))
    std = F.sqrt(F.col("variancia"))
    cv = F.when(F.col("mean") != 0, std / F.col("mean"))

    def quantile(i: int) -> Column:
        return F.when(numeric, F.col("quantiles")[i])

    values = {
        "tipo_aparente": kind,
        "linhas_nao_nulas": non_null,
        "distinct_est": F.coalesce(F.col("distinct"), F.lit(0)),
        "distinct_cap_excedido": over,
        "mean": zero(F.col("mean")),
        "M2": zero(F.col("variancia") * F.col("value_count")),
        "variancia": zero(F.col("variancia")),
        "desvio_padrao_pop": zero(std),
        "variancia_amostral": zero(F.col("variancia_amostral")),
        "desvio_padrao_amostral": zero(F.sqrt("variancia_amostral")),
        "coef_variacao": zero(cv),
        "q25_approx": quantile(0),
        "median_approx": quantile(1),
        "q75_approx": quantile(2),
        "top1_val": F.coalesce(F.col("best.valor"), F.lit("")),
        "top1_count": top1,
        "top1_pct_of_column": pct,
        "top1_domina": F.coalesce(pct >= DOMINANT_PCT, F.lit(False)),
    }
    return joined.select(*[col(c) for c in by], *[values.get(c, F.col(c)).alias(c) for c in SUMMARY_COLUMNS])


def with_others(top_rows: DataFrame, profile_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top values plus, where values are left over, one `OUTROS` row with their number."""
    key = [*by, "coluna"]
    shown = top_rows.groupBy(*[col(c) for c in key]).agg(
        F.sum("contagem").alias("shown"), F.count("*").alias("n_shown"), F.max("posicao").alias("last")
    )
    left_over = (
        profile_rows.select(*[col(c) for c in key], "linhas_nao_nulas", "distinct_est", "distinct_cap_excedido")
        .join(shown, key)
        .filter(F.col("distinct_cap_excedido") | (F.col("distinct_est") > F.col("n_shown")))
        .select(
            *[col(c) for c in key],
            F.lit(OTHERS).alias("valor"),
            (F.col("linhas_nao_nulas") - F.col("shown")).alias("contagem"),
            (F.col("last") + 1).alias("posicao"),
        )
        .filter(F.col("contagem") > 0)
    )
    return top_rows.unionByName(left_over)


def latest_profile(profiles: DataFrame, stamp: str, table: str = "table_name") -> DataFrame:
    """Of several stored profiles per table, the rows of the newest one."""
    newest = Window.partitionBy(col(table))
    return profiles.withColumn("_newest", F.max(col(stamp)).over(newest)).filter(
        col(stamp) == F.col("_newest")
    ).drop("_newest")


def profile_bands(profile_rows: DataFrame) -> DataFrame:
    """Share of NULLs and a band for how dominant the most frequent value is."""
    pct = F.coalesce("top1_pct_of_column", F.lit(0.0))
    null_pct = F.when(F.col("linhas_lidas") > 0, F.bround(100.0 * F.col("nulos") / F.col("linhas_lidas"), 3)).otherwise(0.0)
    return profile_rows.select(
        "*",
        null_pct.alias("nulos_pct"),
        F.when(pct >= 10, "alta").when(pct >= 2, "media").otherwise("baixa").alias("faixa"),
    )
