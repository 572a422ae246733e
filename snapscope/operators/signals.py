"""What a diff says: which columns changed, drift, emptied values, state changes, risk, severity.

Input is the `rows` frame of a keyed diff. Everything is expressed as aggregations that combine
before they shuffle, over one long form with a row per differing cell (`diff_long`). Rows of a weighted diff
count by their weight; listings show each of them once.

Direction: `new_side` names the side that is the newer version (A by default).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.functions.names import column_key
from snapscope.functions.numbers import finite_number
from snapscope.functions.text import first_non_blank, is_blank, json_text

# Columns that hold a state or name a family of records, thresholds and labels.
STATE_COLUMNS = ["STACON", "NORMST", "SOEHIS", "CLASS"]
FAMILY_COLUMNS = ["PNLNAM", "SUBNAM", "DEVNAM", "PNTNAM", "ITEMNB"]
UNKNOWN_FAMILY = "familia nao identificada"
NO_TRANSITION = "sem transicao"
FILLED, EMPTIED = "vazio -> preenchido", "preenchido -> vazio"
HIGH_IMPACT_COLUMNS = 6
RISKY_SCORE = 4
QUIET_ACTION = "Sem sinal critico no recorte atual; manter monitoramento por amostragem."


def _fields(rows: DataFrame, side: str) -> dict:
    return {f.name: f.dataType for f in rows.schema[side].dataType.fields}


def _names(rows: DataFrame) -> list[str]:
    return rows.schema["key"].dataType.names


def key_text(rows: DataFrame) -> Column:
    """`k1=1, k2="x"`."""
    parts = [F.concat(F.lit(f"{k}="), json_text(F.col("key").getField(k))) for k in _names(rows)]
    return F.concat_ws(", ", *parts)


def key_order(rows: DataFrame) -> Column:
    """A value that sorts like the keys with NULLs last; use it inside min / min_by."""
    parts = []
    for name in _names(rows):
        value = F.col("key").getField(name)
        parts += [value.isNull().alias(f"n{len(parts)}"), value.alias(f"v{len(parts)}")]
    return F.struct(*parts)


def _weight(rows: DataFrame) -> Column:
    """How many pairs a row stands for."""
    return (F.col("weight") if "weight" in rows.columns else F.lit(1)).cast("bigint").alias("weight")


def _pairs(condition: Column) -> Column:
    """Pairs of the rows that meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("weight"))), F.lit(0))


def _changed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("change_type") == "changed")


def _pick(rows: DataFrame, columns: Sequence[str], first: str, second: str) -> Column:
    """First non-blank text of the given columns, looking at side `first` before `second` for each."""
    present = {column_key(c): c for c in reversed(_fields(rows, "a"))}
    chosen = [present[column_key(c)] for c in columns if column_key(c) in present]
    values = [F.col(side).getField(c) for c in chosen for side in (first, second)]
    return first_non_blank(*values) if values else F.lit("")


def _other(side: str) -> str:
    return "b" if side == "a" else "a"


def state_change(rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a") -> tuple[Column, Column]:
    """Old and new state text of a row."""
    old = _pick(rows, state_columns, _other(new_side), new_side)
    new = _pick(rows, state_columns, new_side, _other(new_side))
    return old, new


def _arrow(old: Column, new: Column, sign: str) -> Column:
    def shown(state: Column) -> Column:
        return F.when(state == "", "-").otherwise(state)

    return F.concat(shown(old), F.lit(f" {sign} "), shown(new))


def diff_long(rows: DataFrame, one_sided: bool = False) -> DataFrame:
    """A row per differing cell: key, change_type, column_name, position, value_a, value_b (text), blanks and numbers.

    With `one_sided`, added and removed rows list the value of the side they exist on.
    """
    types_a, types_b = _fields(rows, "a"), _fields(rows, "b")
    cells = []
    for i, name in enumerate(types_a):
        a, b = F.col("a").getField(name), F.col("b").getField(name)
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                a.cast("string").alias("value_a"),
                b.cast("string").alias("value_b"),
                is_blank(a, types_a[name]).alias("blank_a"),
                is_blank(b, types_b[name]).alias("blank_b"),
                finite_number(a, types_a[name]).alias("number_a"),
                finite_number(b, types_b[name]).alias("number_b"),
            )
        )
    if not cells:
        raise ValueError("the diff compares no columns")
    in_row = F.array_contains(F.col("changed_columns"), F.col("cell.column_name"))
    if one_sided:
        in_row = in_row | (F.col("change_type") != "changed")
        source = rows
    else:
        source = _changed(rows)
    return (
        source.select("key", "change_type", "changed_columns", _weight(rows), F.explode(F.array(*cells)).alias("cell"))
        .filter(in_row)
        .select("key", "change_type", "weight", "cell.*")
    )


# --- per column --------------------------------------------------------------------------------


def column_changes(rows: DataFrame, top: int | None = 12) -> DataFrame:
    """Changed rows per column, most changed first."""
    counts = (
        _changed(rows)
        .select(F.explode("changed_columns").alias("column_name"), _weight(rows))
        .groupBy("column_name")
        .agg(F.sum("weight").alias("changes"))
    )
    return _top(counts, top, F.col("changes").desc(), F.col("column_name"))


def first_key_per_column(rows: DataFrame, top: int | None = 4) -> DataFrame:
    """For each changed column the first key, in key order, that shows the change."""
    names = list(_fields(rows, "a"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column_name"))
    found = (
        _changed(rows)
        .select(F.explode("changed_columns").alias("column_name"), key_text(rows).alias("t"), key_order(rows).alias("o"))
        .groupBy("column_name")
        .agg(F.min_by("t", "o").alias("first_key"), F.min("o").alias("o"))
    )
    return _top(found, top, F.col("o"), place).select("column_name", "first_key")


def null_transitions(rows: DataFrame, new_side: str = "a", top: int | None = 8) -> DataFrame:
    """How often a column went from empty to filled or back."""
    old, new = F.col(f"blank_{_other(new_side)}"), F.col(f"blank_{new_side}")
    counts = (
        diff_long(rows)
        .filter(old != new)
        .groupBy("column_name", F.when(old, FILLED).otherwise(EMPTIED).alias("direction"))
        .agg(F.sum("weight").alias("transitions"))
    )
    return _top(counts, top, F.col("transitions").desc(), F.col("column_name"), F.col("direction"))


def numeric_drift(rows: DataFrame, new_side: str = "a", top: int | None = 8) -> DataFrame:
    """Numeric change per column: count, sum and maximum of the absolute change, signed change at the maximum."""
    # Numbers that differ are of a changed column, so no list of them is needed and the sums are formed side by side, without a
    # row or a text per cell.
    types_a, types_b = _fields(rows, "a"), _fields(rows, "b")
    if not types_a:
        raise ValueError("the diff compares no columns")
    cells = {"a": types_a, "b": types_b}
    number = {s: [finite_number(F.col(s).getField(n), cells[s][n]) for n in types_a] for s in cells}
    deltas = [(x - y).alias(f"d{i}") for i, (x, y) in enumerate(zip(number[new_side], number[_other(new_side)]))]
    moved = _changed(rows).select(_weight(rows), *deltas)
    sums = []
    for i in range(len(deltas)):
        delta = F.when(F.col(f"d{i}") != 0, F.col(f"d{i}"))
        weight = F.when(delta.isNotNull(), F.col("weight"))
        sums += [F.sum(weight).alias(f"n{i}"), F.sum(F.abs(delta) * F.col("weight")).alias(f"sum{i}"), F.max(delta).alias(f"up{i}"), F.min(delta).alias(f"down{i}")]

    def stat(i: int, name: str) -> Column:
        # Of two changes of one size the rise counts.
        most = F.when(F.abs(F.col(f"up{i}")) >= F.abs(F.col(f"down{i}")), F.col(f"up{i}")).otherwise(F.col(f"down{i}"))
        return F.struct(
            F.lit(name).alias("column_name"), F.col(f"n{i}").alias("drift_count"), F.col(f"sum{i}").alias("sum_abs_delta"),
            F.abs(most).alias("max_abs_delta"), most.alias("max_signed_delta"))

    stats = moved.agg(*sums).select(F.inline(F.array(*[stat(i, n) for i, n in enumerate(types_a)]))).filter("drift_count IS NOT NULL")
    return _top(stats, top, F.col("sum_abs_delta").desc(), F.col("column_name"))


def change_patterns(rows: DataFrame, top: int | None = 5) -> DataFrame:
    """Rows per set of changed columns, with the first key that shows it."""
    found = (
        _changed(rows)
        .groupBy(F.array_join("changed_columns", ", ").alias("pattern"))
        .agg(F.sum(_weight(rows)).alias("row_count"), F.min_by(key_text(rows), key_order(rows)).alias("sample_key"))
    )
    return _top(found, top, F.col("row_count").desc(), F.col("pattern"))


# --- per row and key ---------------------------------------------------------------------------


def _top(df: DataFrame, top: int | None, *order: Column) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if top is None else ordered.limit(top)


def net_delta(summary: DataFrame) -> DataFrame:
    """Rows only in A minus rows only in B."""
    return summary.select("*", (F.col("removed_count") - F.col("added_count")).alias("net_delta"))


def highlights(rows: DataFrame) -> DataFrame:
    """First key of each change type; for `changed` also its changed columns."""
    return rows.groupBy("change_type").agg(
        F.min_by(key_text(rows), key_order(rows)).alias("first_key"),
        F.min_by(F.array_join("changed_columns", ", "), key_order(rows)).alias("changed_columns"),
    )


def priority_keys(rows: DataFrame, top: int = 5) -> DataFrame:
    """Keys with the most changed columns."""
    picked = _changed(rows).select(
        key_text(rows).alias("key_text"),
        F.size("changed_columns").alias("n_changed"),
        F.array_join("changed_columns", ", ").alias("changed_columns"),
        key_order(rows).alias("o"),
    )
    return _top(picked, top, F.col("n_changed").desc(), F.col("o")).drop("o")


def high_impact_rows(rows: DataFrame, least: int = HIGH_IMPACT_COLUMNS, top: int | None = 6) -> DataFrame:
    """Rows with at least `least` changed columns, in key order."""
    picked = _changed(rows).select(
        key_text(rows).alias("key_text"), F.size("changed_columns").alias("n_changed"), key_order(rows).alias("o")
    )
    return _top(picked.filter(F.col("n_changed") >= least), top, F.col("o")).drop("o")


def rows_without_key(rows: DataFrame, top: int | None = 4) -> DataFrame:
    """Changed rows whose key values are all blank, in the order of their values."""
    types = _fields(rows, "key")
    blank = reduce(lambda x, y: x & y, [is_blank(F.col("key").getField(k), t) for k, t in types.items()])
    ordered = _changed(rows).filter(blank).orderBy("a", "b").select(key_text(rows).alias("key_text"))
    return ordered if top is None else ordered.limit(top)


def state_transitions(
    rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a", top: int | None = 6
) -> DataFrame:
    """Rows per `old -> new` state; rows without any state are left out."""
    old, new = state_change(rows, state_columns, new_side)
    counts = (
        _changed(rows)
        .select(old.alias("old"), new.alias("new"), _weight(rows))
        .filter((F.col("old") != "") | (F.col("new") != ""))
        .groupBy(_arrow(F.col("old"), F.col("new"), "->").alias("transition"))
        .agg(F.sum("weight").alias("row_count"))
    )
    return _top(counts, top, F.col("row_count").desc(), F.col("transition"))


def family_counts(
    rows: DataFrame, family_columns: Sequence[str] = FAMILY_COLUMNS, new_side: str = "a", top: int | None = 6,
    unknown: str | None = None,
) -> DataFrame:
    """Changed rows per family. Rows without one are left out, or counted as `unknown`."""
    family = _pick(rows, family_columns, new_side, _other(new_side))
    named = _changed(rows).select(F.when(family != "", family).otherwise(F.lit(unknown)).alias("family"), _weight(rows))
    counts = named.filter(F.col("family").isNotNull()).groupBy("family").agg(F.sum("weight").alias("row_count"))
    return _top(counts, top, F.col("row_count").desc(), F.col("family"))


def _scored(rows, state_columns, family_columns, new_side) -> DataFrame:
    old, new = state_change(rows, state_columns, new_side)
    family = _pick(rows, family_columns, new_side, _other(new_side))
    return (
        _changed(rows)
        .filter(F.size("changed_columns") > 0)
        .select(
            key_text(rows).alias("key_text"),
            key_order(rows).alias("o"),
            F.size("changed_columns").alias("n_changed"),
            F.array_join(F.slice("changed_columns", 1, 5), ", ").alias("first_columns"),
            old.alias("old"),
            new.alias("new"),
            F.when(family == "", UNKNOWN_FAMILY).otherwise(family).alias("family"),
            _weight(rows),
        )
        .withColumn("moved", (F.col("old") != "") & (F.col("new") != "") & (F.col("old") != F.col("new")))
    )


def family_risk(
    rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, family_columns: Sequence[str] = FAMILY_COLUMNS[:3],
    new_side: str = "a", top: int | None = 6,
) -> DataFrame:
    """Per family: rows, score (changed columns, plus 3 for a state change), first key and its commonest transition."""
    scored = _scored(rows, state_columns, family_columns, new_side)
    no_state = (F.col("old") == "") & (F.col("new") == "")
    transition = F.when(no_state, NO_TRANSITION).otherwise(_arrow(F.col("old"), F.col("new"), "=>"))
    per_transition = scored.groupBy("family", transition.alias("transition")).agg(
        F.sum("weight").alias("n"),
        F.sum((F.col("n_changed") + F.when(F.col("moved"), 3).otherwise(0)) * F.col("weight")).alias("score"),
        F.min_by("key_text", "o").alias("sample"),
        F.min("o").alias("o"),
    )
    families = per_transition.groupBy("family").agg(
        F.sum("n").alias("row_count"),
        F.sum("score").alias("score"),
        F.min_by("sample", "o").alias("sample_key"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("transition"))).getField("transition").alias("top_transition"),
    )
    return _top(families, top, F.col("score").desc(), F.col("family"))


def transition_risk(
    rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a", top: int | None = 5
) -> DataFrame:
    """Rows per `old => new` state, rows without any state counted as such."""
    old, new = state_change(rows, state_columns, new_side)
    states = _changed(rows).select(old.alias("old"), new.alias("new"), _weight(rows))
    label = F.when((F.col("old") == "") & (F.col("new") == ""), NO_TRANSITION).otherwise(
        _arrow(F.col("old"), F.col("new"), "=>")
    )
    counts = states.groupBy(label.alias("transition")).agg(F.sum("weight").alias("row_count"))
    return _top(counts, top, F.col("row_count").desc(), F.col("transition"))


def _risk_score() -> Column:
    return F.col("n_changed") + F.when(F.col("moved"), 2).otherwise(0)


def risk_rows(
    rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a", least: int = RISKY_SCORE
) -> DataFrame:
    """Rows scored by changed columns, plus 2 for a state change, that reach `least`."""
    scored = _scored(rows, state_columns, [], new_side)
    known = (F.col("old") != "") & (F.col("new") != "")
    return scored.select(
        "key_text",
        _risk_score().alias("risk_score"),
        "first_columns",
        F.when(known, F.concat("old", F.lit(" => "), "new")).otherwise(NO_TRANSITION).alias("transition"),
        "o",
        "weight",
    ).filter(F.col("risk_score") >= least)


def top_risk_rows(risky: DataFrame, top: int = 6) -> DataFrame:
    return _top(risky, top, F.col("risk_score").desc(), F.col("o")).drop("o", "weight")


def risk_by_key(risky: DataFrame, top: int = 4) -> DataFrame:
    """Risk added up per key: a key may occur in several rows."""
    sums = risky.groupBy("key_text").agg(
        F.sum(F.col("risk_score") * F.col("weight")).alias("risk_score"), F.sum("weight").alias("row_count"))
    return _top(sums, top, F.col("risk_score").desc(), F.col("key_text"))


def key_quality(rows: DataFrame) -> DataFrame:
    """One row: rows with a blank key part, rows that repeat a key, distinct keys."""
    types = _fields(rows, "key")
    blank = reduce(lambda x, y: x | y, [is_blank(F.col("key").getField(k), t) for k, t in types.items()])
    text = F.concat_ws(
        "|",
        *[F.concat(F.lit(f"{k}="), F.coalesce(F.col("key").getField(k).cast("string"), F.lit(""))) for k in types],
    )
    per_key = rows.select(text.alias("key_text"), blank.alias("blank"), _weight(rows)).groupBy("key_text").agg(
        F.sum("weight").alias("n"), _pairs(F.col("blank")).alias("blank_rows")
    )
    return per_key.agg(
        F.coalesce(F.sum("blank_rows"), F.lit(0)).alias("blank_key_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key_rows"),
        F.count("*").alias("unique_keys"),
    )


# --- verdicts ----------------------------------------------------------------------------------


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side by side: every frame is an ungrouped aggregate, so stacking them and taking maxima is exact."""
    names = [c for f in frames for c in f.columns]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def signal_counts(
    rows: DataFrame, summary: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a",
    scope: str = "all_keys",
) -> DataFrame:
    """One row with the figures the verdicts use.

    `scope='all_keys'` relates impacted keys to all keys; `'diff_rows'` to the diff rows only, which makes
    every non-empty diff 100 % impacted.
    """
    totals = summary.select(
        (F.col("added_count") + F.col("removed_count") + F.col("changed_count")).alias("impacted_keys"),
        F.col("keys_total").alias("total_keys"),
        "added_count", "removed_count", "changed_count",
    )
    if scope == "diff_rows":
        totals = totals.withColumn("total_keys", F.col("impacted_keys"))
    long = diff_long(rows)
    delta = F.col("number_a") - F.col("number_b")
    cells = long.groupBy("column_name").agg(
        _pairs(F.col("blank_a") & ~F.col("blank_b")).alias("to_null"),
        _pairs(~F.col("blank_a") & F.col("blank_b")).alias("from_null"),
        _pairs(delta != 0).alias("drifts"),
    ).agg(
        F.coalesce(F.sum(F.col("to_null") + F.col("from_null")), F.lit(0)).alias("null_transitions_total"),
        (F.count_if(F.col("to_null") > 0) + F.count_if(F.col("from_null") > 0)).alias("null_transition_kinds"),
        F.count_if(F.col("drifts") > 0).alias("drift_columns"),
    )
    per_row = _scored(rows, state_columns, [], new_side).agg(
        _pairs(_risk_score() >= RISKY_SCORE).alias("risk_row_count"),
        _pairs(F.col("n_changed") >= HIGH_IMPACT_COLUMNS).alias("high_impact_count"),
    )
    share = F.when(F.col("total_keys") > 0, F.col("impacted_keys") / F.col("total_keys") * 100).otherwise(F.lit(0.0))
    return _one_row(totals, cells, per_row).withColumn("impacted_pct", share)


def severity(counts: DataFrame) -> DataFrame:
    """critica / alta / media / baixa / estavel, with the reasons as text."""
    pct, risky = F.col("impacted_pct"), F.col("risk_row_count")
    label = (
        F.when((pct >= 50) | (risky >= 4), "critica")
        .when((pct >= 25) | (risky >= 2) | (F.col("null_transitions_total") >= 4), "alta")
        .when((pct >= 10) | (F.col("drift_columns") >= 2), "media")
        .when(F.col("impacted_keys") == 0, "estavel")
        .otherwise("baixa")
    )

    def reason(count: str, text: str) -> Column:
        return F.when(F.col(count) > 0, F.format_string(f"%d {text}", F.col(count)))

    reasons = F.concat_ws(
        " · ",
        F.format_string("%d/%d chave(s) impactadas (%.1f%%)", "impacted_keys", "total_keys", "impacted_pct"),
        reason("risk_row_count", "chave(s) com risco >= 4"),
        reason("null_transitions_total", "transicao(oes) vazio/preenchido"),
        reason("drift_columns", "coluna(s) com drift numerico"),
    )
    return counts.select("*", label.alias("severity"), reasons.alias("reasons"))


def recommended_actions(counts: DataFrame) -> DataFrame:
    """What to look at first, at most six lines."""
    volume = F.format_string(
        "Volume de mudanca alto (%.1f%%). Executar validacao por lote antes de aplicar em producao.", "impacted_pct"
    )
    lines = F.array_compact(
        F.array(
            F.when(
                F.col("high_impact_count") > 0,
                "Revisar primeiro as chaves com alto impacto (topo da lista de anomalias prioritarias).",
            ),
            F.when(F.col("risk_row_count") > 0, "Validar manualmente as chaves com risco operacional acima de 3."),
            F.when(
                F.col("null_transitions_total") > 0,
                "Conferir transicoes de vazio/preenchido antes de promover alteracoes.",
            ),
            F.when(
                F.col("drift_columns") > 0, "Auditar os maiores deltas numericos para evitar regressao de valores."
            ),
            F.when(F.col("impacted_pct") >= 25, volume),
        )
    )
    chosen = F.when(F.size(lines) == 0, F.array(F.lit(QUIET_ACTION))).otherwise(F.slice(lines, 1, 6))
    return counts.select(F.posexplode(chosen).alias("position", "action"))


def report_actions(counts: DataFrame, quality: DataFrame, transitions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The exported report's list of what to do first, from the signal counts, key quality, state transitions and anomalies.

    The texts are fixed values.
    """
    share = F.regexp_replace(F.format_string("%.1f", "impacted_pct"), "[.]0$", "")
    leading = transitions.orderBy(F.col("row_count").desc(), "transition").limit(1)
    worst = anomalies.orderBy(F.col("score").desc(), "label").limit(1)
    lines = [
        quality.filter("blank_key_rows > 0").select(
            F.format_string("Revisar %d linha(s) com chave incompleta antes de consolidar a comparacao.", "blank_key_rows")),
        quality.filter("duplicate_key_rows > 0").select(
            F.format_string("Revisar %d ocorrencia(s) de chave duplicada no recorte comparado.", "duplicate_key_rows")),
        counts.filter("impacted_pct >= 25").select(
            F.concat(F.lit("Volume de mudanca alto ("), share, F.lit("%). Priorizar validacao por lote antes de aplicar."))),
        leading.select(F.format_string('Validar transicao dominante "%s" (%d ocorrencia(s)).', "transition", "row_count")),
        worst.select(F.format_string("Comecar pela anomalia de maior score: %s.", "label")),
        counts.limit(1).select(F.lit(QUIET_ACTION)),
    ]
    placed = [df.toDF("action").select(F.lit(i).alias("place"), "action") for i, df in enumerate(lines)]
    # At most six lines, the last of which stands only for itself.
    found = reduce(DataFrame.unionAll, placed).agg(F.array_sort(F.collect_list(F.struct("place", "action"))).alias("lines"))
    spoken = F.when(F.size("lines") > 1, F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
    return found.select(F.posexplode(F.transform(spoken, lambda x: x["action"])).alias("position", "action"))


def priority_anomalies(
    rows: DataFrame, state_columns: Sequence[str] = STATE_COLUMNS, new_side: str = "a", top: int = 8
) -> DataFrame:
    """Strongest signals of all kinds on one scale: impact x4, risk x3, absolute drift, state changes x2."""

    def item(df: DataFrame, score: Column, label: Column, detail: Column) -> DataFrame:
        return df.select(score.cast("double").alias("score"), label.alias("label"), detail.alias("detail"))

    impact = item(
        high_impact_rows(rows, top=None),
        F.col("n_changed") * 4,
        F.concat(F.lit("Chave com alto impacto: "), "key_text"),
        F.format_string("%d colunas alteradas", "n_changed"),
    )
    risk = item(
        top_risk_rows(risk_rows(rows, state_columns, new_side), top=None),
        F.col("risk_score") * 3,
        F.concat(F.lit("Risco operacional: "), "key_text"),
        F.format_string("%d pontos · %s", "risk_score", "first_columns"),
    )
    drift = item(
        numeric_drift(rows, new_side, top=None),
        F.col("sum_abs_delta"),
        F.concat(F.lit("Drift numerico: "), "column_name"),
        F.format_string("soma abs %.2f · pico %.2f", "sum_abs_delta", "max_signed_delta"),
    )
    moves = item(
        transition_risk(rows, state_columns, new_side, top=None),
        F.col("row_count") * 2,
        F.concat(F.lit("Transicao concentrada: "), "transition"),
        F.format_string("%d ocorrencia(s)", "row_count"),
    )
    everything = impact.unionByName(risk).unionByName(drift).unionByName(moves)
    return _top(everything, top, F.col("score").desc(), F.col("label"))


def export_anomalies(rows: DataFrame, new_side: str = "a", top: int = 8) -> DataFrame:
    """The exported report's scale: changed column x4, emptied or filled x3, absolute drift."""
    columns = column_changes(rows, None).select(
        (F.col("changes") * 4).cast("double").alias("score"),
        F.concat(F.lit("coluna impactada: "), "column_name").alias("label"),
        F.format_string("%d chave(s) alteradas", "changes").alias("detail"),
    )
    nulls = null_transitions(rows, new_side, None).select(
        (F.col("transitions") * 3).cast("double").alias("score"),
        F.concat(F.lit("transicao nulo/preenchido: "), "column_name", F.lit(" | "), "direction").alias("label"),
        F.format_string("%d ocorrencia(s)", "transitions").alias("detail"),
    )
    drift = numeric_drift(rows, new_side, None).select(
        F.round("sum_abs_delta", 4).alias("score"),
        F.concat(F.lit("drift numerico: "), "column_name").alias("label"),
        F.format_string("soma abs %.4f · pico %.4f", "sum_abs_delta", "max_signed_delta").alias("detail"),
    )
    everything = columns.unionByName(nulls).unionByName(drift)
    return _top(everything, top, F.col("score").desc(), F.col("label"))


def report_priority(counts: DataFrame) -> DataFrame:
    """Priority of the exported report; it looks at the number of changed rows rather than at risk."""
    pct, changed = F.col("impacted_pct"), F.col("changed_count")
    label = (
        F.when((pct >= 50) | (changed >= 10), "critica")
        .when((pct >= 25) | (changed >= 5) | (F.col("null_transition_kinds") >= 3), "alta")
        .when((pct >= 10) | (F.col("drift_columns") >= 2), "media")
        .when(F.col("impacted_keys") == 0, "estavel")
        .otherwise("baixa")
    )
    return counts.select("*", label.alias("priority"))


def sections(rows: DataFrame) -> DataFrame:
    """The diff as reading text: one row per shown cell, one-sided rows with the value of their side."""
    return diff_long(rows, one_sided=True).select(
        "change_type",
        key_text(rows).alias("key_text"),
        "position",
        "column_name",
        F.when(F.col("change_type") == "added", F.lit(None)).otherwise(F.col("value_a")).alias("value_a"),
        F.when(F.col("change_type") == "removed", F.lit(None)).otherwise(F.col("value_b")).alias("value_b"),
    )
