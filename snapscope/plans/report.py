"""Comparing two whole databases: overview, details of every differing table, readable report rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapscope.functions.names import column_key, common_columns
from snapscope.functions.numbers import display_value
from snapscope.operators import signals
from snapscope.operators.content_diff import overview, overview_summary, report_order
from snapscope.operators.diff import KeyedDiff, diff_order, diff_summary, keyed_diff, summary_of
from snapscope.operators.keys import infer_keys_checked
from snapscope.session import settled

# Columns a report always shows, by the end of the table name; labels.
ALWAYS_SHOWN = ["RTUNO", "PNTNO", "PTNAM", "PNTNAM", "STTYPE", "BITBYT", "UNIQID", "ITEMNB"]
ALWAYS_SHOWN_ANALOG = ["RTUNO", "PNTNO", "PTNAM", "PNTNAM", "BIAS", "SCALE", "ENGINX", "HLIM6", "LLIM6", "ITEMNB"]
TYPE_LABELS = {"changed": "modificado", "added": "novo", "removed": "excluido"}
STATUS_LABELS = {"diff": "alterado", "same": "igual", "no_key": "sem_chave", "error": "erro"}
OLD_LABEL, NEW_LABEL = "velho", "novo"
FALLBACK_COLUMNS = 4


def forced_columns(table: str, columns: Sequence[str]) -> list[str]:
    wanted = ALWAYS_SHOWN_ANALOG if table.upper().endswith("SOANLG") else ALWAYS_SHOWN
    by_key = {column_key(c): c for c in reversed(columns)}
    return [by_key[w] for w in wanted if w in by_key]


def visible_columns(table: str, columns: Sequence[str], keys: Sequence[str], changed: Sequence[str]) -> list[str]:
    """Always-shown columns, then the changed ones; without either the first few that are no key."""
    shown = list(dict.fromkeys([*forced_columns(table, columns), *changed]))
    return shown or [c for c in columns if c not in keys][:FALLBACK_COLUMNS]


def changed_in_order(rows: DataFrame) -> list[str]:
    """Names of the columns that changed anywhere in these rows, by first appearance in key order, then position."""
    compared = rows.schema["a"].dataType.names
    place = {c: i for i, c in enumerate(compared)}
    first = (
        rows.filter("change_type = 'changed'")
        .select(F.explode("changed_columns").alias("c"), signals.key_order(rows).alias("o"))
        .groupBy("c")
        .agg(F.min("o").alias("o"))
        .orderBy("o")
        .collect()
    )
    # At most one row per compared column; columns that first change in the same row go by position.
    ordered = [(i and r.o == first[i - 1].o, r.c) for i, r in enumerate(first)]
    groups: list[list[str]] = []
    for tied, name in ordered:
        if tied:
            groups[-1].append(name)
        else:
            groups.append([name])
    return [name for group in groups for name in sorted(group, key=place.__getitem__)]


def table_detail(rows: DataFrame, table: str, columns: Sequence[str], keys: Sequence[str], most: int | None = None) -> DataFrame:
    """All diff rows, or the first `most` of them, in key order with formatted old and new values and a changed flag per shown column."""
    # The columns to show are those that change anywhere in the diff, whatever part of it is asked for.
    shown = visible_columns(table, columns, keys, changed_in_order(rows))
    few = rows.orderBy(*diff_order(rows))
    few = few if most is None else few.limit(most)
    kinds = {side: {f.name: f.dataType for f in rows.schema[side].dataType.fields} for side in ("key", "a", "b")}

    def text(side: str, name: str) -> Column:
        if name not in kinds[side]:
            return F.lit("")
        return display_value(F.col(side).getField(name), kinds[side][name], name)

    def is_changed(name: str) -> Column:
        if name not in kinds["a"]:
            return F.lit(False)
        raw = {s: F.coalesce(F.col(s).getField(name).cast("string"), F.lit("")) for s in ("a", "b")}
        return (
            F.when(F.col("change_type") == "changed", F.array_contains("changed_columns", name))
            .when(F.col("change_type") == "added", raw["b"] != "")
            .otherwise(raw["a"] != "")
        )

    return few.select(
        F.lit(table).alias("table_name"),
        "change_type",
        F.struct(*[display_value(F.col("key").getField(k), kinds["key"][k], k).alias(k) for k in keys]).alias("key_values"),
        F.struct(*[text("a", c).alias(c) for c in shown]).alias("old"),
        F.struct(*[text("b", c).alias(c) for c in shown]).alias("new"),
        F.struct(*[is_changed(c).alias(c) for c in shown]).alias("changed"),
    )


def labelled(value: Column, labels: Mapping[str, str]) -> Column:
    """Report word for a change type or status; unknown values stay."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs).getItem(value), value)


def two_lines(detail: DataFrame, label_a: str = OLD_LABEL, label_b: str = NEW_LABEL) -> DataFrame:
    """Each diff row as an old line and a new line: table, type label, side label, `k=v` texts."""

    def pairs(name: str) -> Column:
        fields = detail.schema[name].dataType.names
        return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), F.col(name).getField(c)) for c in fields])

    lines = F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit(label_a).alias("side"), pairs("old").alias("line_values")),
        F.struct(F.lit(2).alias("line_no"), F.lit(label_b).alias("side"), pairs("new").alias("line_values")),
    )
    return detail.select(
        "table_name", labelled(F.col("change_type"), TYPE_LABELS).alias("type_label"), pairs("key_values").alias("key_text"),
        F.explode(lines).alias("l"),
    ).select("table_name", "key_text", "type_label", "l.*")


def text_lines(two: DataFrame) -> DataFrame:
    """The report rows as text."""
    return two.select(F.format_string("key=%s tipo=%s | %s: %s", "key_text", "type_label", "side", "line_values").alias("line"))


@dataclass(frozen=True)
class DatabaseComparison:
    overview: DataFrame
    summary: DataFrame
    changed: DataFrame
    keys: dict[str, list[str]]
    diffs: dict[str, KeyedDiff]
    details: dict[str, DataFrame]


def compare_databases(
    spark: SparkSession, a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], tables: Sequence[str] | None = None,
    detail_rows: int | None = None,
) -> DatabaseComparison:
    """Overview of all common tables, then keys, full diff and compact details of each differing one."""
    seen = overview(spark, a, b, tables)
    keys, diffs, details = {}, {}, {}
    for row in report_order(seen).filter("status = 'diff'").collect():
        name = row.table_name
        common = common_columns(a[name], b[name])
        keys[name], unique = infer_keys_checked(a[name], b[name], common)
        diffs[name] = keyed_diff(a[name], b[name], keys[name], unique_keys=unique)
        details[name] = table_detail(diffs[name].rows, name, common, keys[name], detail_rows)
    return DatabaseComparison(seen, overview_summary(seen), report_order(seen), keys, diffs, details)


# --- report on one diff ------------------------------------------------------------------------


def diff_report(
    a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None,
    state_columns: Sequence[str] = signals.STATE_COLUMNS, family_columns: Sequence[str] = signals.FAMILY_COLUMNS,
    new_side: str = "a", scope: str = "all_keys",
) -> dict[str, DataFrame]:
    """Every signal of one diff. The diff is weighted, so a key that repeats costs its distinct rows, not their pairs; it is
    computed once and stored."""
    rows = settled(keyed_diff(a, b, keys, compare, weighted=True).rows)
    summary = diff_summary(a, b, keys, compare)
    counts = signals.signal_counts(rows, summary, state_columns, new_side, scope)
    risky = signals.risk_rows(rows, state_columns, new_side)
    parts = {
        "rows": rows,
        "summary": signals.net_delta(summary),
        "severity": signals.severity(counts),
        "priority": signals.report_priority(counts),
        "actions": signals.recommended_actions(counts),
        "report_actions": signals.report_actions(
            counts, signals.key_quality(rows), signals.state_transitions(rows, state_columns, new_side), signals.export_anomalies(rows, new_side)),
        "column_changes": signals.column_changes(rows),
        "first_keys": signals.first_key_per_column(rows),
        "highlights": signals.highlights(rows),
        "priority_keys": signals.priority_keys(rows),
        "patterns": signals.change_patterns(rows),
        "high_impact": signals.high_impact_rows(rows),
        "without_key": signals.rows_without_key(rows),
        "null_transitions": signals.null_transitions(rows, new_side),
        "numeric_drift": signals.numeric_drift(rows, new_side),
        "state_transitions": signals.state_transitions(rows, state_columns, new_side),
        "families": signals.family_counts(rows, family_columns, new_side),
        "family_risk": signals.family_risk(rows, state_columns, family_columns[:3], new_side),
        "risk_rows": signals.top_risk_rows(risky),
        "risk_by_key": signals.risk_by_key(risky),
        "key_quality": signals.key_quality(rows),
        "anomalies": signals.priority_anomalies(rows, state_columns, new_side),
        "export_anomalies": signals.export_anomalies(rows, new_side),
    }
    return parts


def report_json(parts: Mapping[str, DataFrame], names: Sequence[str] = ("severity", "key_quality", "column_changes", "null_transitions", "numeric_drift", "export_anomalies")) -> DataFrame:
    """Short parts of a report as (section, json) rows; each part is limited by its own top-N."""
    return reduce(
        DataFrame.unionByName,
        [parts[n].select(F.lit(n).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")) for n in names],
    )


def classified_summary(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None) -> DataFrame:
    """Summary by one join, for keys known to be unique."""
    return summary_of(keyed_diff(a, b, keys, compare, include_same=True, unique_keys=True).rows)
