import pytest

from snapscope.operators import signals as s
from snapscope.operators.diff import diff_summary, keyed_diff
from snapscope.plans.report import diff_report, report_json

SCHEMA = "id INT, name STRING, score DOUBLE, stacon STRING, note STRING"
NEW = [(1, "alpha", 10.0, "OK", ""), (2, "beta-new", 55.5, "ALARM", None), (3, "gamma-new", None, "OFF", "nota-nova"),
       (5, "epsilon-new", 1.0, "ON", "fresh")]
OLD = [(1, "alpha", 10.0, "OK", ""), (2, "beta-old", 40.0, "OK", "legacy"), (3, "gamma-old", 4.0, "OFF", None),
       (4, "delta-old", 7.0, "OFF", "old")]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(NEW, SCHEMA), spark.createDataFrame(OLD, SCHEMA)


@pytest.fixture(scope="module")
def rows(pair):
    return keyed_diff(*pair, ["id"]).rows


def all_of(df):
    return [tuple(r) for r in df.collect()]


def test_columns(rows):
    assert all_of(s.column_changes(rows)) == [("name", 2), ("note", 2), ("score", 2), ("stacon", 1)]
    assert all_of(s.first_key_per_column(rows)) == [("name", "id=2"), ("score", "id=2"), ("stacon", "id=2"), ("note", "id=2")]


def test_values(rows):
    assert all_of(s.null_transitions(rows)) == [
        ("note", s.EMPTIED, 1), ("note", s.FILLED, 1), ("score", s.EMPTIED, 1)]
    assert all_of(s.null_transitions(rows, new_side="b"))[2] == ("score", s.FILLED, 1)
    assert all_of(s.numeric_drift(rows)) == [("score", 1, 15.5, 15.5, 15.5)]
    assert all_of(s.numeric_drift(rows, new_side="b")) == [("score", 1, 15.5, 15.5, -15.5)]


def test_states(rows):
    assert all_of(s.state_transitions(rows)) == [("OFF -> OFF", 1), ("OK -> ALARM", 1)]
    assert all_of(s.state_transitions(rows, new_side="b")) == [("ALARM -> OK", 1), ("OFF -> OFF", 1)]
    assert all_of(s.family_counts(rows, ["name"])) == [("beta-new", 1), ("gamma-new", 1)]
    assert all_of(s.family_counts(rows)) == []
    assert all_of(s.family_counts(rows, unknown=s.UNKNOWN_FAMILY)) == [(s.UNKNOWN_FAMILY, 2)]
    assert all_of(s.family_risk(rows)) == [(s.UNKNOWN_FAMILY, 2, 10, "id=2", "OFF => OFF")]
    assert all_of(s.transition_risk(rows)) == [("OFF => OFF", 1), ("OK => ALARM", 1)]


def test_risk(rows):
    risky = s.risk_rows(rows)
    assert all_of(s.top_risk_rows(risky)) == [("id=2", 6, "name, score, stacon, note", "OK => ALARM")]
    assert all_of(s.risk_by_key(risky)) == [("id=2", 6, 1)]
    assert all_of(s.priority_keys(rows)) == [("id=2", 4, "name, score, stacon, note"), ("id=3", 3, "name, score, note")]
    assert all_of(s.high_impact_rows(rows)) == [] and all_of(s.high_impact_rows(rows, least=4)) == [("id=2", 4)]
    assert all_of(s.change_patterns(rows)) == [("name, score, note", 1, "id=3"), ("name, score, stacon, note", 1, "id=2")]
    assert sorted(all_of(s.highlights(rows))) == [
        ("added", "id=4", ""), ("changed", "id=2", "name, score, stacon, note"), ("removed", "id=5", "")]


def test_key_quality(spark, rows):
    assert all_of(s.key_quality(rows)) == [(0, 0, 4)]
    a = spark.createDataFrame([(None, "a"), (" ", "b"), ("k", "c")], "id STRING, v STRING")
    b = spark.createDataFrame([("k", "d"), ("k", "e")], "id STRING, v STRING")
    assert all_of(s.key_quality(keyed_diff(a, b, ["id"]).rows)) == [(2, 1, 3)]
    blank = keyed_diff(spark.createDataFrame([("", "x")], "id STRING, v STRING"), spark.createDataFrame([("", "y")], "id STRING, v STRING"), ["id"]).rows
    assert all_of(s.rows_without_key(blank)) == [('id=""',)]


def test_verdicts(pair, rows):
    counts = s.signal_counts(rows, diff_summary(*pair, ["id"]))
    got = counts.first().asDict()
    assert got["impacted_keys"] == 4 and got["total_keys"] == 5 and got["impacted_pct"] == 80.0
    assert got["null_transitions_total"] == 3 and got["drift_columns"] == 1 and got["risk_row_count"] == 1
    severity = s.severity(counts).first()
    assert severity.severity == "critica"
    assert severity.reasons == ("4/5 chave(s) impactadas (80.0%) · 1 chave(s) com risco >= 4 · 3 transicao(oes) vazio/preenchido"
                                " · 1 coluna(s) com drift numerico")
    actions = [r.action for r in s.recommended_actions(counts).orderBy("position").collect()]
    assert len(actions) == 4 and actions[-1].startswith("Volume de mudanca alto (80.0%)")
    assert s.report_priority(counts).first().priority == "critica"


def test_quiet(spark, pair):
    a, _ = pair
    rows = keyed_diff(a, a, ["id"]).rows
    counts = s.signal_counts(rows, diff_summary(a, a, ["id"]))
    assert s.severity(counts).first().severity == "estavel"
    assert [r.action for r in s.recommended_actions(counts).collect()] == [s.QUIET_ACTION]
    assert s.report_priority(counts).first().priority == "estavel"


def test_anomalies(rows):
    got = [(r.score, r.label) for r in s.priority_anomalies(rows).collect()]
    assert got == [(18.0, "Risco operacional: id=2"), (15.5, "Drift numerico: score"),
                   (2.0, "Transicao concentrada: OFF => OFF"), (2.0, "Transicao concentrada: OK => ALARM")]
    exported = [(r.score, r.label) for r in s.export_anomalies(rows).collect()]
    assert exported[0] == (15.5, "drift numerico: score") and exported[1] == (8.0, "coluna impactada: name")


def test_sections(rows):
    got = {(r.key_text, r.column_name): (r.value_a, r.value_b) for r in s.sections(rows).collect()}
    assert got[("id=2", "score")] == ("55.5", "40.0") and got[("id=4", "name")] == (None, "delta-old")
    assert ("id=3", "stacon") not in got and len(got) == 4 + 3 + 4 + 4


def test_report(pair):
    parts = diff_report(*pair, ["id"])
    assert parts["summary"].first().net_delta == 0
    assert report_json(parts).count() >= 6
    parts["rows"].unpersist()
