"""Random small tables against plain Python, and the driver contract."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from snapscope.plans import registered
from snapscope.operators.content_diff import content_diff
from snapscope.operators.diff import diff_summary, flat_diff, keyed_diff, summary_of

SCHEMA = "k1 INT, k2 STRING, v INT, w STRING"


def table(rng, n):
    return [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y", None]), rng.choice([None, 1, 2]), rng.choice(["", "p", None])) for _ in range(n)]


def joined(a, b):
    """Full outer join on non-NULL keys, pair by pair."""
    out, used = [], set()
    for r in a:
        partners = [i for i, s in enumerate(b) if None not in r[:2] and r[:2] == s[:2]]
        used.update(partners)
        out += [("changed" if r[2:] != b[i][2:] else "same", r[:2], r[2:], b[i][2:]) for i in partners] or [("removed", r[:2], r[2:], None)]
    return out + [("added", s[:2], None, s[2:]) for i, s in enumerate(b) if i not in used]


@pytest.mark.parametrize("seed", range(4))
def test_keyed_diff_equals_plain_join(spark, seed):
    rng = random.Random(seed)
    rows_a, rows_b = table(rng, rng.randint(0, 14)), table(rng, rng.randint(0, 14))
    a, b = spark.createDataFrame(rows_a, SCHEMA), spark.createDataFrame(rows_b, SCHEMA)
    want = joined(rows_a, rows_b)
    got = flat_diff(keyed_diff(a, b, ["k1", "k2"]).rows).collect()
    none = (None, None)
    assert Counter((r.change_type, (r.key_k1, r.key_k2), (r.a_v, r.a_w), (r.b_v, r.b_w)) for r in got) == Counter(
        (t, k, x or none, y or none) for t, k, x, y in want if t != "same")
    kinds = Counter(t for t, *_ in want)
    assert diff_summary(a, b, ["k1", "k2"]).first().asDict() == {
        "rows_a": len(rows_a), "rows_b": len(rows_b), "keys_total": len(want), "same_count": kinds["same"],
        "added_count": kinds["added"], "removed_count": kinds["removed"], "changed_count": kinds["changed"]}
    assert content_diff(a, b).first().diff_count == len(set(rows_a) ^ set(rows_b))


def test_summary_of_one_pass(spark):
    a, b = spark.createDataFrame([(i, str(i % 3)) for i in range(9)], "k INT, v STRING"), spark.createDataFrame([(i, "1") for i in range(4, 12)], "k INT, v STRING")
    whole = keyed_diff(a, b, ["k"], include_same=True, unique_keys=True).rows
    assert summary_of(whole).first() == diff_summary(a, b, ["k"]).first()


def test_contract(spark):
    queries, oracle = registered.QUERIES, registered.ORACLE
    assert set(queries) <= set(entry.queries())
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert set(queries) - set(oracle) == {"catalog_of_files", "catalog_fingerprints"}
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and "change_type" in flagship.columns
