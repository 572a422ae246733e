"""Every operator as a named query over the given tables, with the SQL that must give the same rows.

Numbers that depend on summation order are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapscope.functions import numbers, text
from snapscope.operators import (
    browse, content_diff, crowded, diff, index_upkeep, keys, pages, posting_lists, profile, rollup, search, signals, text_index, track, validate,
)
from snapscope.functions.dates import date_in_name
from snapscope.functions.names import col
from snapscope.functions.serial import flatten_nested, json_rows
from snapscope.operators.filters import matches, parse_conditions
from snapscope.plans import report
from snapscope.plans.versions import (
    TABLES, daily_catalog, events_daily, lineitem_versions, null_key_versions, number_texts, order_files,
    orders_versions, part_versions, table, tables,
)
from snapscope.session import shared_path
from snapscope.sources import catalog, export, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# --- SQL twins of the versions -----------------------------------------------------------------

ORDERS = """
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        CASE WHEN o_orderkey % 43 <> 0 THEN o_orderpriority END AS o_orderpriority, date_trunc('day', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders),
b AS (SELECT CASE WHEN o_orderkey % 89 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey,
        CASE WHEN o_orderkey % 30 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 29 = 0 THEN o_totalprice + 100 WHEN o_orderkey % 31 = 0 THEN o_totalprice - 37.5::DOUBLE
             ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 41 <> 0 THEN o_orderpriority END AS o_orderpriority,
        (date_trunc('day', o_orderdate) + CASE WHEN o_orderkey % 37 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::TIMESTAMP AS o_orderdate FROM orders)
"""
# d: the diff of orders with all rows; n_changed and changed list the differing columns.
ORDERS_DIFF = ORDERS + """,
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey AS ka, b.o_orderkey AS kb,
        a.o_custkey AS a_c, b.o_custkey AS b_c, a.o_orderstatus AS a_s, b.o_orderstatus AS b_s,
        a.o_totalprice AS a_t, b.o_totalprice AS b_t, a.o_orderpriority AS a_p, b.o_orderpriority AS b_p, a.o_orderdate AS a_d, b.o_orderdate AS b_d
      FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
e AS (SELECT *, ka IS NOT NULL AND kb IS NOT NULL AS m,
        a_c IS DISTINCT FROM b_c AS c_c, a_s IS DISTINCT FROM b_s AS c_s,
        a_t IS DISTINCT FROM b_t AS c_t, a_p IS DISTINCT FROM b_p AS c_p, a_d IS DISTINCT FROM b_d AS c_d FROM j),
f AS (SELECT *, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed'
        WHEN c_c OR c_s OR c_t OR c_p OR c_d THEN 'changed' ELSE 'same' END AS change_type,
        concat_ws(', ', CASE WHEN m AND c_c THEN 'o_custkey' END, CASE WHEN m AND c_s THEN 'o_orderstatus' END,
          CASE WHEN m AND c_t THEN 'o_totalprice' END, CASE WHEN m AND c_p THEN 'o_orderpriority' END,
          CASE WHEN m AND c_d THEN 'o_orderdate' END) AS changed,
        CASE WHEN m THEN c_c::INT + c_s::INT + c_t::INT + c_p::INT + c_d::INT ELSE 0 END AS n_changed,
        'o_orderkey=' || k AS key_text FROM e),
d AS (SELECT * FROM f WHERE change_type <> 'same'),
ch AS (SELECT * FROM d WHERE change_type = 'changed'),
cells AS (
  SELECT k, key_text, 0 AS pos, 'o_custkey' AS column_name, a_c::VARCHAR AS va, b_c::VARCHAR AS vb, a_c::DOUBLE AS na, b_c::DOUBLE AS nb FROM ch WHERE c_c
  UNION ALL SELECT k, key_text, 1, 'o_orderstatus', a_s, b_s, NULL, NULL FROM ch WHERE c_s
  UNION ALL SELECT k, key_text, 2, 'o_totalprice', a_t::VARCHAR, b_t::VARCHAR, a_t, b_t FROM ch WHERE c_t
  UNION ALL SELECT k, key_text, 3, 'o_orderpriority', a_p, b_p, NULL, NULL FROM ch WHERE c_p
  UNION ALL SELECT k, key_text, 4, 'o_orderdate', a_d::VARCHAR, b_d::VARCHAR, NULL, NULL FROM ch WHERE c_d),
states AS (SELECT *, coalesce(b_s, a_s, '') AS old, coalesce(a_s, b_s, '') AS new,
        coalesce(a_p, b_p, '') AS fam FROM ch),
risk AS (SELECT *, n_changed + CASE WHEN old <> new THEN 2 ELSE 0 END AS score FROM states)
"""
DIFF_COLUMNS = """k AS key_o_orderkey, change_type, a_c::VARCHAR AS a_o_custkey, b_c::VARCHAR AS b_o_custkey, a_s AS a_o_orderstatus,
  b_s AS b_o_orderstatus, a_t AS a_o_totalprice, b_t AS b_o_totalprice, a_p AS a_o_orderpriority,
  b_p AS b_o_orderpriority, a_d::VARCHAR AS a_o_orderdate, b_d::VARCHAR AS b_o_orderdate, replace(changed, ', ', ',') AS changed"""
PART = """
a AS (SELECT * FROM part),
b AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN -p_partkey ELSE p_partkey END AS p_partkey, p_name,
        CASE WHEN p_partkey % 23 = 0 THEN p_brand || '-new' ELSE p_brand END AS p_brand, p_type, p_size,
        CASE WHEN p_partkey % 19 = 0 THEN p_retailprice + 0.5::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part)
"""
LINES = """
a AS (SELECT * FROM lineitem),
b AS (SELECT * REPLACE (CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem)
"""
NULL_KEYS = """
a AS (SELECT * REPLACE (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS c_custkey) FROM customer),
b AS (SELECT * REPLACE (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS c_custkey,
        CASE WHEN c_custkey % 20 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM customer)
"""
DAILY = """
daily AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot, event_id, user_id, event_type,
        CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events),
cat AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS order_idx FROM (SELECT DISTINCT snapshot FROM daily))
"""
STATE, FAMILY = ["o_orderstatus"], ["o_orderpriority"]


# Sums differ in their last bits between engines, so both sides round them.
def _r(expression: str, digits: int) -> str:
    return f"round({expression}, {digits})"


def _rounded(value, digits: int):
    return F.round(value, digits)


def norm_sql(value: str) -> str:
    """Normalised text in SQL."""
    return (
        f"trim(regexp_replace(regexp_replace(lower(strip_accents({value})), '[^\\pL\\pN\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates, and integers or flags that may be NULL, as text: every client reads those alike."""
    return df.select(*[col(c).cast("string").alias(c) if c in names else col(c) for c in df.columns])


def _flat_orders(rows: DataFrame) -> DataFrame:
    return as_text(diff.flat_diff(rows), "a_o_custkey", "b_o_custkey", "a_o_orderdate", "b_o_orderdate")


def _orders_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    a, b = orders_versions(spark, sf_dir)
    return diff.keyed_diff(a, b, ["o_orderkey"], **options).rows


# --- keyed diff --------------------------------------------------------------------------------


@query("diff_orders_rows", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d")
def _(spark, d):
    return _flat_orders(_orders_rows(spark, d))


SUMMARY_SQL = """SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, count(*) AS keys_total,
  count(*) FILTER (change_type = 'same') AS same_count, count(*) FILTER (change_type = 'added') AS added_count,
  count(*) FILTER (change_type = 'removed') AS removed_count, count(*) FILTER (change_type = 'changed') AS changed_count FROM f"""


@query("diff_orders_summary", f"WITH {ORDERS_DIFF} {SUMMARY_SQL}")
def _(spark, d):
    return diff.diff_summary(*orders_versions(spark, d), ["o_orderkey"])


@query("diff_orders_classified_summary", f"WITH {ORDERS_DIFF} {SUMMARY_SQL}")
def _(spark, d):
    return report.classified_summary(*orders_versions(spark, d), ["o_orderkey"])


@query("diff_orders_net_delta", f"WITH {ORDERS_DIFF}, s AS ({SUMMARY_SQL}) SELECT *, removed_count - added_count AS net_delta FROM s")
def _(spark, d):
    return signals.net_delta(diff.diff_summary(*orders_versions(spark, d), ["o_orderkey"]))


@query("diff_orders_changed_column", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d WHERE change_type <> 'changed' OR c_s")
def _(spark, d):
    return _flat_orders(_orders_rows(spark, d, changed_column="o_orderstatus"))


for _types in (["changed"], ["added"], ["removed"], ["added", "removed"]):
    _list = ", ".join(f"'{t}'" for t in _types)

    @query(f"diff_orders_only_{'_'.join(_types)}", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d WHERE change_type IN ({_list})")
    def _(spark, d, types=tuple(_types)):
        return _flat_orders(_orders_rows(spark, d, change_types=types))


@query("diff_orders_key_filter", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d WHERE k::VARCHAR = '87'")
def _(spark, d):
    return _flat_orders(_orders_rows(spark, d, key_filter=diff.parse_key_filter("o_orderkey=87", ["o_orderkey"])))


@query("diff_orders_page", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d ORDER BY k NULLS LAST, change_type LIMIT 100 OFFSET 100")
def _(spark, d):
    return _flat_orders(diff.diff_page(_orders_rows(spark, d), 2, 100).rows)


@query("diff_orders_after_key", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d WHERE k > 1000 ORDER BY k LIMIT 100")
def _(spark, d):
    return _flat_orders(diff.diff_after(_orders_rows(spark, d), {"o_orderkey": 1000}, 100))


@query("diff_orders_sections", f"""WITH {ORDERS_DIFF} SELECT 'changed' AS change_type, key_text, pos AS position, column_name, va AS value_a, vb AS value_b FROM cells
  UNION ALL SELECT change_type, key_text, pos, column_name, CASE WHEN change_type = 'removed' THEN v END, CASE WHEN change_type = 'added' THEN v END FROM (
    SELECT change_type, key_text, 0 AS pos, 'o_custkey' AS column_name, coalesce(a_c, b_c)::VARCHAR AS v FROM d WHERE NOT m
    UNION ALL SELECT change_type, key_text, 1, 'o_orderstatus', coalesce(a_s, b_s) FROM d WHERE NOT m
    UNION ALL SELECT change_type, key_text, 2, 'o_totalprice', coalesce(a_t, b_t)::VARCHAR FROM d WHERE NOT m
    UNION ALL SELECT change_type, key_text, 3, 'o_orderpriority', coalesce(a_p, b_p) FROM d WHERE NOT m
    UNION ALL SELECT change_type, key_text, 4, 'o_orderdate', coalesce(a_d, b_d)::VARCHAR FROM d WHERE NOT m)""")
def _(spark, d):
    return signals.sections(_orders_rows(spark, d))


@query("diff_orders_walk", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d")
def _(spark, d):
    """The whole diff again, page after page, each starting after the last row of the one before."""
    rows = _orders_rows(spark, d)
    size, pages, last = rows.count() // 3 + 1, [], None
    while True:
        page = diff.diff_after(rows, last, size)
        end = page.orderBy(*diff.diff_order(page), "copy").tail(1)
        if not end:
            break
        pages.append(page.drop("copy"))
        last = end[0]
    return _flat_orders(reduce(DataFrame.unionAll, pages))


_STORED_DIFFS: dict[tuple[str, str], pages.StoredPages] = {}


def _stored_diff(spark, d) -> pages.StoredPages:
    """The diff of orders in the order of its pages, stored once per session."""
    known = spark.sparkContext.applicationId, d
    if known not in _STORED_DIFFS:
        _STORED_DIFFS[known] = pages.store_diff(_orders_rows(spark, d), shared_path(spark, "orders-diff"))
    return _STORED_DIFFS[known]


@query("diff_stored_page", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS}, row_number() OVER (ORDER BY k, change_type) - 1 AS position FROM d ORDER BY k, change_type LIMIT 50 OFFSET 300")
def _(spark, d):
    page = pages.page_of(_stored_diff(spark, d), page=7, page_size=50).rows
    return _flat_orders(page)


@query("diff_stored_walk", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS}, row_number() OVER (ORDER BY k, change_type) - 1 AS position FROM d")
def _(spark, d):
    """The whole diff again, page after page."""
    stored = _stored_diff(spark, d)
    size = max(1, -(-stored.total // 5))
    return _flat_orders(reduce(DataFrame.unionAll, [pages.page_of(stored, k + 1, size).rows for k in range(-(-stored.total // size))]))


@query("browse_stored_page", "SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS position FROM (SELECT * EXCLUDE l_shipdate, l_shipdate::VARCHAR AS l_shipdate FROM lineitem) ORDER BY position LIMIT 100 OFFSET 1000")
def _(spark, d):
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    stored = pages.store_pages(table(spark, d, "lineitem"), order, shared_path(spark, "lineitem-pages"))
    return as_text(pages.rows_at(stored, 1000, 100), "l_shipdate")


@query("diff_part_composite_key", f"""WITH {PART} SELECT coalesce(a.p_partkey, b.p_partkey) AS key_p_partkey, coalesce(a.p_name, b.p_name) AS key_p_name,
  CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change_type,
  a.p_brand AS a_p_brand, b.p_brand AS b_p_brand, a.p_retailprice AS a_p_retailprice, b.p_retailprice AS b_p_retailprice,
  CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' END,
    CASE WHEN a.p_retailprice <> b.p_retailprice THEN 'p_retailprice' END) END AS changed
  FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey AND a.p_name = b.p_name
  WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_brand <> b.p_brand OR a.p_retailprice <> b.p_retailprice""")
def _(spark, d):
    return diff.flat_diff(diff.keyed_diff(*part_versions(spark, d), ["p_partkey", "p_name"], ["p_brand", "p_retailprice"]).rows)


LINE_VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINES_JOIN = f"""j AS (SELECT a.l_orderkey AS ka, b.l_orderkey AS kb, coalesce(a.l_orderkey, b.l_orderkey) AS k1, coalesce(a.l_linenumber, b.l_linenumber) AS k2,
  {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in LINE_VALUES)}
  FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber),
f AS (SELECT *, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed'
  WHEN {" OR ".join(f"a_{c} IS DISTINCT FROM b_{c}" for c in LINE_VALUES)} THEN 'changed' ELSE 'same' END AS change_type FROM j)"""


@query("diff_lineitem_repeated_keys", f"""WITH {LINES}, {LINES_JOIN} SELECT k1 AS key_l_orderkey, k2 AS key_l_linenumber, change_type,
  {", ".join(f"{s}_{c}::VARCHAR AS {s}_{c}" if c == "l_shipdate" else f"{s}_{c}" for c in LINE_VALUES for s in "ab")},
  concat_ws(',', {", ".join(f"CASE WHEN a_{c} <> b_{c} THEN '{c}' END" for c in LINE_VALUES)}) AS changed FROM f WHERE change_type <> 'same'""")
def _(spark, d):
    rows = diff.keyed_diff(*lineitem_versions(spark, d), ["l_orderkey", "l_linenumber"]).rows
    return as_text(diff.flat_diff(rows), "a_l_shipdate", "b_l_shipdate")


@query("diff_lineitem_repeated_keys_summary", f"WITH {LINES}, {LINES_JOIN} {SUMMARY_SQL}")
def _(spark, d):
    return diff.diff_summary(*lineitem_versions(spark, d), ["l_orderkey", "l_linenumber"])


@query("repeated_keys_lineitem", """SELECT l_orderkey, l_linenumber, count(*) AS rows_a, count(*) AS rows_b FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    return diff.repeated_keys(*lineitem_versions(spark, d), ["l_orderkey", "l_linenumber"])


# Three keys hold all rows of both sides: described by their versions, in the size of the input.
FLAGS_SQL = f"""WITH {LINES}, v AS (SELECT l_returnflag, l_quantity, count(*) FILTER (side = 'a') AS rows_a, count(*) FILTER (side = 'b') AS rows_b
  FROM (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b) GROUP BY 1, 2)"""


@query("diff_crowded_versions", f"{FLAGS_SQL} SELECT l_returnflag AS key_text, l_quantity AS version_quantity, rows_a, rows_b FROM v")
def _(spark, d):
    return diff.repeated_versions(*lineitem_versions(spark, d), ["l_returnflag"], ["l_quantity"]).select(
        F.col("key.l_returnflag").alias("key_text"), F.col("version.l_quantity").alias("version_quantity"), "rows_a", "rows_b"
    )


@query("diff_crowded_summary", f"""{FLAGS_SQL}, k AS (SELECT l_returnflag, sum(rows_a) AS na, sum(rows_b) AS nb, sum(rows_a * rows_b) AS eq FROM v GROUP BY 1)
  SELECT sum(na)::BIGINT AS rows_a, sum(nb)::BIGINT AS rows_b, sum(na * nb)::BIGINT AS keys_total, sum(eq)::BIGINT AS same_count, 0::BIGINT AS added_count, 0::BIGINT AS removed_count,
  sum(na * nb - eq)::BIGINT AS changed_count FROM k""")
def _(spark, d):
    return diff.diff_summary(*lineitem_versions(spark, d), ["l_returnflag"], ["l_quantity"])


# Every key repeats and the largest are dealt out: all pairs, and what the signals make of them.
PART_PAIRS = f"""WITH {LINES}, j AS (SELECT coalesce(a.l_partkey, b.l_partkey) AS k, a.l_partkey AS ka, b.l_partkey AS kb, a.l_quantity AS qa, b.l_quantity AS qb
  FROM a FULL OUTER JOIN b ON a.l_partkey = b.l_partkey),
d AS (SELECT *, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN qa IS DISTINCT FROM qb THEN 'changed' END AS change_type FROM j)"""


@query("diff_repeated_pairs", f"""{PART_PAIRS} SELECT k::BIGINT AS key, change_type, count(*)::BIGINT AS pairs, sum(coalesce(qa, 0))::BIGINT AS sum_a, sum(coalesce(qb, 0))::BIGINT AS sum_b
  FROM d WHERE change_type IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    rows = diff.keyed_diff(*lineitem_versions(spark, d), ["l_partkey"], ["l_quantity"], hot_rows=20, nulls_joined=True).rows
    quantity = {s: F.sum(F.coalesce(F.col(f"{s}.l_quantity"), F.lit(0))).cast("bigint").alias(f"sum_{s}") for s in "ab"}
    return rows.groupBy(F.col("key.l_partkey").cast("bigint").alias("key"), "change_type").agg(F.count("*").alias("pairs"), quantity["a"], quantity["b"])


@query("signal_repeated_drift", f"""{PART_PAIRS} SELECT 'l_quantity' AS column_name, count(*)::BIGINT AS drift_count, sum(abs(qa - qb))::BIGINT AS sum_abs_delta
  FROM d WHERE change_type = 'changed' AND qa - qb <> 0""")
def _(spark, d):
    rows = diff.keyed_diff(*lineitem_versions(spark, d), ["l_partkey"], ["l_quantity"], hot_rows=20).rows
    return signals.numeric_drift(rows).select("column_name", "drift_count", F.col("sum_abs_delta").cast("bigint").alias("sum_abs_delta"))


# Three keys hold all rows: a diff row stands for all pairs of its two versions, and the signals count by its weight.
CROWD = ["l_linestatus", "l_quantity"]
WEIGHTED_SQL = f"""WITH {LINES}, va AS (SELECT l_returnflag, {", ".join(CROWD)}, count(*) AS n FROM a GROUP BY ALL), vb AS (SELECT l_returnflag, {", ".join(CROWD)}, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT va.l_returnflag AS k, va.l_linestatus AS sa, vb.l_linestatus AS sb, va.l_quantity AS qa, vb.l_quantity AS qb, va.n * vb.n AS w,
  concat_ws(', ', CASE WHEN va.l_linestatus <> vb.l_linestatus THEN 'l_linestatus' END, CASE WHEN va.l_quantity <> vb.l_quantity THEN 'l_quantity' END) AS changed,
  (va.l_linestatus <> vb.l_linestatus)::INT + (va.l_quantity <> vb.l_quantity)::INT AS n_changed
  FROM va JOIN vb USING (l_returnflag)), ch AS (SELECT *, 'l_returnflag="' || k || '"' AS key_text FROM d WHERE n_changed > 0)"""


def _crowded_rows(spark, d):
    return diff.keyed_diff(*lineitem_versions(spark, d), ["l_returnflag"], CROWD, weighted=True).rows


@query("diff_crowded_weights", f"{WEIGHTED_SQL} SELECT k AS key_text, changed, count(*) AS row_count, sum(w)::BIGINT AS pairs FROM ch GROUP BY 1, 2")
def _(spark, d):
    rows = _crowded_rows(spark, d)
    return rows.groupBy(F.col("key.l_returnflag").alias("key_text"), F.array_join("changed_columns", ", ").alias("changed")).agg(
        F.count("*").alias("row_count"), F.sum("weight").alias("pairs"))


@query("signal_crowded_patterns", f"{WEIGHTED_SQL} SELECT changed AS pattern, sum(w)::BIGINT AS row_count, min(key_text) AS sample_key FROM ch GROUP BY 1")
def _(spark, d):
    return signals.change_patterns(_crowded_rows(spark, d), None)


@query("signal_crowded_states", f"{WEIGHTED_SQL} SELECT sb || ' -> ' || sa AS transition, sum(w)::BIGINT AS row_count FROM ch GROUP BY 1")
def _(spark, d):
    return signals.state_transitions(_crowded_rows(spark, d), ["l_linestatus"], top=None)


@query("signal_crowded_families", f"""{WEIGHTED_SQL}, g AS (SELECT sa AS family, sb || ' => ' || sa AS tr, sum(w) AS n, sum(w * (n_changed + CASE WHEN sa <> sb THEN 3 ELSE 0 END)) AS score, min(key_text) AS key_text FROM ch GROUP BY 1, 2)
  SELECT family, sum(n)::BIGINT AS row_count, sum(score)::BIGINT AS score, min(key_text) AS sample_key, arg_min(tr, (-n, tr)) AS top_transition FROM g GROUP BY 1""")
def _(spark, d):
    return signals.family_risk(_crowded_rows(spark, d), ["l_linestatus"], ["l_linestatus"], top=None)


@query("signal_crowded_risk", f"""{WEIGHTED_SQL}, r AS (SELECT key_text, w, n_changed + CASE WHEN sa <> sb THEN 2 ELSE 0 END AS score FROM ch)
  SELECT key_text, sum(w * score)::BIGINT AS risk_score, sum(w)::BIGINT AS row_count FROM r WHERE score >= 4 GROUP BY 1""")
def _(spark, d):
    return signals.risk_by_key(signals.risk_rows(_crowded_rows(spark, d), ["l_linestatus"]), None)


@query("signal_crowded_key_quality", f"{WEIGHTED_SQL} SELECT 0::BIGINT AS blank_key_rows, sum(w)::BIGINT - count(DISTINCT k) AS duplicate_key_rows, count(DISTINCT k) AS unique_keys FROM ch")
def _(spark, d):
    return signals.key_quality(_crowded_rows(spark, d))


@query("signal_crowded_counts", f"""{WEIGHTED_SQL}, t AS (SELECT sum(w)::BIGINT AS total_keys FROM d)
  SELECT sum(w)::BIGINT AS impacted_keys, (SELECT total_keys FROM t) AS total_keys, sum(w)::BIGINT AS changed_count, 0::BIGINT AS null_transitions_total,
  max(qa <> qb)::BIGINT AS drift_columns, coalesce(sum(w) FILTER (n_changed + CASE WHEN sa <> sb THEN 2 ELSE 0 END >= 4), 0)::BIGINT AS risk_row_count FROM ch""")
def _(spark, d):
    a, b = lineitem_versions(spark, d)
    summary = diff.diff_summary(a, b, ["l_returnflag"], CROWD)
    return signals.signal_counts(_crowded_rows(spark, d), summary, ["l_linestatus"]).select(
        "impacted_keys", "total_keys", "changed_count", "null_transitions_total", "drift_columns", "risk_row_count")


# The same three keys over all columns, where nearly every version is its own: from counts of values, no pair is formed.
def _line_counts(spark, d):
    return crowded.value_counts(*lineitem_versions(spark, d), ["l_returnflag"])


ALL_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


@query("signal_value_count_changes", f"WITH {LINES}" + "".join(
    f""", c{i} AS (SELECT sum(na * nb - eq) AS changes FROM (SELECT k, sum(na) AS na, sum(nb) AS nb, sum(na * nb) AS eq FROM (SELECT k, v, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb
    FROM (SELECT l_returnflag AS k, {c} AS v, 'a' AS s FROM a UNION ALL SELECT l_returnflag, {c}, 'b' FROM b) GROUP BY 1, 2) GROUP BY 1))""" for i, c in enumerate(ALL_LINE_COLUMNS))
    + " SELECT column_name, changes FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, changes::BIGINT AS changes FROM c{i}" for i, c in enumerate(ALL_LINE_COLUMNS)) + ") WHERE changes > 0")
def _(spark, d):
    return crowded.column_changes(_line_counts(spark, d), None)


@query("signal_value_count_drift", f"WITH {LINES}" + "".join(
    f""", v{i} AS (SELECT k, v, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb FROM (SELECT l_returnflag AS k, {c}::DOUBLE AS v, 'a' AS s FROM a UNION ALL SELECT l_returnflag, {c}, 'b' FROM b) GROUP BY 1, 2),
    g{i} AS (SELECT *, sum(na) OVER u AS ca, sum(nb) OVER u AS cb, sum(na) OVER (PARTITION BY k) AS ta, sum(nb) OVER (PARTITION BY k) AS tb, lead(v) OVER (PARTITION BY k ORDER BY v) - v AS gap FROM v{i} WINDOW u AS (PARTITION BY k ORDER BY v)),
    c{i} AS (SELECT (SELECT sum(n) FROM (SELECT sum(na) * sum(nb) - sum(na * nb) AS n FROM v{i} GROUP BY k)) AS n, sum(gap * (ca * (tb - cb) + cb * (ta - ca))) AS total,
      (SELECT max(greatest(x, y)) FROM (SELECT max(v) FILTER (na > 0) - min(v) FILTER (nb > 0) AS x, max(v) FILTER (nb > 0) - min(v) FILTER (na > 0) AS y FROM v{i} GROUP BY k)) AS most FROM g{i})""" for i, c in enumerate(ALL_LINE_COLUMNS[:8]))
    + " SELECT column_name, n::BIGINT AS drift_count, round(total / 1000000)::BIGINT AS millions, round(most, 2) AS max_abs_delta FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, n, total, most FROM c{i}" for i, c in enumerate(ALL_LINE_COLUMNS[:8])) + ")")
def _(spark, d):
    drift = crowded.numeric_drift(_line_counts(spark, d), top=None)
    return drift.select("column_name", "drift_count", F.round(F.col("sum_abs_delta") / 1000000).cast("bigint").alias("millions"), F.round("max_abs_delta", 2).alias("max_abs_delta"))


@query("signal_value_count_nulls", f"""WITH {ORDERS}, p AS (SELECT a.o_orderstatus AS k, count(*) FILTER (a.o_orderpriority IS NULL) AS na, count(*) AS ta FROM a GROUP BY 1),
  q AS (SELECT b.o_orderstatus AS k, count(*) FILTER (b.o_orderpriority IS NULL) AS nb, count(*) AS tb FROM b GROUP BY 1)
  SELECT 'o_orderpriority' AS column_name, unnest(['vazio -> preenchido', 'preenchido -> vazio']) AS direction, unnest([sum(nb * (ta - na)), sum((tb - nb) * na)])::BIGINT AS transitions FROM p JOIN q USING (k)""")
def _(spark, d):
    return crowded.null_transitions(crowded.value_counts(*orders_versions(spark, d), ["o_orderstatus"]), top=None)


NULL_JOIN = """j AS (SELECT a.c_custkey AS ka, b.c_custkey AS kb, a.c_name AS na, b.c_name AS nb, a.c_acctbal AS xa, b.c_acctbal AS xb,
  a.c_nationkey AS ga, b.c_nationkey AS gb, a.c_mktsegment AS ma, b.c_mktsegment AS mb,
  a.c_name IS NOT NULL AS in_a, b.c_name IS NOT NULL AS in_b FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey),
f AS (SELECT *, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' WHEN xa <> xb THEN 'changed' ELSE 'same' END AS change_type FROM j)"""


@query("diff_null_keys", f"""WITH {NULL_KEYS}, {NULL_JOIN} SELECT coalesce(ka, kb)::VARCHAR AS key_c_custkey, change_type, na AS a_c_name, nb AS b_c_name,
  xa AS a_c_acctbal, xb AS b_c_acctbal, ga::VARCHAR AS a_c_nationkey, gb::VARCHAR AS b_c_nationkey, ma AS a_c_mktsegment, mb AS b_c_mktsegment, CASE WHEN change_type = 'changed' THEN 'c_acctbal' ELSE '' END AS changed FROM f WHERE change_type <> 'same'""")
def _(spark, d):
    return as_text(diff.flat_diff(diff.keyed_diff(*null_key_versions(spark, d), ["c_custkey"]).rows), "key_c_custkey", "a_c_nationkey", "b_c_nationkey")


@query("diff_null_keys_summary", f"WITH {NULL_KEYS}, {NULL_JOIN} {SUMMARY_SQL}")
def _(spark, d):
    return diff.diff_summary(*null_key_versions(spark, d), ["c_custkey"])


# --- content diff, overview, keys --------------------------------------------------------------

EXCEPT_SQL = """(SELECT count(*) FROM ((SELECT * FROM {a} EXCEPT SELECT * FROM {b}) UNION ALL (SELECT * FROM {b} EXCEPT SELECT * FROM {a})))"""


@query("content_diff_part", f"WITH {PART} SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, {EXCEPT_SQL.format(a='a', b='b')} AS diff_count")
def _(spark, d):
    return content_diff.content_diff(*part_versions(spark, d))


@query("content_diff_lineitem", f"WITH {LINES} SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, {EXCEPT_SQL.format(a='a', b='b')} AS diff_count")
def _(spark, d):
    return content_diff.content_diff(*lineitem_versions(spark, d))


@query("content_one_sided_part", f"WITH {PART} SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, d):
    return content_diff.one_sided_rows(*part_versions(spark, d))


OVERVIEW_SQL = f"""WITH {PART}, oa AS (WITH {ORDERS} SELECT * FROM a),
o2 AS (WITH {ORDERS} SELECT * FROM b),
ov AS (SELECT 'orders' AS table_name, (SELECT count(*) FROM oa) AS row_count_a, (SELECT count(*) FROM o2) AS row_count_b, {EXCEPT_SQL.format(a='oa', b='o2')} AS diff_count
  UNION ALL SELECT 'part', (SELECT count(*) FROM a), (SELECT count(*) FROM b), {EXCEPT_SQL.format(a='a', b='b')}
  UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), 0
  UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), (SELECT count(*) FROM region), -1),
o AS (SELECT table_name, CASE WHEN diff_count < 0 THEN 'no_key' WHEN diff_count = 0 THEN 'same' ELSE 'diff' END AS status, row_count_a, row_count_b,
  diff_count, CASE WHEN diff_count < 0 THEN 'tabela sem colunas em comum' END AS error FROM ov)"""


def _databases(spark, d):
    a = tables(spark, d, "nation", "labels", "supplier")
    b = {"nation": a["nation"], "labels": table(spark, d, "region")}
    a["part"], b["part"] = part_versions(spark, d)
    a["orders"], b["orders"] = orders_versions(spark, d)
    return a, b


@query("overview_tables", f"{OVERVIEW_SQL} SELECT * FROM o")
def _(spark, d):
    return content_diff.overview_plan(*_databases(spark, d))


@query("overview_tables_side_by_side", f"{OVERVIEW_SQL} SELECT * FROM o WHERE table_name <> 'part'")
def _(spark, d):
    return content_diff.overview(spark, *_databases(spark, d), tables=[" orders ", "orders", "nation", "labels", ""])


@query("overview_summary", f"""{OVERVIEW_SQL} SELECT count(*) AS total_tables, count(*) FILTER (status = 'same') AS same_tables,
  count(*) FILTER (status = 'diff') AS diff_tables, count(*) FILTER (status = 'no_key') AS no_key_tables, count(*) FILTER (status = 'error') AS error_tables FROM o""")
def _(spark, d):
    return content_diff.overview_summary(content_diff.overview_plan(*_databases(spark, d)))


@query("overview_report_tables", f"{OVERVIEW_SQL} SELECT table_name, status, diff_count FROM o WHERE status <> 'same'")
def _(spark, d):
    return content_diff.report_order(content_diff.overview_plan(*_databases(spark, d))).select("table_name", "status", "diff_count")


def _key_sql(columns: str, a: str, b: str) -> str:
    one = ("SELECT '{side}' AS side, '{c}' AS key_columns, sum(copies)::BIGINT AS total_rows, count(*) AS distinct_keys, "
           "count(*) FILTER (copies > 1) AS repeated_keys, max(copies) = 1 AS is_unique FROM (SELECT count(*) AS copies FROM {t} GROUP BY {c})")
    return one.format(side="a", c=columns, t=a) + " UNION ALL " + one.format(side="b", c=columns, t=b)


@query("infer_keys_orders", f"WITH {ORDERS} {_key_sql('o_orderkey', 'a', 'b')}")
def _(spark, d):
    a, b = orders_versions(spark, d)
    return keys.key_evidence(a, b, keys.infer_keys(a, b))


# No single column is unique; of the pairs this is the first that is.
@query("infer_keys_lineitem", f"WITH {LINES} {_key_sql('l_orderkey,l_extendedprice', 'a', 'b')}")
def _(spark, d):
    a, b = lineitem_versions(spark, d)
    return keys.key_evidence(a, b, keys.infer_keys(a, b))


@query("infer_minimal_keys", "SELECT * FROM (VALUES ('labels', 'doc_id'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('conversations', 'text'), ('conversations', 'conv_id,turn')) AS t(table_name, key_columns)")
def _(spark, d):
    found = [(n, ",".join(k)) for n in ("labels", "nation", "conversations") for k in keys.minimal_keys(table(spark, d, n), table(spark, d, n))]
    return spark.createDataFrame(found, "table_name STRING, key_columns STRING")


@query("infer_keys_conversations", _key_sql("text", "conversations", "conversations"))
def _(spark, d):
    turns = table(spark, d, "conversations")
    return keys.key_evidence(turns, turns, keys.infer_keys(turns, turns))


# --- signals -----------------------------------------------------------------------------------


@query("signal_column_changes", f"WITH {ORDERS_DIFF} SELECT column_name, count(*) AS changes FROM cells GROUP BY 1")
def _(spark, d):
    return signals.column_changes(_orders_rows(spark, d))


@query("signal_first_keys", f"WITH {ORDERS_DIFF} SELECT column_name, arg_min(key_text, k) AS first_key FROM cells GROUP BY 1")
def _(spark, d):
    return signals.first_key_per_column(_orders_rows(spark, d), top=12)


@query("signal_highlights", f"WITH {ORDERS_DIFF} SELECT change_type, arg_min(key_text, k) AS first_key, arg_min(changed, k) AS changed_columns FROM d GROUP BY 1")
def _(spark, d):
    return signals.highlights(_orders_rows(spark, d))


@query("signal_null_transitions", f"""WITH {ORDERS_DIFF} SELECT column_name, CASE WHEN vb IS NULL THEN 'vazio -> preenchido' ELSE 'preenchido -> vazio' END AS direction,
  count(*) AS transitions FROM cells WHERE (va IS NULL) <> (vb IS NULL) GROUP BY 1, 2""")
def _(spark, d):
    return signals.null_transitions(_orders_rows(spark, d))


@query("signal_numeric_drift", f"""WITH {ORDERS_DIFF}, x AS (SELECT column_name, round(na - nb, 4) AS dl FROM cells WHERE na IS NOT NULL AND nb IS NOT NULL AND na <> nb)
  SELECT column_name, count(*) AS drift_count, round(sum(abs(dl)), 2) AS sum_abs_delta, round(max(abs(dl)), 2) AS max_abs_delta,
  round(arg_max(dl, abs(dl)), 2) AS max_signed_delta FROM x GROUP BY 1""")
def _(spark, d):
    drift = signals.numeric_drift(_orders_rows(spark, d))
    rounded = [F.round(c, 2).alias(c) for c in ("sum_abs_delta", "max_abs_delta", "max_signed_delta")]
    return drift.select("column_name", "drift_count", *rounded)


@query("signal_patterns", f"""WITH {ORDERS_DIFF} SELECT changed AS pattern, count(*) AS row_count, arg_min(key_text, k) AS sample_key FROM ch
  GROUP BY 1 ORDER BY row_count DESC, pattern LIMIT 5""")
def _(spark, d):
    return signals.change_patterns(_orders_rows(spark, d))


@query("signal_priority_keys", f"WITH {ORDERS_DIFF} SELECT key_text, n_changed, changed AS changed_columns FROM ch ORDER BY n_changed DESC, k LIMIT 5")
def _(spark, d):
    return signals.priority_keys(_orders_rows(spark, d))


@query("signal_high_impact", f"WITH {ORDERS_DIFF} SELECT key_text, n_changed FROM ch WHERE n_changed >= 2")
def _(spark, d):
    return signals.high_impact_rows(_orders_rows(spark, d), least=2, top=None)


@query("signal_state_transitions", f"WITH {ORDERS_DIFF} SELECT old || ' -> ' || new AS transition, count(*) AS row_count FROM states GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def _(spark, d):
    return signals.state_transitions(_orders_rows(spark, d), STATE)


@query("signal_transition_risk", f"WITH {ORDERS_DIFF} SELECT old || ' => ' || new AS transition, count(*) AS row_count FROM states GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return signals.transition_risk(_orders_rows(spark, d), STATE)


@query("signal_families", f"WITH {ORDERS_DIFF} SELECT fam AS family, count(*) AS row_count FROM states WHERE fam <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def _(spark, d):
    return signals.family_counts(_orders_rows(spark, d), FAMILY)


@query("signal_family_risk", f"""WITH {ORDERS_DIFF}, g AS (SELECT CASE WHEN fam = '' THEN 'familia nao identificada' ELSE fam END AS family, old || ' => ' || new AS tr,
    n_changed + CASE WHEN old <> new THEN 3 ELSE 0 END AS score, k, key_text FROM states),
  t AS (SELECT family, tr, count(*) AS n FROM g GROUP BY 1, 2),
  best AS (SELECT family, tr FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, tr) AS r FROM t) WHERE r = 1)
  SELECT family, count(*) AS row_count, sum(score)::BIGINT AS score, arg_min(key_text, k) AS sample_key, any_value(best.tr) AS top_transition
  FROM g JOIN best USING (family) GROUP BY family ORDER BY score DESC, family LIMIT 6""")
def _(spark, d):
    return signals.family_risk(_orders_rows(spark, d), STATE, FAMILY)


RISK_SQL = "CASE WHEN old <> '' AND new <> '' THEN old || ' => ' || new ELSE 'sem transicao' END AS transition"


@query("signal_risk_rows", f"WITH {ORDERS_DIFF} SELECT key_text, score AS risk_score, changed AS first_columns, {RISK_SQL} FROM risk WHERE score >= 4")
def _(spark, d):
    return signals.risk_rows(_orders_rows(spark, d), STATE).drop("o")


@query("signal_top_risk_rows", f"WITH {ORDERS_DIFF} SELECT key_text, score AS risk_score, changed AS first_columns, {RISK_SQL} FROM risk WHERE score >= 4 ORDER BY score DESC, k LIMIT 6")
def _(spark, d):
    return signals.top_risk_rows(signals.risk_rows(_orders_rows(spark, d), STATE))


@query("signal_risk_by_key", f"WITH {ORDERS_DIFF} SELECT key_text, sum(score)::BIGINT AS risk_score, count(*) AS row_count FROM risk WHERE score >= 4 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def _(spark, d):
    return signals.risk_by_key(signals.risk_rows(_orders_rows(spark, d), STATE))


@query("signal_key_quality", f"WITH {NULL_KEYS}, {NULL_JOIN}, d AS (SELECT coalesce(coalesce(ka, kb)::VARCHAR, '') AS t FROM f WHERE change_type <> 'same') SELECT count(*) FILTER (t = '') AS blank_key_rows, count(*) - count(DISTINCT t) AS duplicate_key_rows, count(DISTINCT t) AS unique_keys FROM d")
def _(spark, d):
    return signals.key_quality(diff.keyed_diff(*null_key_versions(spark, d), ["c_custkey"]).rows)


COUNTS_SQL = f"""WITH {ORDERS_DIFF}, s AS ({SUMMARY_SQL}), c AS (SELECT added_count + removed_count + changed_count AS impacted_keys, keys_total AS total_keys,
    added_count, removed_count, changed_count,
    (SELECT count(*) FROM cells WHERE (va IS NULL) <> (vb IS NULL)) AS null_transitions_total,
    (SELECT count(*) FROM (SELECT DISTINCT column_name, va IS NULL FROM cells WHERE (va IS NULL) <> (vb IS NULL))) AS null_transition_kinds,
    (SELECT count(DISTINCT column_name) FROM cells WHERE na <> nb) AS drift_columns,
    (SELECT count(*) FROM risk WHERE score >= 4) AS risk_row_count, (SELECT count(*) FROM ch WHERE n_changed >= 6) AS high_impact_count FROM s),
  v AS (SELECT *, impacted_keys / total_keys * 100 AS pct FROM c)"""


def _counts(spark, d, scope="all_keys"):
    a, b = orders_versions(spark, d)
    rows = diff.keyed_diff(a, b, ["o_orderkey"]).rows
    return signals.signal_counts(rows, diff.diff_summary(a, b, ["o_orderkey"]), STATE, scope=scope)


@query("signal_counts", f"{COUNTS_SQL} SELECT * EXCLUDE (pct), " + _r("pct", 4) + " AS impacted_pct FROM v")
def _(spark, d):
    return _counts(spark, d).withColumn("impacted_pct", _rounded(F.col("impacted_pct"), 4))


@query("signal_severity", f"""{COUNTS_SQL} SELECT CASE WHEN pct >= 50 OR risk_row_count >= 4 THEN 'critica' WHEN pct >= 25 OR risk_row_count >= 2 OR null_transitions_total >= 4 THEN 'alta'
  WHEN pct >= 10 OR drift_columns >= 2 THEN 'media' WHEN impacted_keys = 0 THEN 'estavel' ELSE 'baixa' END AS severity,
  concat_ws(' · ', printf('%d/%d chave(s) impactadas (%.1f%%)', impacted_keys, total_keys, pct), CASE WHEN risk_row_count > 0 THEN risk_row_count || ' chave(s) com risco >= 4' END,
   CASE WHEN null_transitions_total > 0 THEN null_transitions_total || ' transicao(oes) vazio/preenchido' END, CASE WHEN drift_columns > 0 THEN drift_columns || ' coluna(s) com drift numerico' END) AS reasons FROM v""")
def _(spark, d):
    return signals.severity(_counts(spark, d)).select("severity", "reasons")


@query("signal_report_priority", f"""{COUNTS_SQL} SELECT impacted_keys AS total_keys, CASE WHEN impacted_keys > 0 THEN 'critica' ELSE 'estavel' END AS priority FROM v""")
def _(spark, d):
    return signals.report_priority(_counts(spark, d, "diff_rows")).select("total_keys", "priority")


@query("signal_actions", f"""{COUNTS_SQL}, l AS (SELECT [x FOR x IN [
    CASE WHEN high_impact_count > 0 THEN 'Revisar primeiro as chaves com alto impacto (topo da lista de anomalias prioritarias).' END,
    CASE WHEN risk_row_count > 0 THEN 'Validar manualmente as chaves com risco operacional acima de 3.' END,
    CASE WHEN null_transitions_total > 0 THEN 'Conferir transicoes de vazio/preenchido antes de promover alteracoes.' END,
    CASE WHEN drift_columns > 0 THEN 'Auditar os maiores deltas numericos para evitar regressao de valores.' END,
    CASE WHEN pct >= 25 THEN 'volume' END] IF x IS NOT NULL] AS lines FROM v)
  SELECT (i - 1)::INT AS position, lines[i] AS action FROM (SELECT lines, unnest(range(1, len(lines) + 1)) AS i FROM l)""")
def _(spark, d):
    return signals.recommended_actions(_counts(spark, d))


@query("signal_priority_anomalies", f"""WITH {ORDERS_DIFF}, x AS (SELECT column_name, na - nb AS dl FROM cells WHERE na <> nb),
  items AS (SELECT * FROM (SELECT score * 3.0::DOUBLE AS score, 'Risco operacional: ' || key_text AS label FROM risk WHERE score >= 4)
   UNION ALL SELECT round(sum(abs(dl)), 2), 'Drift numerico: ' || column_name FROM x GROUP BY column_name
   UNION ALL SELECT * FROM (SELECT count(*) * 2.0::DOUBLE, 'Transicao concentrada: ' || old || ' => ' || new FROM states GROUP BY old, new))
  SELECT score, label FROM items ORDER BY score DESC, label LIMIT 8""")
def _(spark, d):
    found = signals.priority_anomalies(_orders_rows(spark, d), STATE)
    return found.select(F.round("score", 2).alias("score"), "label")


@query("signal_export_anomalies", f"""WITH {ORDERS_DIFF}, x AS (SELECT column_name, na - nb AS dl FROM cells WHERE na <> nb),
  items AS (SELECT count(*) * 4.0::DOUBLE AS score, 'coluna impactada: ' || column_name AS label FROM cells GROUP BY column_name
   UNION ALL SELECT count(*) * 3.0::DOUBLE, 'transicao nulo/preenchido: ' || column_name || ' | ' || CASE WHEN vb IS NULL THEN 'vazio -> preenchido' ELSE 'preenchido -> vazio' END
     FROM cells WHERE (va IS NULL) <> (vb IS NULL) GROUP BY column_name, vb IS NULL
   UNION ALL SELECT round(sum(abs(dl)), 4), 'drift numerico: ' || column_name FROM x GROUP BY column_name)
  SELECT round(score, 2) AS score, label FROM items ORDER BY score DESC, label LIMIT 8""")
def _(spark, d):
    found = signals.export_anomalies(_orders_rows(spark, d))
    return found.select(F.round("score", 2).alias("score"), "label")


@query("signal_report_actions", f"""{COUNTS_SQL}, x AS (SELECT column_name, na - nb AS dl FROM cells WHERE na <> nb),
  items AS (SELECT count(*) * 4.0::DOUBLE AS score, 'coluna impactada: ' || column_name AS label FROM cells GROUP BY column_name
   UNION ALL SELECT count(*) * 3.0::DOUBLE, 'transicao nulo/preenchido: ' || column_name || ' | ' || CASE WHEN vb IS NULL THEN 'vazio -> preenchido' ELSE 'preenchido -> vazio' END
     FROM cells WHERE (va IS NULL) <> (vb IS NULL) GROUP BY column_name, vb IS NULL
   UNION ALL SELECT round(sum(abs(dl)), 4), 'drift numerico: ' || column_name FROM x GROUP BY column_name),
  t AS (SELECT old || ' -> ' || new AS transition, count(*) AS n FROM states GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  l AS (SELECT 1 AS o, 'Volume de mudanca alto (' || regexp_replace(printf('%.1f', pct), '[.]0$', '') || '%). Priorizar validacao por lote antes de aplicar.' AS action FROM v WHERE pct >= 25
   UNION ALL SELECT 2, 'Validar transicao dominante "' || transition || '" (' || n || ' ocorrencia(s)).' FROM t
   UNION ALL SELECT 3, 'Comecar pela anomalia de maior score: ' || label || '.' FROM (SELECT label FROM items ORDER BY score DESC, label LIMIT 1))
  SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS position, action FROM l""")
def _(spark, d):
    rows = _orders_rows(spark, d)
    return signals.report_actions(_counts(spark, d), signals.key_quality(rows), signals.state_transitions(rows, STATE), signals.export_anomalies(rows))


# --- profiles ----------------------------------------------------------------------------------


def nice_sql(x: str) -> str:
    return f"CASE WHEN {x} = round({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _cells_sql(source: str, columns: list[tuple[str, str, str]], by: str = "") -> str:
    """columns: (name, number expression or NULL, text expression)."""
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{n}' AS coluna, {n} IS NULL AS is_null, CAST({num} AS DOUBLE) AS number, {txt} AS valor FROM {source}" for n, num, txt in columns
    )


CUSTOMER_CELLS = _cells_sql("customer", [
    ("c_custkey", "c_custkey", "CAST(c_custkey AS VARCHAR)"), ("c_name", "NULL", "c_name"),
    ("c_nationkey", "c_nationkey", "CAST(c_nationkey AS VARCHAR)"), ("c_acctbal", "c_acctbal", nice_sql("c_acctbal")),
    ("c_mktsegment", "NULL", "c_mktsegment")])
PROFILE_COLUMNS = ["mean", "M2", "variancia", "desvio_padrao_pop", "variancia_amostral", "desvio_padrao_amostral", "coef_variacao"]


def _profile_sql(by: str = "", cap: int = 200000) -> str:
    """Profile of a CTE `cells`; `by` is an extra group column."""
    g = f"{by}, coluna" if by else "coluna"
    b = f"s.{by}, " if by else ""
    return f"""
vc AS (SELECT {g}, valor, count(*) AS contagem FROM cells WHERE NOT is_null GROUP BY {g}, valor),
md AS (SELECT {g}, count(*) AS dist, min_by(valor, {{'c': -contagem, 'v': valor}}) AS top_v, max(contagem) AS top_c FROM vc GROUP BY {g}),
st AS (SELECT {g}, count(*) AS n, count(*) FILTER (is_null) AS nulls, count(number) AS parsed, avg(number) AS mu, var_pop(number) AS vp, var_samp(number) AS vs,
  min(number) AS mn, max(number) AS mx, quantile_cont(number, 0.25) AS q1, quantile_cont(number, 0.5) AS q2, quantile_cont(number, 0.75) AS q3 FROM cells GROUP BY {g}),
prof AS (SELECT {b}s.coluna, CASE WHEN n - nulls > 0 AND parsed >= 0.6 * (n - nulls) THEN 'numérico' WHEN n - nulls > 0 THEN 'texto' ELSE '' END AS tipo_aparente,
  n AS linhas_lidas, nulls AS nulos, n - nulls AS linhas_nao_nulas, coalesce(dist, 0) AS distinct_est, coalesce(dist > {cap}, false) AS distinct_cap_excedido,
  parsed AS value_count, {_r('coalesce(mu, 0)', 4)} AS mean, {_r('coalesce(vp * parsed, 0)', 2)} AS "M2", {_r('coalesce(vp, 0)', 4)} AS variancia,
  {_r('coalesce(sqrt(vp), 0)', 4)} AS desvio_padrao_pop, {_r('coalesce(vs, 0)', 4)} AS variancia_amostral, {_r('coalesce(sqrt(vs), 0)', 4)} AS desvio_padrao_amostral,
  {_r('CASE WHEN mu <> 0 THEN sqrt(vp) / mu ELSE 0 END', 4)} AS coef_variacao, mn AS min,
  CASE WHEN parsed >= 0.6 * (n - nulls) THEN round(q1, 4) END AS q25_approx, CASE WHEN parsed >= 0.6 * (n - nulls) THEN round(q2, 4) END AS median_approx,
  CASE WHEN parsed >= 0.6 * (n - nulls) THEN round(q3, 4) END AS q75_approx, mx AS max, coalesce(top_v, '') AS top1_val, coalesce(top_c, 0) AS top1_count,
  CASE WHEN top_c > 0 THEN round_even(100.0 * top_c / (n - nulls), 3) END AS top1_pct_of_column, coalesce(round_even(100.0 * top_c / (n - nulls), 3) >= 50, false) AS top1_domina
  FROM st s LEFT JOIN md ON {"s." + by + " = md." + by + " AND " if by else ""}s.coluna = md.coluna)"""


def _rounded_profile(df: DataFrame) -> DataFrame:
    places = {c: 2 if c == "M2" else 4 for c in [*PROFILE_COLUMNS, "q25_approx", "median_approx", "q75_approx"]}
    return df.select(*[_rounded(col(c), places[c]).alias(c) if c in places else col(c) for c in df.columns])


@query("profile_customer", f"WITH cells AS ({CUSTOMER_CELLS}), {_profile_sql()} SELECT * FROM prof")
def _(spark, d):
    return _rounded_profile(profile.profile(table(spark, d, "customer")))


@query("profile_distinct_cap", f"WITH cells AS ({CUSTOMER_CELLS}), {_profile_sql(cap=100)} SELECT coluna, distinct_est, distinct_cap_excedido FROM prof")
def _(spark, d):
    return profile.profile(table(spark, d, "customer"), distinct_cap=100).select("coluna", "distinct_est", "distinct_cap_excedido")


@query("profile_exact_quantiles", f"""WITH {{daily}}, cells AS ({{cells}}) SELECT snapshot, coluna, round(quantile_cont(number, 0.25), 4) AS q25_approx,
  round(quantile_cont(number, 0.5), 4) AS median_approx, round(quantile_cont(number, 0.75), 4) AS q75_approx FROM cells GROUP BY 1, 2 HAVING count(number) > 0""".format(
    daily=DAILY, cells=_cells_sql("daily", [("user_id", "user_id", "''"), ("value", "value", "''")], "snapshot")))
def _(spark, d):
    df = profile.profile(events_daily(spark, d), by=["snapshot"], columns=["user_id", "value"], quantiles="exact")
    return df.select("snapshot", "coluna", *[F.round(c, 4).alias(c) for c in ("q25_approx", "median_approx", "q75_approx")])


NUMBER_TEXT_CELLS = _cells_sql(
    "(SELECT event_id, event_type, value AS amount FROM events)",
    [("event_type", "NULL", "event_type"), ("amount", "amount", nice_sql("amount"))])


@query("profile_numbers_in_text", f"WITH cells AS ({NUMBER_TEXT_CELLS}), {_profile_sql()} SELECT * FROM prof")
def _(spark, d):
    df = profile.profile(number_texts(spark, d), columns=["event_type", "amount"])
    return _rounded_profile(df)


@query("profile_raw_values", "SELECT coluna, valor, contagem FROM (SELECT *, row_number() OVER (PARTITION BY coluna ORDER BY contagem DESC, valor) AS r FROM ("
       "SELECT 'event_type' AS coluna, event_type AS valor, count(*) AS contagem FROM events GROUP BY 2 UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY 2)) WHERE r <= 10")
def _(spark, d):
    rows = profile.cells(table(spark, d, "events"), columns=["event_type", "props"], mode="raw")
    return profile.top_values(profile.value_counts(rows), 10).select("coluna", "valor", "contagem")


TOP_SQL = f"""WITH cells AS ({CUSTOMER_CELLS}), vc AS (SELECT coluna, valor, count(*) AS contagem FROM cells WHERE NOT is_null GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coluna ORDER BY contagem DESC, valor) AS posicao FROM vc) WHERE posicao <= 20)"""


@query("profile_top_values", f"{TOP_SQL} SELECT * FROM top")
def _(spark, d):
    return profile.top_values(profile.value_counts(profile.cells(table(spark, d, "customer"))))


@query("profile_others", f"""{TOP_SQL}, t AS (SELECT coluna, count(*) AS nn, count(DISTINCT valor) AS dd FROM cells WHERE NOT is_null GROUP BY 1),
  s AS (SELECT coluna, sum(contagem)::BIGINT AS shown, count(*) AS k, max(posicao) AS last FROM top GROUP BY 1)
  SELECT * FROM top UNION ALL SELECT coluna, 'OUTROS', nn - shown, last + 1 FROM t JOIN s USING (coluna) WHERE dd > k AND nn > shown""")
def _(spark, d):
    customer = table(spark, d, "customer")
    top = profile.top_values(profile.value_counts(profile.cells(customer)))
    return profile.with_others(top, profile.profile(customer))


@query("profile_bands", f"""WITH cells AS ({CUSTOMER_CELLS}), {_profile_sql()} SELECT coluna, round_even(100.0 * nulos / linhas_lidas, 3) AS nulos_pct,
  CASE WHEN coalesce(top1_pct_of_column, 0) >= 10 THEN 'alta' WHEN coalesce(top1_pct_of_column, 0) >= 2 THEN 'media' ELSE 'baixa' END AS faixa FROM prof""")
def _(spark, d):
    return profile.profile_bands(profile.profile(table(spark, d, "customer"))).select("coluna", "nulos_pct", "faixa")


DAILY_CELLS = _cells_sql("daily", [("event_type", "NULL", "event_type"), ("user_id", "user_id", "CAST(user_id AS VARCHAR)"), ("value", "value", nice_sql("value"))], "snapshot")
DAILY_COLUMNS = ["event_type", "user_id", "value"]


@query("profile_events_daily", f"WITH {DAILY}, cells AS ({DAILY_CELLS}), {_profile_sql('snapshot')} SELECT * FROM prof")
def _(spark, d):
    df = profile.profile(events_daily(spark, d), by=["snapshot"], columns=DAILY_COLUMNS)
    return _rounded_profile(df)


@query("profile_latest", f"WITH {DAILY}, cells AS ({DAILY_CELLS}), {_profile_sql('snapshot')} SELECT snapshot, coluna, linhas_lidas, nulos, distinct_est FROM prof WHERE snapshot = (SELECT max(snapshot) FROM daily)")
def _(spark, d):
    df = profile.profile(events_daily(spark, d), by=["snapshot"], columns=DAILY_COLUMNS).withColumn("table_name", F.lit("events"))
    return profile.latest_profile(df, "snapshot").select("snapshot", "coluna", "linhas_lidas", "nulos", "distinct_est")


def _daily_parts(spark, d, top=5):
    daily = events_daily(spark, d)
    profiles = profile.profile(daily, by=["snapshot"], columns=DAILY_COLUMNS)
    counts = profile.value_counts(profile.cells(daily, ["snapshot"], DAILY_COLUMNS), ["snapshot"])
    return profiles, rollup.global_counts(profile.top_values(counts, top, ["snapshot"]), "snapshot")


GLOBAL_SQL = f"""WITH {DAILY}, cells AS ({DAILY_CELLS}), vc AS (SELECT snapshot, coluna, valor, count(*) AS contagem FROM cells WHERE NOT is_null GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, coluna ORDER BY contagem DESC, valor) AS r FROM vc) WHERE r <= 5),
  gc AS (SELECT coluna, valor, sum(contagem)::BIGINT AS count_total, count(*) AS files_count FROM top GROUP BY 1, 2),
  st AS (SELECT coluna, count(*) AS n, count(*) FILTER (is_null) AS nulls, count(number) AS cnt, avg(number) AS mu, var_pop(number) AS vp, min(number) AS mn, max(number) AS mx FROM cells GROUP BY 1)"""


@query("rollup_global_counts", f"{GLOBAL_SQL} SELECT * FROM gc")
def _(spark, d):
    return _daily_parts(spark, d)[1]


# The pooled moments must equal the moments over all rows.
@query("rollup_pooled_moments", f"""{GLOBAL_SQL} SELECT coluna, CASE WHEN cnt > 0 THEN 'numérico' ELSE 'texto' END AS tipo_aparente_mais_comum, n AS linhas_lidas_sum, nulls AS nulos_sum, n - nulls AS nao_nulos_sum,
  {_r('nulls / n * 100.0', 4)} AS nulos_pct_global, cnt AS value_count_global, {_r('coalesce(mu, 0)', 4)} AS mean_global, {_r('coalesce(vp, 0)', 3)} AS var_pop_global,
  {_r('coalesce(sqrt(vp), 0)', 4)} AS std_pop_global, {_r('coalesce(sqrt(vp) / mu, 0)', 4)} AS cv_global, mn AS min_global, mx AS max_global FROM st""")
def _(spark, d):
    df = rollup.pooled_moments(_daily_parts(spark, d)[0])
    places = {"nulos_pct_global": 4, "mean_global": 4, "var_pop_global": 3, "std_pop_global": 4, "cv_global": 4}
    return df.select(*[_rounded(col(c), places[c]).alias(c) if c in places else c for c in df.columns])


@query("rollup_global_summary", f"""{GLOBAL_SQL}, best AS (SELECT coluna, valor, count_total FROM (SELECT *, row_number() OVER (PARTITION BY coluna ORDER BY count_total DESC, files_count DESC, valor) AS r FROM gc) WHERE r = 1),
  ls AS (SELECT coluna, count(DISTINCT valor) AS k FROM gc GROUP BY 1)
  SELECT coluna, CASE WHEN cnt > 0 THEN 'numérico' ELSE 'texto' END AS tipo_aparente, k AS distinct_global, {_r('nulls / n * 100.0', 4)} AS nulos_pct_global, {_r('coalesce(mu, 0)', 4)} AS mean_global,
  {_r('coalesce(sqrt(vp), 0)', 4)} AS std_pop_global, {_r('coalesce(vp, 0)', 3)} AS var_pop_global, {_r('coalesce(sqrt(vp) / mu, 0)', 4)} AS cv_global, valor AS valor_mais_frequente_global,
  {_r('count_total / (n - nulls) * 100.0', 4)} AS pct_valor_mais_freq_nao_nulos_global FROM st JOIN best USING (coluna) JOIN ls USING (coluna)""")
def _(spark, d):
    df = rollup.global_summary(*_daily_parts(spark, d))
    places = {"var_pop_global": 3}
    return df.select(*[_rounded(col(c), places.get(c, 4)).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("rollup_exact_distinct", f"{GLOBAL_SQL} SELECT coluna, count(DISTINCT valor) AS distinct_global FROM cells WHERE NOT is_null GROUP BY 1")
def _(spark, d):
    profiles, counts = _daily_parts(spark, d)
    values = profile.value_counts(profile.cells(events_daily(spark, d), ["snapshot"], DAILY_COLUMNS))
    exact = values.groupBy("coluna").agg(F.count("*").alias("distinct_global"))
    return rollup.global_summary(profiles, counts, exact).select("coluna", "distinct_global")


@query("rollup_global_top", f"{GLOBAL_SQL} SELECT coluna, valor, count_total, files_count, posicao FROM (SELECT *, row_number() OVER (PARTITION BY coluna ORDER BY files_count DESC, count_total DESC, valor) AS posicao FROM gc) WHERE posicao <= 10")
def _(spark, d):
    return rollup.global_top(_daily_parts(spark, d)[1], 10).select("coluna", "valor", "count_total", "files_count", "posicao")


# --- text index and search ---------------------------------------------------------------------

# Columns of every table, and its key by name.
COLUMNS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props", "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label", "pages": "page_id, url, html", "benchmark": "item_id, text", "labels": "doc_id, quality, toxic",
    "conversations": "conv_id, turn, role, text",
}
KEYED = {"events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}
TEXTS = {
    "region": "r_name", "nation": "n_name", "customer": "c_name, c_mktsegment", "supplier": "s_name", "part": "p_name, p_brand, p_type",
    "orders": "o_orderstatus, o_orderpriority", "lineitem": "l_returnflag, l_linestatus", "events": "event_type, props", "documents": "text, lang, source",
    "embeddings": "vec_id, embedding, label", "pages": "url, html", "benchmark": "text", "labels": "doc_id, quality, toxic", "conversations": "role, text",
}
# Floats as Spark writes them: below a thousandth with an exponent.
FLOATS_SQL = """'[' || array_to_string(list_transform(embedding, lambda x: CASE WHEN x = 0 OR abs(x) >= 0.001 THEN x::VARCHAR ELSE
    (CASE WHEN x < 0 THEN '-' ELSE '' END) || regexp_replace(CASE WHEN contains(x::VARCHAR, 'e') THEN replace(replace(split_part(x::VARCHAR, 'e', 1), '.', ''), '-', '')
      ELSE ltrim(split_part(x::VARCHAR, '.', 2), '0') END, '^(.)(.*)$', '\\1.\\2') || CASE WHEN len(ltrim(replace(replace(split_part(x::VARCHAR, 'e', 1), '.', ''), '-', ''), '0')) = 1 THEN '0' ELSE '' END
    || 'E' || CASE WHEN contains(x::VARCHAR, 'e') THEN split_part(x::VARCHAR, 'e', 2)::INT ELSE len(ltrim(split_part(x::VARCHAR, '.', 2), '0')) - len(split_part(x::VARCHAR, '.', 2)) - 1 END END), ',') || ']'"""


def _index_sql(searched=COLUMNS, first_column=False) -> str:
    """Index rows of every table in SQL; equal rows once per occurrence."""
    parts = []
    for name, columns in COLUMNS.items():
        key = columns.split(",")[0] if first_column else KEYED.get(name)
        content = norm_sql(f"concat_ws(' ', {searched[name]})".replace("embedding", f"({FLOATS_SQL})") if name == "embeddings" else f"concat_ws(' ', {searched[name]})")
        as_json = f"to_json({name})::VARCHAR"
        if name in ("orders", "lineitem"):
            as_json = f"regexp_replace({as_json}, '(\"(o_orderdate|l_shipdate)\":\"[0-9-]+) ', '\\1T')"
        elif name == "events":
            as_json = """to_json({'event_id': event_id, 'ts': CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END,
      'user_id': user_id, 'event_type': event_type, 'value': value, 'props': props})::VARCHAR"""
        elif name == "embeddings":
            as_json = f"""'{{"vec_id":' || vec_id || ',"embedding":' || {FLOATS_SQL} || ',"label":' || label || '}}'"""
        parts.append(f"""SELECT '{name}' AS table_name, {f"'{key}'" if key else 'NULL'} AS pk_col, {f'{key}::VARCHAR' if key else 'NULL'} AS pk_value,
    {content} AS content_norm, sha256('{name}' || chr(10) || {as_json}) AS row_id FROM {name}""")
    return "idx AS (" + "\n  UNION ALL ".join(parts) + ")"


INDEX_SQL = _index_sql()
_STORED_INDEXES: dict[tuple[str, str], posting_lists.PostingIndex] = {}


def _index(spark, d, names=TABLES):
    return text_index.build_index(tables(spark, d, *names))


def _stored_index(spark, d) -> posting_lists.PostingIndex:
    """The index of all tables with its posting lists, stored once per session."""
    known = spark.sparkContext.applicationId, d
    if known not in _STORED_INDEXES:
        _STORED_INDEXES[known] = posting_lists.write_postings(tables(spark, d, *TABLES), shared_path(spark, "row-index"))
    return _STORED_INDEXES[known]


@query("index_rows", f"WITH {INDEX_SQL} SELECT table_name, pk_col, pk_value, content_norm FROM idx")
def _(spark, d):
    return _index(spark, d).select("table_name", "pk_col", "pk_value", "content_norm")


@query("index_row_ids", f"WITH {INDEX_SQL} SELECT row_id, count(*) AS copies FROM idx GROUP BY 1")
def _(spark, d):
    return text_index.folded(_index(spark, d)).select("row_id", "copies")


@query("index_posting_lists", f"""WITH {INDEX_SQL}, d AS (SELECT DISTINCT row_id, content_norm FROM idx),
  w AS (SELECT DISTINCT row_id, unnest(string_split(content_norm, ' ')) AS w FROM d),
  g AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: substr(w, CAST(i AS INT), 3))) AS gram FROM w WHERE len(w) >= 3)
  SELECT gram, count(*) AS row_count FROM g GROUP BY 1""")
def _(spark, d):
    return _stored_index(spark, d).counts.select("gram", F.col("n").alias("row_count"))


@query("index_row_offsets", f"""WITH {INDEX_SQL}, f AS (SELECT table_name, row_id, count(*) AS n FROM idx GROUP BY 1, 2)
  SELECT table_name, row_id, (sum(n) OVER (PARTITION BY table_name ORDER BY row_id) - n)::BIGINT AS row_offset FROM f""")
def _(spark, d):
    folded = text_index.folded_apart(_index(spark, d).select("table_name", "row_id", "copies"))
    return text_index.with_row_offset(folded, []).select("table_name", "row_id", "row_offset")


@query("index_statistics", f"WITH {INDEX_SQL} SELECT table_name, count(*) AS indexed_rows FROM idx GROUP BY 1")
def _(spark, d):
    return text_index.index_statistics(_index(spark, d))


@query("index_progress", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS total_rows, 0::BIGINT AS indexed_rows, count(*) AS missing_rows FROM {n}" for n in TABLES if n not in ("part", "supplier")))
def _(spark, d):
    return text_index.index_progress(tables(spark, d, *TABLES), _index(spark, d, ["part", "supplier"]))


@query("index_kept_in_step", f"""WITH {INDEX_SQL} SELECT table_name, count(DISTINCT row_id) AS row_count, count(*) AS copies, count(DISTINCT content_norm) AS texts
  FROM idx WHERE table_name <> 'part' GROUP BY 1""")
def _(spark, d):
    """Two updates by the listing, the second with two files more and one gone, then a compaction."""
    files = {n: f"{d}/{n}.parquet" for n in TABLES}
    path = shared_path(spark, "kept-index")
    index_upkeep.update_index(spark, {n: f for n, f in files.items() if n not in ("lineitem", "region")}, path)
    index_upkeep.update_index(spark, {n: f for n, f in files.items() if n != "part"}, path)
    index_upkeep.compact_index(spark, path)
    return text_index.text_counts(index_upkeep.current_index(spark, path))


@query("index_missing_rows", f"WITH {INDEX_SQL} SELECT table_name, count(*) AS row_count FROM idx WHERE table_name <> 'part' GROUP BY 1")
def _(spark, d):
    wanted = text_index.folded(_index(spark, d))
    stored = text_index.folded(_index(spark, d, ["part"]))
    return text_index.missing_rows(wanted, stored).groupBy("table_name").agg(F.sum("copies").alias("row_count"))


def _candidate_sql(tokens: list[str], how: str) -> str:
    tests = [f"contains(content_norm, '{t}')" for t in tokens]
    cover = " + ".join(f"({t})::INT" for t in tests)
    return f"""WITH {INDEX_SQL}, d AS (SELECT DISTINCT * FROM idx) SELECT table_name, pk_value, md5(content_norm) AS content_hash, {cover} AS coverage, (({cover}) = {len(tokens)})::INT AS has_all
  FROM d WHERE {f' {how} '.join(tests)}"""


def _candidates(spark, d, q, mode):
    args = search.SearchArgs(q, token_mode=mode)
    found = search.candidates(_stored_index(spark, d), args)
    cover = search.coverage(args.tokens)
    return found.select("table_name", "pk_value", F.md5("content_norm").alias("content_hash"), cover.alias("coverage"),
                        F.when(cover == len(args.tokens), 1).otherwise(0).alias("has_all"))


@query("search_any_token", _candidate_sql(["elle", "widget", "thon"], "OR"))
def _(spark, d):
    return _candidates(spark, d, "Élle, WIDGET thon", "any")


@query("search_all_tokens", _candidate_sql(["elle", "aux", "de"], "AND"))
def _(spark, d):
    return _candidates(spark, d, "elle_áux-de", "all")


@query("search_rare_token", _candidate_sql(["000000077"], "OR"))
def _(spark, d):
    return _candidates(spark, d, "#000000077", "any")


def ranked_sql(args: search.SearchArgs, index_sql: str = INDEX_SQL, folded: bool = True, rank_by: str = "coverage") -> str:
    """The complete ranked search in SQL. The longest common subsequence of the leftovers is a fold over bits."""
    words = sorted(set(args.tokens))
    q = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    tests = [f"contains(content_norm, '{t}')" for t in args.tokens]
    cover = " + ".join(f"({t})::INT" for t in tests)
    first = f"table_name IN ({', '.join(repr(t) for t in args.priority)})" if args.priority else "false"
    limit = "" if args.candidate_limit is None else f"ORDER BY {first} DESC, table_name, row_id LIMIT {args.candidate_limit}"
    tables_ = f"AND table_name IN ({', '.join(repr(t) for t in args.tables)})" if args.tables else ""
    place = "CASE table_name " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(args.priority)) + f" ELSE {len(args.priority) + 1} END" if args.priority else "1"
    best = "score DESC" if rank_by == "score" else "has_all DESC, coverage DESC, score DESC"
    return f"""WITH {index_sql}, d AS (SELECT {'DISTINCT' if folded else ''} * FROM idx),
  h AS (SELECT *, {cover} AS coverage, (({cover}) = {len(args.tokens)})::INT AS has_all FROM d WHERE ({' OR '.join(tests) if args.token_mode == 'any' else ' AND '.join(tests)}) {tables_} {limit}),
  w AS (SELECT *, list_distinct(string_split(content_norm, ' ')) AS ws FROM h),
  r AS (SELECT * EXCLUDE (ws, content_norm), array_to_string(list_filter({q}, lambda t: list_contains(ws, t)), ' ') AS shared, array_to_string(list_filter({q}, lambda t: NOT list_contains(ws, t)), ' ') AS rq,
    array_to_string(list_sort(list_filter(ws, lambda t: NOT list_contains({q}, t))), ' ') AS rt FROM w),
  m AS (SELECT *, len(shared) AS s, len(rq) AS lq, len(rt) AS lt, list_filter(list_distinct(string_split(rq, '')), lambda c: c <> '') AS signs FROM r),
  k AS (SELECT *, CASE WHEN rq = '' THEN map(['-'], [0::BIGINT]) ELSE map(signs, list_transform(signs, lambda c: list_sum(list_transform(range(1, lq + 1), lambda i: CASE WHEN substr(rq, CAST(i AS INT), 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)) END AS bits FROM m),
  c AS (SELECT *, lq - bit_count(list_reduce(list_prepend(((1::BIGINT << lq) - 1)::BIGINT, list_transform(list_filter(string_split(rt, ''), lambda x: list_contains(signs, x)), lambda x: bits[x])),
    lambda u, b: ((u + (u & b)) | (u - (u & b))) & ((1::BIGINT << lq) - 1))) AS common FROM k),
  e AS (SELECT *, (CASE WHEN s > 0 THEN s + 1 ELSE 0 END) + lq AS sq, (CASE WHEN s > 0 THEN s + 1 ELSE 0 END) + lt AS st FROM c),
  x AS (SELECT table_name, pk_col, pk_value, row_id, coverage, has_all, CASE WHEN s > 0 AND (lq = 0 OR lt = 0) THEN 100.0::DOUBLE ELSE greatest(
      100.0::DOUBLE * (1 - (lq + lt - 2 * common)::DOUBLE / (sq + st)), CASE WHEN s > 0 THEN 100.0::DOUBLE * (1 - (1 + lq)::DOUBLE / (s + sq)) ELSE 0 END,
      CASE WHEN s > 0 THEN 100.0::DOUBLE * (1 - (1 + lt)::DOUBLE / (s + st)) ELSE 0 END) END AS ratio FROM e),
  y AS (SELECT * EXCLUDE ratio, floor(ratio)::INT AS score FROM x {'' if args.min_score is None else f'WHERE ratio >= {args.min_score}'}),
  z AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY {best}, row_id) AS n FROM y),
  l AS (SELECT * FROM z WHERE n <= {args.per_table} ORDER BY {best}, table_name, row_id LIMIT {args.total_limit}),
  b AS (SELECT *, {place} AS place, max(score) OVER (PARTITION BY table_name) AS best FROM l)
  SELECT (dense_rank() OVER (ORDER BY place, best DESC, table_name))::INT AS table_rank, table_name, n::INT AS "rank", score, coverage, has_all, pk_col, pk_value, row_id FROM b"""


def _ranked(name: str, args: search.SearchArgs) -> None:
    @query(name, ranked_sql(args))
    def _(spark, d):
        return search.search(_stored_index(spark, d), args).drop("row_json", "copies")


_ranked("search_ranked_word", search.SearchArgs("widget", per_table=25))
_ranked("search_ranked_phrase", search.SearchArgs("the red widget ation", per_table=20, priority=("supplier", "part")))
_ranked("search_ranked_all_tokens", search.SearchArgs("click 12", token_mode="all", per_table=30))
# Two tables together, with a priority, a least score and a limit of candidates.
_ranked("search_ranked_options", search.SearchArgs(
    "large gear ring", per_table=15, candidate_limit=900, total_limit=40, min_score=30, tables=("part", "orders", "documents"), priority=("orders", "part")))


def _scanned(name: str, args: search.SearchArgs, only_text: bool) -> None:
    """Without an index, equal rows stay apart."""
    sql = _index_sql(TEXTS, first_column=True) if only_text else INDEX_SQL

    @query(name, ranked_sql(args, sql, folded=False, rank_by="score"))
    def _(spark, d):
        return search.scan_search(tables(spark, d, *TABLES), args, only_text=only_text).drop("row_json", "copies")


_scanned("scan_search_word", search.SearchArgs("gear"), False)
_scanned("scan_search_text_columns", search.SearchArgs("small ring elle"), True)


@query("search_counts", f"WITH {INDEX_SQL}, h AS (SELECT table_name, count(DISTINCT row_id) AS n FROM idx WHERE contains(content_norm, 'the') GROUP BY 1) SELECT 'The' AS q, 'the' AS q_norm, sum(n)::BIGINT AS candidate_count, least(sum(least(n, 10)), 500)::BIGINT AS returned_count FROM h")
def _(spark, d):
    return search.search_counts(_stored_index(spark, d), search.SearchArgs("The"))


@query("search_results_table", f"""WITH {INDEX_SQL}, h AS (SELECT DISTINCT table_name, pk_value, row_id, list_contains(string_split(content_norm, ' '), 'bolt') AS whole FROM idx WHERE contains(content_norm, 'bolt')),
  r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY row_id) AS n FROM h)
  SELECT r.table_name AS "table", 100 AS score, p_partkey::VARCHAR AS p_partkey, p_name, NULL::VARCHAR AS s_name
  FROM r LEFT JOIN part p ON r.table_name = 'part' AND sha256('part' || chr(10) || to_json(p)) = r.row_id WHERE n <= 50 AND whole""")
def _(spark, d):
    found = search.search(_stored_index(spark, d), search.SearchArgs("bolt", per_table=50))
    return search.results_table(found, ["p_partkey", "p_name", "s_name"])


@query("highlight_documents", "SELECT doc_id, regexp_replace(text, '(?i)(that|the)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.highlight(F.col("text"), ["the", "that"]).alias("marked"))


@query("normalize_documents", f"SELECT doc_id, {norm_sql('text')} AS content FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("content"))


@query("normalize_pages", f"SELECT page_id, {norm_sql('html')} AS content FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_text(F.col("html")).alias("content"))


# --- tracking ----------------------------------------------------------------------------------

def track_sql(where: str) -> str:
    return f"""WITH {DAILY}, hits AS (SELECT snapshot, count(*) AS n, min(to_json({{'event_id': event_id, 'user_id': user_id}})::VARCHAR) AS s FROM daily WHERE {where} GROUP BY 1),
  tr AS (SELECT cat.snapshot, order_idx, n IS NOT NULL AS found, CASE WHEN n IS NOT NULL THEN 'events' END AS table_name, coalesce(n, 0) AS match_count, s AS sample, NULL::VARCHAR AS error
  FROM cat LEFT JOIN hits USING (snapshot))"""
SHOWN = ["event_id", "user_id"]


def _track(spark, d, text_condition):
    daily = events_daily(spark, d)
    return track.find_record(daily_catalog(daily), {"events": daily}, parse_conditions(text_condition), show=SHOWN)


@query("track_user_daily", track_sql("user_id = 42 AND event_type = 'click'") + " SELECT * FROM tr")
def _(spark, d):
    return _track(spark, d, "user_id=42,event_type='click'")


@query("track_past_unreadable_table", track_sql("user_id = 42 AND event_type = 'click'") + " SELECT * REPLACE (CASE WHEN NOT found THEN 'torn: PATH_NOT_FOUND' END AS error) FROM tr")
def _(spark, d):
    daily = events_daily(spark, d)
    given = {"torn": lambda: spark.read.parquet(f"{d}/events_of_no_day.parquet"), "events": daily}
    return track.find_record_past_errors(daily_catalog(daily), given, parse_conditions("user_id=42,event_type='click'"), show=SHOWN)


@query("track_missing_table", f"WITH {DAILY} SELECT snapshot, order_idx, false AS found, NULL::VARCHAR AS table_name, 0::BIGINT AS match_count, NULL::VARCHAR AS sample, 'TABELA AUSENTE' AS error FROM cat")
def _(spark, d):
    daily = events_daily(spark, d)
    return track.find_record(daily_catalog(daily), {"events": daily}, parse_conditions("user_id=42"), table="readings", show=SHOWN)


@query("track_missing_column", f"WITH {DAILY} SELECT snapshot, order_idx, false AS found, NULL::VARCHAR AS table_name, 0::BIGINT AS match_count, NULL::VARCHAR AS sample, 'COLUNA AUSENTE' AS error FROM cat")
def _(spark, d):
    return _track(spark, d, "nope=1")


BOUNDS_SQL = """, b AS (SELECT min(order_idx) FILTER (found) AS f, max(order_idx) FILTER (found) AS l, count(*) FILTER (found) AS k, count(*) AS n FROM tr)
  SELECT k AS found_count, n AS snapshot_count, (SELECT snapshot FROM tr WHERE order_idx = f) AS first_found, (SELECT snapshot FROM tr WHERE order_idx = f - 1) AS absent_before,
  (SELECT snapshot FROM tr WHERE order_idx = l) AS last_found, (SELECT snapshot FROM tr WHERE order_idx = l + 1) AS absent_after,
  CASE WHEN k = 0 THEN 'never' WHEN f > 0 THEN 'appeared' ELSE 'from_start' END AS appearance,
  CASE WHEN k = 0 THEN 'never' WHEN l < n - 1 THEN 'disappeared' ELSE 'still_present' END AS disappearance FROM b"""


@query("track_timeline", track_sql("user_id = 7 AND event_type = 'signup'") + BOUNDS_SQL)
def _(spark, d):
    return track.presence_timeline(_track(spark, d, 'user_id=7,event_type="signup"'))


@query("track_timeline_never", track_sql("user_id = -5") + BOUNDS_SQL)
def _(spark, d):
    return track.presence_timeline(_track(spark, d, "user_id=-5"))


@query("track_found_summary", track_sql("user_id = 3 AND event_type = 'error'") + " SELECT count(*) FILTER (found) AS found_in, count(*) AS snapshots FROM tr")
def _(spark, d):
    return track.found_summary(_track(spark, d, "user_id=3,event_type=error"))


@query("track_limits", f"WITH {DAILY} SELECT count(*) AS total_files, least(count(*), 10) AS files_scanned, count(*) > 10 AS limit_reached FROM cat")
def _(spark, d):
    return track.track_limits(daily_catalog(events_daily(spark, d)), 10)


@query("track_find_value", f"""WITH {DAILY}, hits AS (SELECT snapshot, CASE WHEN count(*) FILTER (user_id = 42) > 0 THEN 'user_id' ELSE 'event_id' END AS c, count(*) FILTER (user_id = 42) AS nu,
    count(*) FILTER (event_id = 42) AS ne, min(to_json({{'event_id': event_id, 'user_id': user_id}})::VARCHAR) FILTER (user_id = 42) AS su,
    min(to_json({{'event_id': event_id, 'user_id': user_id}})::VARCHAR) FILTER (event_id = 42) AS se FROM daily WHERE user_id = 42 OR event_id = 42 GROUP BY 1)
  SELECT cat.snapshot, order_idx, c IS NOT NULL AS found, CASE WHEN c IS NOT NULL THEN 'events' END AS table_name, c AS column_name,
  coalesce(CASE WHEN c = 'user_id' THEN nu ELSE ne END, 0) AS match_count, CASE WHEN c = 'user_id' THEN su ELSE se END AS sample FROM cat LEFT JOIN hits USING (snapshot)""")
def _(spark, d):
    daily = events_daily(spark, d)
    return track.find_value(daily_catalog(daily), {"events": daily.drop("value", "event_type")}, "42", column="user_id", all_columns=True, show=SHOWN)


@query("track_ledger", track_sql("user_id = 11") + """, sizes AS (SELECT snapshot, 'events/' || snapshot AS path, count(*) AS size_kb, sha1(snapshot) AS quick_sha1 FROM daily GROUP BY 1)
  SELECT path, size_kb, quick_sha1, found, table_name AS "table", match_count AS "count", sample, error, order_idx FROM tr LEFT JOIN sizes USING (snapshot)""")
def _(spark, d):
    daily = events_daily(spark, d)
    files = daily.groupBy("snapshot").agg(
        F.concat(F.lit("events/"), F.first("snapshot")).alias("path"), F.lit(None).cast("timestamp").alias("mtime"),
        F.count("*").alias("size_kb"), F.sha1(F.first("snapshot").cast("binary")).alias("quick_sha1"))
    return track.track_ledger(_track(spark, d, "user_id=11"), files).drop("mtime")


# --- browsing ----------------------------------------------------------------------------------


@query("browse_page", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey, p_name LIMIT 50 OFFSET 100")
def _(spark, d):
    return browse.table_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), sort="p_size", order="DESC", limit=50, offset=100)


@query("browse_filter", "SELECT * FROM part WHERE p_name ILIKE '%ED%ring%' ORDER BY p_partkey LIMIT 1000")
def _(spark, d):
    return browse.table_rows(table(spark, d, "part"), "p_name", "ED%ring", "p_partkey", limit=1000)


@query("browse_filter_total", "SELECT count(*) AS total FROM orders WHERE CAST(o_totalprice AS VARCHAR) ILIKE '%99%'")
def _(spark, d):
    return browse.contains_filter(table(spark, d, "orders"), "o_totalprice", "99").agg(F.count("*").alias("total"))


@query("equality_filter", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def _(spark, d):
    customer = table(spark, d, "customer")
    return customer.filter(matches(customer, parse_conditions('C_MKTSEGMENT="BUILDING",c_nationkey=7')))


@query("natural_order", "SELECT p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()
    # Ranks the distinct brands only, of which there are a few dozen.
    return brands.withColumn("place", F.row_number().over(Window.orderBy(*browse.natural_order(F.col("p_brand")))))


@query("report_filter", f"WITH {ORDERS_DIFF} SELECT {DIFF_COLUMNS} FROM d WHERE (coalesce(a_p ILIKE '%urg%', false) OR coalesce(b_p ILIKE '%urg%', false)) AND NOT (coalesce(a_s = 'X', false) OR coalesce(b_s = 'X', false))")
def _(spark, d):
    rows = browse.report_filter(_orders_rows(spark, d), {"o_orderpriority": "URG"}, "o_orderstatus", "x", "not_contains")
    return _flat_orders(rows)


@query("merged_columns", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, NULL::VARCHAR AS r_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey::VARCHAR, r_name FROM region")
def _(spark, d):
    merged = browse.merged_columns([table(spark, d, "nation"), table(spark, d, "region")])
    return as_text(merged, "n_nationkey", "n_regionkey", "r_regionkey")


@query("display_columns", "SELECT c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return browse.for_display(table(spark, d, "customer"))


@query("headline_fields", "SELECT event_id, 'ITEMNB=' || event_type || '; STACON=' || user_id AS headline FROM events")
def _(spark, d):
    named = table(spark, d, "events").select("event_id", F.col("event_type").alias("ITEMNB"), F.col("user_id").alias("STACON"), F.lit("").alias("PNTNAM"))
    return named.select("event_id", F.array_join(F.transform(browse.headline(named), lambda f: F.concat(f["name"], F.lit("="), f["value"])), "; ").alias("headline"))


# --- snapshots, ingest, validation -------------------------------------------------------------

FILES_SQL = """files AS (SELECT o_orderkey, o_orderkey % 5 AS kind, o_orderdate::DATE AS d, o_orderstatus AS s, CASE o_orderkey % 5
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '_db' || o_custkey || 'x.parquet' WHEN 1 THEN 'db ' || strftime(o_orderdate, '%d-%m-%Y') || '.csv'
  WHEN 2 THEN 'db_' || strftime(o_orderdate, '%Y%m%d') || '.orc' WHEN 3 THEN 'db_2026-13-40_' || o_orderstatus || '.json' ELSE 'Old DB ' || o_orderstatus || '.txt' END AS file_name,
  o_orderpriority, o_totalprice, o_orderdate FROM orders)"""


# A year-first date also holds day-first digits (1996-12-05 has no such run, 19961205 may).
@query("dates_in_names", f"""WITH {FILES_SQL} SELECT file_name, CASE WHEN kind IN (0, 2) THEN d::VARCHAR END AS loose, CASE WHEN kind = 0 THEN d::VARCHAR END AS prefix,
  CASE WHEN kind IN (0, 1) THEN d::VARCHAR END AS separated FROM files""")
def _(spark, d):
    names = order_files(spark, d)
    return names.select("file_name", *[date_in_name(F.col("file_name"), r).cast("string").alias(r) for r in ("loose", "prefix", "separated")])


@query("dates_in_names_any", f"""WITH {FILES_SQL}, m AS (SELECT *, regexp_extract(file_name, '(\\d{{8}})', 1) AS c FROM files),
  p AS (SELECT *, try_strptime(substr(c, 1, 2) || '-' || substr(c, 3, 2) || '-' || substr(c, 5, 4), '%d-%m-%Y')::DATE AS dmy FROM m)
  SELECT file_name, CASE WHEN kind IN (0, 1) THEN d WHEN kind = 2 THEN CASE WHEN dmy IS NOT NULL AND year(dmy) BETWEEN 1900 AND 2100 THEN dmy ELSE d END END::VARCHAR AS any_date FROM p""")
def _(spark, d):
    return order_files(spark, d).select("file_name", date_in_name(F.col("file_name"), "any").cast("string").alias("any_date"))


CATALOG_SQL = """cat AS (SELECT 'db_' || strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS snapshot, date_trunc('month', o_orderdate)::DATE AS snapshot_date,
  CASE WHEN month(any_value(date_trunc('month', o_orderdate))) % 3 = 0 THEN 'csv' ELSE 'parquet' END AS format, max(o_orderdate) AS mtime, count(*) AS size_bytes FROM orders GROUP BY date_trunc('month', o_orderdate))"""


def _monthly(spark, d):
    month = F.date_trunc("month", "o_orderdate")
    name = F.concat(F.lit("db_"), F.date_format(month, "yyyy-MM-dd"))
    grouped = table(spark, d, "orders").groupBy(name.alias("snapshot")).agg(F.max("o_orderdate").alias("mtime"), F.count("*").alias("size_bytes"))
    dated = grouped.withColumn("snapshot_date", date_in_name(F.col("snapshot")))
    return dated.withColumn("format", F.when(F.month("snapshot_date") % 3 == 0, "csv").otherwise("parquet"))


@query("catalog_in_order", f"WITH {CATALOG_SQL} SELECT snapshot, snapshot_date::VARCHAR AS snapshot_date, format, size_bytes, row_number() OVER (ORDER BY snapshot_date) - 1 AS order_idx FROM cat")
def _(spark, d):
    return as_text(catalog.in_date_order(_monthly(spark, d)).drop("mtime"), "snapshot_date")


@query("catalog_by_file_time", f"WITH {CATALOG_SQL} SELECT snapshot, row_number() OVER (ORDER BY mtime) - 1 AS order_idx FROM cat")
def _(spark, d):
    return catalog.in_date_order(_monthly(spark, d), "mtime").select("snapshot", "order_idx")


@query("catalog_suggest_two", f"WITH {CATALOG_SQL} SELECT snapshot, format FROM cat WHERE format = 'csv' ORDER BY snapshot_date DESC LIMIT 2")
def _(spark, d):
    return catalog.suggest_two(_monthly(spark, d), "csv").select("snapshot", "format")


@query("catalog_text_filter", f"WITH {CATALOG_SQL} SELECT snapshot, format FROM cat WHERE contains(snapshot || ' ' || format || ' ' || snapshot_date, '-03-01 csv')")
def _(spark, d):
    return catalog.newest_first(catalog.filter_catalog(_monthly(spark, d), " -03-01 CSV ")).select("snapshot", "format")


@query("catalog_of_files")
def _(spark, d):
    return catalog.file_catalog(spark, d).select("table_name", "format", "snapshot", "size_bytes")


@query("catalog_fingerprints")
def _(spark, d):
    return catalog.fingerprints(spark, d).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "quick_sha1")


@query("catalog_copies", f"""WITH {FILES_SQL}, c AS (SELECT lower(regexp_replace(file_name, '\\.[^.]+$', '')) AS stem, max(o_orderdate) AS copied FROM files WHERE kind = 2 GROUP BY 1)
  SELECT f.o_orderkey, c.stem IS NOT NULL AS has_copy FROM files f LEFT JOIN c ON lower(regexp_replace(f.file_name, '\\.[^.]+$', '')) = c.stem""")
def _(spark, d):
    files = order_files(spark, d).withColumn("path", F.col("relpath"))
    copies = files.filter(F.col("file_name").endswith(".orc"))
    return catalog.resolve_copies(files, copies).select("o_orderkey", F.col("copy_path").isNotNull().alias("has_copy"))


@query("catalog_stale_sources", f"""WITH {FILES_SQL}, c AS (SELECT lower(regexp_replace(file_name, '\\.[^.]+$', '')) AS stem, max(o_orderdate) AS copied FROM files WHERE kind IN (1, 4) GROUP BY 1)
  SELECT f.o_orderkey FROM files f LEFT JOIN c ON lower(regexp_replace(f.file_name, '\\.[^.]+$', '')) = c.stem WHERE c.copied IS NULL OR c.copied < f.o_orderdate""")
def _(spark, d):
    files = order_files(spark, d)
    copies = files.filter(F.col("file_name").rlike(r"\.(csv|txt)$"))
    return catalog.stale_sources(files, copies).select("o_orderkey")


@query("manifest", f"""WITH {FILES_SQL} SELECT lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g')) || '_' ||
  lower(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^A-Za-z0-9]', '_', 'g')) || '_' || regexp_extract(file_name, '\\.([^.]*)$', 1) AS id, o_orderpriority || '/' || file_name AS path FROM files""")
def _(spark, d):
    files = order_files(spark, d).withColumn("path", F.col("relpath")).withColumn("format", F.lit("x"))
    return ingest.manifest(files).select("id", "path")


ITEMS_SQL = """items AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'mdb' END AS source_suffix, o_orderstatus <> 'P' AS load_ok, o_orderkey % 10 <> 0 AS copy_ok,
  o_custkey % 4 AS load_tables, o_custkey % 3 AS copy_tables, round(o_totalprice, 0) AS load_seconds, 1.5::DOUBLE AS copy_seconds FROM orders)"""


def _items(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "mdb").alias("source_suffix"), (F.col("o_orderstatus") != "P").alias("load_ok"),
        (F.col("o_orderkey") % 10 != 0).alias("copy_ok"), (F.col("o_custkey") % 4).alias("load_tables"), (F.col("o_custkey") % 3).alias("copy_tables"),
        F.round("o_totalprice", 0).alias("load_seconds"), F.lit(1.5).alias("copy_seconds"), F.lit(None).cast("string").alias("load_message"), F.lit("boom").alias("copy_message"))


@query("ingest_run_report", f"""WITH {ITEMS_SQL}, r AS (SELECT *, load_ok AND copy_ok AND load_tables = copy_tables AS ok FROM items) SELECT count(*) AS total_files, count(*) FILTER (ok) AS reliability_ok,
  count(*) FILTER (NOT ok) AS reliability_fail, count(*) FILTER (load_ok) AS load_ok, count(*) FILTER (copy_ok) AS copy_ok, sum(load_seconds) AS total_load_seconds, sum(copy_seconds) AS total_copy_seconds FROM r""")
def _(spark, d):
    return ingest.run_report(ingest.reliability(_items(spark, d)))


@query("ingest_manifest_status", f"""WITH {ITEMS_SQL} SELECT 'total_sources' AS metric, count(*) AS value FROM items UNION ALL SELECT 'load_ok', count(*) FILTER (load_ok) FROM items UNION ALL SELECT 'copy_ok', count(*) FILTER (copy_ok) FROM items
  UNION ALL SELECT 'suffix:' || coalesce(source_suffix, '(none)'), count(*) FROM items GROUP BY 1""")
def _(spark, d):
    return ingest.manifest_status(_items(spark, d))


@query("ingest_first_failures", f"WITH {ITEMS_SQL} SELECT id, 'boom' AS message FROM items WHERE load_ok AND NOT copy_ok ORDER BY id LIMIT 20")
def _(spark, d):
    return ingest.first_failures(_items(spark, d), "copy", 20)


@query("ingest_ledger", "SELECT 'events.parquet' AS source_file, ts::DATE::VARCHAR AS file_date, 'events_' || strftime(ts, '%Y%m%d') AS table_name, count(*) AS row_count FROM events GROUP BY ts::DATE, strftime(ts, '%Y%m%d')")
def _(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return as_text(ingest.ledger_rows("events.parquet", F.col("day"), {"events": events}, "day"), "file_date")


@query("ingest_new_loads", "SELECT 'events_' || strftime(ts, '%Y%m%d') AS table_name, count(*) AS row_count FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1")
def _(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    lines = ingest.ledger_rows("events.parquet", F.col("day"), {"events": events}, "day")
    return ingest.new_loads(lines, lines.filter("file_date < DATE'2024-01-11'")).select("table_name", "row_count")


@query("ingest_all_text", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, o_orderdate::TIMESTAMP::VARCHAR AS o_orderdate, o_orderpriority AS order_priority FROM orders")
def _(spark, d):
    return ingest.all_text(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "order-priority"))


@query("ingest_messages", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_data' ELSE 'failed' END AS status FROM orders")
def _(spark, d):
    message = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Table "), "o_orderstatus", F.lit(" Has No Data"))).when(F.col("o_orderkey") % 3 == 2, "broken header")
    return ingest.classify_messages(table(spark, d, "orders").select("o_orderkey", message.alias("message"))).select("o_orderkey", "status")


@query("rows_from_ragged_lists", """WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) FILTER (turn % 2 = 0) AS evens FROM conversations GROUP BY 1)
  SELECT conv_id, unnest(roles) AS roles, unnest(list_resize(evens, len(roles)))::VARCHAR AS evens, unnest(list_resize([conv_id], len(roles)))::VARCHAR AS one FROM g""")
def _(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.col("t.role").alias("roles"), F.filter(F.col("t.turn"), lambda t: t % 2 == 0).alias("evens"), F.col("conv_id").alias("one"))
    return as_text(ingest.rows_from_lists(lists, ["roles", "evens", "one"]), "evens", "one")


@query("records_from_mixed_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN k END AS k, CASE WHEN event_id % 3 = 1 THEN event_type END AS col_0, CASE WHEN event_id % 3 = 1 THEN k END AS col_1,
  CASE WHEN event_id % 3 = 2 THEN event_type END AS value FROM (SELECT *, regexp_extract(props, '(\\d+)', 1) AS k FROM events)""")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    line = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.to_json(F.array("event_type", k))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    mixed = table(spark, d, "events").select("event_id", line.alias("line"))
    return ingest.records_from_json(mixed, "line", ["k", "col_0", "col_1", "value"], keep=["event_id"])


@query("fields_of_mixed_json", "SELECT 'k' AS field, count(*) AS row_count FROM events")
def _(spark, d):
    return ingest.json_fields(table(spark, d, "events"), "props")


@query("flatten_nested", "SELECT vec_id, label, len(embedding) AS n FROM embeddings")
def _(spark, d):
    flat = flatten_nested(table(spark, d, "embeddings"))
    return flat.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).cast("bigint").alias("n"))


@query("coerced_types", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::TIMESTAMP::VARCHAR AS o_orderdate, o_orderpriority FROM orders")
def _(spark, d):
    return as_text(ingest.coerced(table(spark, d, "orders")), "o_orderdate")


CANON_SQL = "to_json({'c_custkey': c_custkey::VARCHAR, 'c_name': c_name, 'c_nationkey': c_nationkey::VARCHAR, 'c_acctbal': regexp_replace(c_acctbal::VARCHAR, '\\.0$', ''), 'c_mktsegment': c_mktsegment})::VARCHAR"


@query("validate_sampled_rows", f"""WITH r AS (SELECT {CANON_SQL} AS canonical FROM customer)
  SELECT row_number() OVER (ORDER BY sha256(canonical)) - 1 AS position, sha256(canonical) AS digest, canonical FROM r ORDER BY digest LIMIT 9""")
def _(spark, d):
    return validate.sampled_rows(table(spark, d, "customer"))


@query("validate_sample_hashes", f"""WITH r AS (SELECT {CANON_SQL} AS canonical FROM customer), f AS (SELECT canonical, sha256(canonical) AS digest FROM r ORDER BY digest LIMIT 9),
  h AS (SELECT sha256(string_agg(canonical || chr(10), '' ORDER BY digest)) AS h FROM f)
  SELECT 9::BIGINT AS sampled, h AS sample_hash_source, h AS sample_hash_copy, NULL::VARCHAR AS first_mismatch FROM h""")
def _(spark, d):
    customer = table(spark, d, "customer")
    return as_text(validate.sample_check(customer, customer.repartition(3)), "first_mismatch")


@query("validate_copy", """WITH v AS (SELECT 'customer' AS table_name, 'ok' AS status, true AS columns_ok, (SELECT count(*) FROM customer) AS rows_source, (SELECT count(*) FROM customer) AS rows_copy, true AS rows_ok, 9 AS sampled, true AS content_ok, NULL::VARCHAR AS issue
  UNION ALL SELECT 'nation', 'failed', false, NULL, NULL, NULL, NULL, NULL, 'columns differ' UNION ALL SELECT 'region', 'failed', NULL, NULL, NULL, NULL, NULL, NULL, 'table missing in copy'
  UNION ALL SELECT 'part', 'failed', true, (SELECT count(*) FROM part), (SELECT count(*) FROM part), true, 9, false, 'differs') SELECT table_name, status, COLUMNS(['columns_ok', 'rows_source', 'rows_copy', 'rows_ok', 'sampled', 'content_ok'])::VARCHAR, issue FROM v""")
def _(spark, d):
    source = tables(spark, d, "customer", "nation", "region", "part")
    copy = {"customer": ingest.coerced(source["customer"], "six").repartition(5), "nation": source["nation"].select("n_name", "n_nationkey", "n_regionkey"),
            "part": part_versions(spark, d)[1]}
    # Canonical integers print alike in both widths, so a widened copy still counts as faithful.
    checked = validate.validate_copy(spark, source, copy)
    issue = F.when(F.col("issue").contains("rows differ"), "differs").otherwise(F.col("issue"))
    facts = ["columns_ok", "rows_source", "rows_copy", "rows_ok", "sampled", "content_ok"]
    return as_text(checked.select("table_name", "status", *facts, issue.alias("issue")), *facts)


@query("validate_row_differences", f"WITH {PART} SELECT count(*) AS differing FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))")
def _(spark, d):
    return validate.row_differences(*part_versions(spark, d)).agg(F.count("*").alias("differing"))


# --- reports and export ------------------------------------------------------------------------


@query("report_two_lines", f"""WITH {ORDERS_DIFF}, few AS (SELECT * FROM d) SELECT 'orders' AS table_name, 'o_orderkey=' || k AS key_text,
  CASE change_type WHEN 'changed' THEN 'modificado' WHEN 'added' THEN 'novo' ELSE 'excluido' END AS type_label, n AS line_no, CASE n WHEN 1 THEN 'velho' ELSE 'novo' END AS side,
  CASE n WHEN 1 THEN {{old}} ELSE {{new}} END AS line_values FROM few, (SELECT unnest([1, 2])::INT AS n)""".format(
    old=" || ' | ' || ".join(f"'{c}=' || coalesce({v}, '')" for c, v in [("o_custkey", "a_c::VARCHAR"), ("o_orderstatus", "a_s"), ("o_totalprice", nice_sql("a_t")), ("o_orderpriority", "a_p"), ("o_orderdate", "a_d::VARCHAR")]),
    new=" || ' | ' || ".join(f"'{c}=' || coalesce({v}, '')" for c, v in [("o_custkey", "b_c::VARCHAR"), ("o_orderstatus", "b_s"), ("o_totalprice", nice_sql("b_t")), ("o_orderpriority", "b_p"), ("o_orderdate", "b_d::VARCHAR")])))
def _(spark, d):
    a, b = orders_versions(spark, d)
    rows = diff.keyed_diff(a, b, ["o_orderkey"]).rows
    detail = report.table_detail(rows, "orders", a.columns, ["o_orderkey"])
    # Column order in the report follows the first change; put it in schema order to compare.
    shown = [c for c in a.columns if c in detail.schema["old"].dataType.names]
    even = [F.struct(*[F.col(s).getField(c).alias(c) for c in shown]).alias(s) for s in ("old", "new")]
    return report.two_lines(detail.select("table_name", "change_type", "key_values", *even))


@query("report_table_flags", f"WITH {ORDERS_DIFF}, few AS (SELECT * FROM d) SELECT k::VARCHAR AS k, CASE WHEN change_type = 'changed' THEN c_s ELSE true END AS status_changed, CASE WHEN change_type = 'changed' THEN c_p WHEN change_type = 'added' THEN b_p IS NOT NULL ELSE a_p IS NOT NULL END AS priority_changed FROM few")
def _(spark, d):
    a, b = orders_versions(spark, d)
    detail = report.table_detail(diff.keyed_diff(a, b, ["o_orderkey"]).rows, "orders", a.columns, ["o_orderkey"])
    return detail.select(F.col("key_values.o_orderkey").alias("k"), F.col("changed.o_orderstatus").alias("status_changed"), F.col("changed.o_orderpriority").alias("priority_changed"))


@query("export_diff_csv_rows", f"""WITH {ORDERS_DIFF} SELECT CASE WHEN k < 0 THEN '''' || k ELSE k::VARCHAR END AS "K_o_orderkey", change_type AS type, coalesce(a_c::VARCHAR, '') AS "A_o_custkey", coalesce(b_c::VARCHAR, '') AS "B_o_custkey",
  coalesce(a_s, '') AS "A_o_orderstatus", coalesce(b_s, '') AS "B_o_orderstatus", coalesce(a_t::VARCHAR, '') AS "A_o_totalprice", coalesce(b_t::VARCHAR, '') AS "B_o_totalprice",
  coalesce(a_p, '') AS "A_o_orderpriority", coalesce(b_p, '') AS "B_o_orderpriority", coalesce(a_d::VARCHAR, '') AS "A_o_orderdate", coalesce(b_d::VARCHAR, '') AS "B_o_orderdate" FROM d""")
def _(spark, d):
    return export.diff_csv_columns(_orders_rows(spark, d))


@query("export_diff_csv_lines", f"""WITH {ORDERS_DIFF} SELECT CASE WHEN k < 0 THEN '''' || k ELSE k::VARCHAR END || ';' || change_type || ';' || coalesce(a_c::VARCHAR, '') || ';' || coalesce(b_c::VARCHAR, '') || ';' || coalesce(a_s, '') || ';' || coalesce(b_s, '')
  || ';' || coalesce(a_t::VARCHAR, '') || ';' || coalesce(b_t::VARCHAR, '') || ';' || coalesce(a_p, '') || ';' || coalesce(b_p, '') || ';' || coalesce(a_d::VARCHAR, '') || ';' || coalesce(b_d::VARCHAR, '') AS line FROM d""")
def _(spark, d):
    return export.diff_csv_lines(_orders_rows(spark, d))


@query("export_table_csv_lines", """SELECT '"' || doc_id || '","' || replace(text, '"', '""') || '","' || lang || '","' || source || '","' || n_chars || '"' AS line FROM documents""")
def _(spark, d):
    return export.table_csv_lines(table(spark, d, "documents"))


@query("export_rows_as_json", "SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})::VARCHAR AS row_json FROM customer")
def _(spark, d):
    return json_rows(table(spark, d, "customer"))


# --- scalar functions --------------------------------------------------------------------------


@query("numbers_in_text", "SELECT event_id, value AS number, " + nice_sql("value") + " AS cleaned FROM events")
def _(spark, d):
    rows = number_texts(spark, d)
    return rows.select("event_id", numbers.parse_number(F.col("amount")).alias("number"), numbers.clean_value(F.col("amount")).alias("cleaned"))


@query("display_values", f"SELECT l_orderkey, {nice_sql('l_quantity')} AS quantity, {nice_sql('l_discount')} AS discount FROM lineitem")
def _(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", *[numbers.display_value(F.col(f"l_{c}"), line.schema[f"l_{c}"].dataType).alias(c) for c in ("quantity", "discount")])


@query("size_texts", """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1fB', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576) ELSE printf('%.1fGB', b / 1073741824) END AS size
  FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 7) AS b FROM documents)""")
def _(spark, d):
    size = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 7)
    return table(spark, d, "documents").select("doc_id", numbers.size_text(size).alias("size"))


@query("short_values", """SELECT doc_id, CASE WHEN length(j) > 80 THEN substr(j, 1, 77) || '...' ELSE j END AS short FROM (SELECT doc_id, to_json(lang || ' ' || source)::VARCHAR AS j FROM documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.short_value(F.concat("lang", F.lit(" "), "source")).alias("short"))


@query("flags", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' END AS flag FROM events")
def _(spark, d):
    word = F.when(F.col("event_id") % 3 == 0, " SIM").when(F.col("event_id") % 3 == 1, "Off ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.flag(word).cast("string").alias("flag"))


@query("column_keys", "SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS column_key FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.column_key(F.col("s_name")).alias("column_key"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed diff of two versions of the orders table."""
    return QUERIES["diff_orders_rows"](spark, sf_dir)
