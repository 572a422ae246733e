import itertools
from dataclasses import replace

import pytest

from snapscope.functions.text import normalize_query
from snapscope.operators import posting_lists as pl
from snapscope.operators import search as q
from snapscope.operators import text_index as ix
from tests.test_functions import lcs


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "alpha": spark.createDataFrame([(1, "alpha unit"), (2, "beta unit"), (3, "Ação rápida"), (4, None)], "id INT, name STRING"),
        "zeta": spark.createDataFrame([("alpha result", 7), ("omega only", 8), ("alpha omega", 9)], "descr STRING, x_id INT"),
        "_fulltext": spark.createDataFrame([(1,)], "id INT"),
    }


@pytest.fixture(scope="module")
def index(tables):
    return ix.build_index(tables).persist()


def ratio(query, content):
    """The token-set ratio from its definition."""
    a, b = set(query.split()), set(content.split())
    if not a or not b:
        return 0.0
    both = " ".join(sorted(a & b))
    d1, d2 = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not d1 or not d2):
        return 100.0
    s = len(both) + (1 if both else 0)
    l1, l2 = s + len(d1), s + len(d2)
    best = 100 * (1 - (len(d1) + len(d2) - 2 * lcs(d1, d2)) / (l1 + l2))
    if both:
        best = max(best, 100 * (1 - (1 + len(d1)) / (len(both) + l1)), 100 * (1 - (1 + len(d2)) / (len(both) + l2)))
    return best


def brute_force(rows, args):
    """rows: (table, row_id, content)."""
    tokens = args.tokens
    found = []
    for table, row_id, content in rows:
        hits = [t in content for t in tokens]
        if tokens and not (any(hits) if args.token_mode == "any" else all(hits)):
            continue
        score = ratio(args.normalized, content)
        if args.min_score is not None and score < args.min_score:
            continue
        found.append((int(all(hits) and bool(tokens)), sum(hits), int(score), table, row_id))
    found.sort(key=lambda f: (-f[0], -f[1], -f[2], f[3], f[4]))
    kept, per_table = [], {}
    for f in found:
        if len(kept) < args.total_limit and per_table.get(f[3], 0) < args.per_table:
            per_table[f[3]] = per_table.get(f[3], 0) + 1
            kept.append(f)
    return kept


def test_index_rows(index):
    rows = {(r.table_name, r.pk_value): r for r in index.collect()}
    assert set(t for t, _ in rows) == {"alpha", "zeta"}
    one = rows[("alpha", "3")]
    assert (one.pk_col, one.content_norm, one.row_json) == ("id", "3 acao rapida", '{"id":3,"name":"Ação rápida"}')
    assert rows[("alpha", "4")].content_norm == "4" and rows[("alpha", "4")].row_json == '{"id":4,"name":null}'
    assert rows[("zeta", "7")].pk_col == "x_id"


@pytest.mark.parametrize("args", [
    q.SearchArgs("alpha"), q.SearchArgs("alpha omega"), q.SearchArgs("alpha omega", token_mode="all"), q.SearchArgs("alph onl", min_score=20),
    q.SearchArgs("unit alpha", per_table=1), q.SearchArgs("a", total_limit=3), q.SearchArgs("ÁÇÃO!"), q.SearchArgs("zzz"), q.SearchArgs("?"),
], ids=str)
def test_search_equals_brute_force(index, args):
    rows = [(r.table_name, r.row_id, r.content_norm) for r in index.collect()]
    got = [(r.has_all, r.coverage, r.score, r.table_name, r.row_id) for r in q.search(index, args).collect()]
    assert sorted(got) == sorted(brute_force(rows, args))
    counts = q.search_counts(index, args).first()
    assert counts.returned_count == len(got)


def test_larger_brute_force(spark):
    words = ["red", "reed", "green", "gren", "blue", "bluish", "pump", "pumps", "valve"]
    rows = [(i, " ".join(p)) for i, p in enumerate(itertools.permutations(words, 3))]
    index = ix.build_index({"t": spark.createDataFrame(rows, "id INT, txt STRING")}).persist()
    args = q.SearchArgs("blue green pum", per_table=50)
    want = brute_force([(r.table_name, r.row_id, r.content_norm) for r in index.collect()], args)
    got = [(r.has_all, r.coverage, r.score, r.table_name, r.row_id) for r in q.search(index, args).collect()]
    assert got == want


def test_group_order_and_payload(index):
    args = q.SearchArgs("alpha", priority=("zeta",))
    rows = q.search(index, args).collect()
    assert [r.table_name for r in rows][0] == "zeta" and {r.table_rank for r in rows} == {1, 2}
    assert all(r.row_json for r in rows)
    flat = q.results_table(q.search(index, args), ["id", "descr"]).collect()
    assert {(r.table, r.id, r.descr) for r in flat} == {("alpha", "1", None), ("zeta", None, "alpha result"), ("zeta", None, "alpha omega")}


def test_equal_rows_keep_their_copies(spark):
    df = spark.createDataFrame([("same",)] * 3 + [("other same",)], "v STRING")
    index = ix.build_index({"t": df})
    assert len(q.search(index, q.SearchArgs("same")).collect()) == 4
    assert sorted(r.copies for r in q.search(ix.folded(index), q.SearchArgs("same")).collect()) == [1, 3]


def test_candidate_limit_prefers_priority_tables(index):
    args = q.SearchArgs("alpha", candidate_limit=1, priority=("zeta",))
    assert [r.table_name for r in q.search(index, args).collect()] == ["zeta"]


def test_scan_search(tables):
    found = q.scan_search(tables, q.SearchArgs("alpha", tables=("alpha",)))
    assert [r.row_json for r in found.collect()] == ['{"id":1,"name":"alpha unit"}']
    only_text = q.scan_search(tables, q.SearchArgs("9"), only_text=True)
    assert only_text.count() == 0 and q.scan_search(tables, q.SearchArgs("9")).count() == 1


def test_args():
    args = q.search_args({"q": " x ", "per_table": "5", "token_mode": "odd", "tables": "a, b,a,", "min_score": ""})
    assert (args.q, args.per_table, args.token_mode, args.tables, args.min_score, args.candidate_limit) == ("x", 5, "any", ("a", "b"), None, None)
    for bad in ({"q": " "}, {"q": "x", "per_table": 0}, {"q": "x", "per_table": 201}, {"q": "x", "total_limit": "z"},
                {"q": "x", "candidate_limit": 2001}, {"q": "x", "min_score": -1}, {"q": "x", "tables": ",".join(f"t{i}" for i in range(201))}):
        with pytest.raises(ValueError):
            q.search_args(bad)
    assert q.priority_tables(["a ", "", "b"]) == ("a", "b")
    with pytest.raises(ValueError):
        q.priority_tables(5)


def test_progress_and_resume(spark, tables, tmp_path):
    path = f"{tmp_path}/index"
    assert ix.read_index(spark, path) is None
    first = {"alpha": tables["alpha"].filter("id < 3")}
    ix.write_index(first, path)
    stored = ix.read_index(spark, path)
    assert [tuple(r) for r in ix.index_progress({"alpha": tables["alpha"]}, stored).collect()] == [("alpha", 4, 2, 2)]
    ix.write_index({"alpha": tables["alpha"].union(tables["alpha"].filter("id = 1"))}, path)
    stored = ix.read_index(spark, path)
    assert {r.table_name: r.indexed_rows for r in ix.index_statistics(stored).collect()} == {"alpha": 5}
    assert ix.index_progress({"alpha": tables["alpha"]}, stored).count() == 0
    ix.write_index(first, path, rebuild=True)
    assert ix.index_statistics(ix.read_index(spark, path)).first().indexed_rows == 2


def test_row_offsets(spark, tables):
    index = ix.index_rows("alpha", tables["alpha"]).selectExpr("*", "-CAST(pk_value AS INT) AS o")
    got = ix.with_row_offset(index.repartition(3), ["o"])
    assert {r.pk_value: r.row_offset for r in got.collect()} == {"4": 0, "3": 1, "2": 2, "1": 3}


def test_stream_keeps_all_copies(spark, tables, tmp_path):
    from snapscope.streaming.index_stream import BATCH_SCHEMA, follow_folder, stream_index

    folder, path, check = f"{tmp_path}/in", f"{tmp_path}/ix", f"{tmp_path}/cp"
    for batch in ("id < 3", "id >= 2"):
        tables["alpha"].filter(batch).coalesce(1).write.mode("append").parquet(folder)
        follow_folder(spark, folder, "al pha", "id INT, name STRING", path, check).awaitTermination(120)
    rows = spark.read.schema(BATCH_SCHEMA).parquet(path).collect()
    assert sorted((r.table_name, r.pk_value, r.batch) for r in rows) == [
        ("al pha", "1", 0), ("al pha", "2", 0), ("al pha", "2", 1), ("al pha", "3", 1), ("al pha", "4", 1)]
    index = stream_index(spark, path)
    assert sorted((r.pk_value, r.copies) for r in index.collect()) == [("1", 1), ("2", 2), ("3", 1), ("4", 1)]
    twice = tables["alpha"].union(tables["alpha"].filter("id = 2"))
    assert ix.index_progress({"al pha": twice}, index).count() == 0
    assert normalize_query("Ação") == "acao"


def random_texts(n, seed=4):
    import random

    r = random.Random(seed)
    words = ["red", "reed", "green", "gren", "blue", "pump", "pumps", "valve", "ação", "日本語訳", "x", "ab", "the", "there", "other"] + [f"unit{k}" for k in range(60)]
    return [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 60])))) for k in range(n)]


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    tables = {
        "one": spark.createDataFrame(random_texts(300), "id INT, txt STRING"),
        "two": spark.createDataFrame([(t,) for _, t in random_texts(200, 5)] * 2, "txt STRING"),
    }
    index = ix.build_index(tables)
    return pl.write_postings(index, str(tmp_path_factory.mktemp("postings")), part_rows=20), ix.folded(index).persist()


@pytest.mark.parametrize("args", [
    q.SearchArgs("unit7", per_table=5), q.SearchArgs("unit12 pump", token_mode="all"), q.SearchArgs("the gren", per_table=7), q.SearchArgs("ab"), q.SearchArgs("x unit5", token_mode="all"),
    q.SearchArgs("ção there ump", per_table=9, min_score=20), q.SearchArgs("本語訳"), q.SearchArgs("unit7 nothing", token_mode="all"), q.SearchArgs("zzz qqq"), q.SearchArgs(""),
    q.SearchArgs("other valve unit3", per_table=3, candidate_limit=40, priority=("two",), tables=("two", "one")), q.SearchArgs("red the", 4, min_score=55),
], ids=str)
def test_posting_lists_find_what_the_scan_finds(posted, args):
    index, rows = posted
    same = ["table_name", "rank", "score", "coverage", "has_all", "row_id", "copies"]
    got = sorted(tuple(r[c] for c in same) for r in q.search(index, args).collect())
    assert got == sorted(tuple(r[c] for c in same) for r in q.search(rows, args, stored=False).collect())
    if args.candidate_limit is None:
        every = [(r.table_name, r.row_id, r.content_norm) for r in rows.collect()]
        assert sorted((g[4], g[3], g[2], g[0], g[5]) for g in got) == sorted(brute_force(every, args))
    assert sorted(map(tuple, q.candidates(index, args).select("row_id").collect())) == sorted(map(tuple, q.candidates(rows, args).select("row_id").collect()))


def test_lookups_read_few_partitions_and_common_tokens_all_rows(posted):
    index, _ = posted
    keys = pl.candidate_keys(index, ["unit12"])
    assert keys is not None and 0 < keys.count() < 200 and index.parts > 10
    plan = pl.narrowed(index, ["unit12"])._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "EqualTo(gram" not in plan
    assert pl.candidate_keys(index, ["ab"]) is None and pl.candidate_keys(index, ["unit", "ab"]) is None
    assert pl.candidate_keys(replace(index, keys_sent=3), ["unit"]) is None
    assert pl.candidate_keys(index, ["unit12", "x"], "all") is not None


def test_bounds_hold_and_decide_most_rows(spark):
    from snapscope.functions.similarity import ratio_bounds, with_common_bounds, with_exact_ratio, with_token_set_ratio

    frame = spark.createDataFrame([(t,) for _, t in random_texts(400, 6)], "t STRING")
    for query in ("gren unit1", "the red widget ation", "日本 ação", "a b c", "pump", "it's b\\\\c", "w" * 70 + " there " + "v" * 20, ""):
        low, high = ratio_bounds()
        staged = with_common_bounds(frame, query.split(), "t")
        rows = with_exact_ratio(staged.withColumn("low", low).withColumn("high", high), query.split(), "ratio").collect()
        for r in rows:
            assert r.low <= r.ratio <= r.high and r.ratio == pytest.approx(ratio(query, r.t))
        whole = with_common_bounds(frame, query.split(), "t", whole_scores=True)
        assert whole.where("_rest_text IS NOT NULL").count() <= staged.where("_rest_text IS NOT NULL").count()
        assert [r.ratio for r in with_token_set_ratio(frame, query.split(), "t").collect()] == [r.ratio for r in rows]


@pytest.mark.parametrize("mode", ["any", "all"])
def test_a_scan_tells_from_the_columns_which_rows_it_forms_texts_of(spark, monkeypatch, mode):
    words = ["small ring", "SMALL", "sm-all", "smäll", "smáll riNg", "RİNG", "rıng", "ring 12", None, "", "x12y"]
    rows = [(i, w, v, None if i % 3 else 12.5 * i) for i, (w, v) in enumerate(itertools.product(words, ["ring", "elle", None, "Élle", "1-2"]))]
    df = spark.createDataFrame(rows * 2, "id INT, name STRING, other STRING, n DOUBLE")
    broken = spark.sql("SELECT 7 AS id, cast(X'736d616c6cff' AS STRING) AS name UNION ALL SELECT 8, cast(X'ff' AS STRING) UNION ALL SELECT 9, 'small'")
    for text, only_text in itertools.product(["small ring", "12", "smäll ring", "ell 12", "..."], [True, False]):
        args = q.SearchArgs(text, token_mode=mode, per_table=1000)
        found = q.scan_search({"t": df, "u": broken}, args, only_text)
        if text == "small ring":
            assert "octet_length" in found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(str, found.collect()))
        with monkeypatch.context() as m:
            m.setattr(q, "may_hold", lambda *a: None)
            assert got == sorted(map(str, q.scan_search({"t": df, "u": broken}, args, only_text).collect()))
