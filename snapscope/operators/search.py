"""Ranked text search over the row index, or straight over tables without one.

Rows are found by the posting lists of an index that has them, else by reading its texts. Scores are bounded first by
lengths, contained words and counts of signs. Over a stored index, the bounds give a score per table that its quota is
certain to reach, and only rows that can reach it are scored exactly. The best rows per table and then in total
are kept, and the stored rows fetched only for those few. The candidates' text never leaves the scoring stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapscope.functions.arguments import whole_number
from snapscope.functions.similarity import STAGED, ratio_bounds, with_common_bounds, with_exact_ratio
from snapscope.functions.text import normalize_query
from snapscope.operators.posting_lists import PostingIndex, narrowed
from snapscope.operators.text_index import build_index, may_hold
from snapscope.session import settled

# Bounds of the query arguments.
PER_TABLE_MAX, CANDIDATES_MAX, TOTAL_MAX, TABLES_MAX = 200, 2000, 5000, 200


@dataclass(frozen=True)
class SearchArgs:
    """`candidate_limit=None` ranks every matching row; a number cuts the candidates before scoring."""

    q: str
    per_table: int = 10
    candidate_limit: int | None = None
    total_limit: int = 500
    token_mode: str = "any"
    min_score: int | None = None
    tables: tuple[str, ...] | None = None
    priority: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        # The upper bounds of a request are checked by `search_args`; the engine takes any.
        whole_number(self.per_table, "per_table", 1)
        whole_number(self.total_limit, "total_limit", 1)

    @property
    def normalized(self) -> str:
        return normalize_query(self.q)

    @property
    def tokens(self) -> list[str]:
        return self.normalized.split()


def priority_tables(value: str | Sequence[str]) -> tuple[str, ...]:
    """From `a, b` or a list; blanks dropped, order kept."""
    if not isinstance(value, (str, list, tuple)):
        raise ValueError("tables must be a text or a list")
    parts = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    return tuple(p.strip() for p in parts if p.strip())


def search_args(raw: Mapping[str, object]) -> SearchArgs:
    """Check raw request values; an unknown token mode means `any`."""
    q = str(raw.get("q") or "").strip()
    if not q:
        raise ValueError("q is empty")
    limit, least = raw.get("candidate_limit"), raw.get("min_score")
    mode = str(raw.get("token_mode") or "any").lower()
    tables = None
    if raw.get("tables"):
        tables = tuple(dict.fromkeys(priority_tables(raw["tables"])))
        if len(tables) > TABLES_MAX:
            raise ValueError(f"at most {TABLES_MAX} tables can be named")
    return SearchArgs(
        q=q,
        per_table=whole_number(raw.get("per_table", 10), "per_table", 1, PER_TABLE_MAX),
        candidate_limit=None if limit in (None, "") else whole_number(limit, "candidate_limit", 1, CANDIDATES_MAX),
        total_limit=whole_number(raw.get("total_limit", 500), "total_limit", 1, TOTAL_MAX),
        token_mode=mode if mode in ("any", "all") else "any",
        min_score=None if least in (None, "") else whole_number(least, "min_score", 0),
        tables=tables,
        priority=priority_tables(raw.get("priority") or ()),
    )


def _contains(text: Column, tokens: Sequence[str]) -> list[Column]:
    return [text.contains(t) for t in tokens]


def _holds(tokens: Sequence[str], mode: str) -> Column:
    """Any or all tokens in the text. The text is bound once, so a text formed on the fly is formed once."""
    both = (lambda x, y: x | y) if mode == "any" else (lambda x, y: x & y)
    return F.exists(F.array("content_norm"), lambda text: reduce(both, _contains(text, tokens)))


def candidates(index: DataFrame | PostingIndex, args: SearchArgs) -> DataFrame:
    """Index rows that hold any (or all) of the tokens as substrings; without tokens, every row."""
    rows = narrowed(index, args.tokens, args.token_mode) if isinstance(index, PostingIndex) else index
    if args.tables:
        rows = rows.filter(F.col("table_name").isin(list(args.tables)))
    if args.tokens:
        rows = rows.filter(_holds(args.tokens, args.token_mode))
    if args.candidate_limit is not None:
        first = F.col("table_name").isin(list(args.priority)) if args.priority else F.lit(False)
        rows = rows.orderBy(first.desc(), "table_name", "row_id").limit(args.candidate_limit)
    return rows


def coverage(tokens: Sequence[str]) -> Column:
    """How many of the tokens the text holds."""
    return reduce(lambda x, y: x + y, [c.cast("int") for c in _contains(F.col("content_norm"), tokens)], F.lit(0))


_NEEDED = ["table_name", "pk_col", "pk_value", "row_id", "copies"]


def bounded(rows: DataFrame, args: SearchArgs, carry: Sequence[str] = ()) -> DataFrame:
    """Coverage, has_all and bounds of the score (`low`, `high`, whole numbers) per candidate; those below `min_score` for certain are
    dropped. What an exact score takes is staged beside them. `carry` names columns to keep."""
    tokens = args.tokens
    cover = coverage(tokens)
    has_all = F.when(cover == len(tokens), 1).otherwise(0) if tokens else F.lit(0)
    needed = [*_NEEDED, *carry]
    rows = rows.select(*needed, "content_norm", cover.alias("coverage"), has_all.alias("has_all"))
    rows = with_common_bounds(rows, tokens, "content_norm", whole_scores=True)
    low, high = ratio_bounds()
    rows = rows.select(*needed, "coverage", "has_all", low.cast("int").alias("low"), high.cast("int").alias("high"), *STAGED)
    return rows if args.min_score is None else rows.filter(F.col("high") >= args.min_score)


def exact(rows: DataFrame, args: SearchArgs) -> DataFrame:
    """The score of bounded rows; below `min_score` dropped."""
    rows = with_exact_ratio(rows, args.tokens, "score").drop(*STAGED, "low", "high").withColumn("score", F.col("score").cast("int"))
    return rows if args.min_score is None else rows.filter(F.col("score") >= args.min_score)


def scored(rows: DataFrame, args: SearchArgs, carry: Sequence[str] = ()) -> DataFrame:
    """Coverage, has_all and score (whole number) per candidate; below `min_score` dropped."""
    return exact(bounded(rows, args, carry), args)


def contenders(rows: DataFrame, args: SearchArgs, rank_by: str = "coverage") -> DataFrame:
    """The bounded rows that can enter their table's quota: `per_table` rows are certain to rank as high as their lower bounds
    say, and a row whose upper bound ranks below them all is out. One row per table is sent to the tasks."""

    def place(score: str) -> Column:
        return F.struct(*([] if rank_by == "score" else ["has_all", "coverage"]), F.col(score).alias("score"))

    certain = rows if args.min_score is None else rows.filter(F.col("low") >= args.min_score)
    # Places are few, however many rows share them.
    places = certain.groupBy("table_name", place("low").alias("place")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("table_name").orderBy(F.col("place").desc())
    reached = places.select("table_name", "place", F.sum("n").over(best).alias("so_far")).filter(F.col("so_far") >= args.per_table)
    least = reached.groupBy("table_name").agg(F.max("place").alias("least"))
    met = rows.join(F.broadcast(least), "table_name", "left")
    return met.filter(F.col("least").isNull() | (place("high") >= F.col("least"))).drop("least")


def _rank(by: str) -> list[Column]:
    best = [F.col("score").desc()] if by == "score" else [F.col(c).desc() for c in ("has_all", "coverage", "score")]
    return best + [F.col("table_name").asc(), F.col("row_id").asc()]


def within_quota(rows: DataFrame, args: SearchArgs, rank_by: str = "coverage") -> DataFrame:
    """At most `per_table` rows per table, then at most `total_limit`, best first.

    The per-table limit is applied inside every task before rows are shuffled by table, so a table
    with most of the hits is no bottleneck.
    """
    per_table = Window.partitionBy("table_name").orderBy(*_rank(rank_by))
    kept = rows.withColumn("rank_in_table", F.row_number().over(per_table)).filter(
        F.col("rank_in_table") <= args.per_table
    )
    return kept.orderBy(*_rank(rank_by)).limit(args.total_limit)


def with_payload(chosen: DataFrame, index: DataFrame | PostingIndex, limit: int) -> DataFrame:
    """Add the stored row. `chosen` has at most `limit` rows: up to TOTAL_MAX they are sent to the index partitions,
    more are joined by shuffle. Of an index with posting lists only the partitions of the chosen keys are opened.

    Equal rows share their id; each chosen place keeps one stored row.
    """
    side = F.broadcast(chosen) if limit <= TOTAL_MAX else chosen
    # The number of a stored row tells it, so that no id is formed of others.
    keys = ["part", "row_key"] if isinstance(index, PostingIndex) else ["table_name", "row_id"]
    rows = index.rows if isinstance(index, PostingIndex) else index
    return rows.select(*keys, "row_json").join(side, keys).dropDuplicates(["table_name", "rank_in_table"])


def grouped_order(chosen: DataFrame, args: SearchArgs) -> DataFrame:
    """Tables in output order (`table_rank`): priority tables as given, then by best score.

    The total limit bounds `chosen`, so ranking it in one place is fine.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in args.priority]).cast("array<string>"), F.col("table_name"))
    best = F.max("score").over(Window.partitionBy("table_name"))
    ranked = chosen.withColumn("best", best).withColumn(
        "place", F.when(place > 0, place).otherwise(F.lit(len(args.priority) + 1))
    )
    by_table = Window.orderBy("place", F.col("best").desc(), "table_name")
    return ranked.select(
        F.dense_rank().over(by_table).alias("table_rank"),
        "table_name", F.col("rank_in_table").alias("rank"), "score", "coverage", "has_all", "pk_col", "pk_value",
        "row_id", "copies", *(["row_json"] if "row_json" in chosen.columns else []),
    ).orderBy("table_rank", "rank")


def search(
    index: DataFrame | PostingIndex, args: SearchArgs, payload: bool = True, rank_by: str = "coverage", stored: bool = True
) -> DataFrame:
    """Ranked rows: table_rank, table_name, rank, score, coverage, has_all, pk, row_id, copies, row_json.

    Over a stored index the candidates are read for the quotas' least scores and again for the rows that can reach these, so
    that none is kept on disk (only where a limit bounds them they are stored in turn); the row itself is fetched in a narrow read. An index
    formed on the fly (`stored=False`) is read once: its open rows are all scored, and the row is carried along and cut down by the quotas.
    """
    keys = ["part", "row_key"] if isinstance(index, PostingIndex) else []
    carry = ["row_json"] if payload and not stored else keys
    rows = bounded(candidates(index, args), args, carry)
    if stored:
        rows = contenders(rows if args.candidate_limit is None else settled(rows), args, rank_by)
    chosen = within_quota(exact(rows, args), args, rank_by)
    if payload and stored:
        chosen = with_payload(chosen, index, args.total_limit)
    return grouped_order(chosen, args)


def search_counts(index: DataFrame | PostingIndex, args: SearchArgs) -> DataFrame:
    """One row: query, normalised query, candidates (after `min_score`) and returned rows."""
    per_table = scored(candidates(index, args), args).groupBy("table_name").agg(F.count("*").alias("n"))
    within = F.coalesce(F.sum(F.least("n", F.lit(args.per_table))), F.lit(0))
    return per_table.agg(
        F.lit(args.q).alias("q"),
        F.lit(args.normalized).alias("q_norm"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_count"),
        F.least(within, F.lit(args.total_limit)).cast("bigint").alias("returned_count"),
    )


def text_columns(df: DataFrame) -> list[str]:
    """String columns, or all columns when there are none."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]
    return texts or df.columns


def scan_search(
    tables: Mapping[str, DataFrame], args: SearchArgs, only_text: bool = False, rank_by: str = "score"
) -> DataFrame:
    """Search without an index: the index rows are formed on the fly and only matching ones go on. Rows whose columns can't hold
    the tokens are left out before their text is formed.

    A token holds no blank, so it is in some column exactly when it is in the joined text. With
    `only_text` only string columns are searched; the key is then `id` or the first column.
    """
    wanted = {n: df for n, df in tables.items() if not args.tables or n in args.tables}
    strategy = "id_or_first" if only_text else "id_or_suffix"
    searched = {n: text_columns(df) for n, df in wanted.items()} if only_text else None
    for name, df in wanted.items():
        likely = may_hold(df, args.tokens, args.token_mode, searched and searched[name])
        wanted[name] = df if likely is None else df.filter(likely)
    index = build_index(wanted, strategy, searched)
    return search(index, replace(args, tables=None), rank_by=rank_by, stored=False)


def results_table(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flat export: `table`, `score` and the named fields of the stored rows; absent fields are NULL."""
    fields = F.from_json("row_json", "map<string,string>")
    return found.withColumn("fields", fields).select(
        F.col("table_name").alias("table"), "score", *[F.col("fields").getItem(c).alias(c) for c in columns]
    )


def result_columns(tables: Mapping[str, DataFrame], found_tables: Sequence[str]) -> list[str]:
    """Union of the columns of the tables that were hit, in first-seen order."""
    return list(dict.fromkeys(c for t in found_tables for c in tables[t].columns))
