"""URL filter: explicit host and path rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame work. The model is a vector of BUCKETS + 1 weights: it is fitted by full-batch gradient
steps, each one aggregation over the labelled table, and scoring looks the weights up inside one expression.

Defined results: a null URL or one without `://` has an empty host and path, no rule, and the verdict its score
gives (with no n-grams: that of the intercept). Repeated rows and ids are judged row by row. Without labelled rows
of both classes the model allows everything.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapscope.llm.common import ascii_lower, stored

BUCKETS = 4096
GRAMS = (3, 4)
# Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 4000
STEPS = 40
RATE, L2 = 1.5, 1e-4

Rules = list[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: its host or a subdomain, its path a prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Distinct buckets of the n-grams of host and path, each with its own marks at the ends; a number counts as 0."""

    def of(mark: str, text: Column) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        cut = [
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))),
                lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substring(marked, i, F.lit(n))), F.lit(buckets)).cast("int"),
            )
            for n in sizes
        ]
        return F.concat(*cut)

    return F.array_distinct(F.concat(of("h", host), of("p", F.regexp_replace(path, "[0-9]+", "0"))))


def _weights(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _score(buckets: Column, weights: Column) -> Column:
    """Probability of block: the mean weight of the n-grams on the logistic scale, and the intercept last."""
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return 1 / (1 + F.exp(-(F.get(weights, F.lit(-1) + F.size(weights)) + total / F.sqrt(F.size(buckets).cast("double")))))


def fit(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> list[float]:
    """Weights from (url, label: 1 block, 0 allow). At most MAX_LABELLED rows, those of smallest URL hash."""
    few = stored(
        labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
        .distinct().orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
        .select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("buckets")),
        "labelled-urls",
    )
    n, blocked = few.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, n):
        return [0.0] * BUCKETS + [-1.0]
    weights, spread = [0.0] * BUCKETS + [math.log(blocked / (n - blocked))], [1e-12] * (BUCKETS + 1)
    for _ in range(steps):
        miss = few.select("buckets", (_score(F.col("buckets"), _weights(weights)) - F.col("label")).alias("miss"))
        slopes = (
            miss.select(F.explode(F.concat("buckets", F.array(F.lit(BUCKETS)))).alias("bucket"), "miss", F.size("buckets").alias("size"))
            .groupBy("bucket")
            .agg(F.sum(F.when(F.col("bucket") == BUCKETS, F.col("miss")).otherwise(F.col("miss") / F.sqrt("size"))).alias("slope"))
        )
        for row in slopes.collect():  # at most BUCKETS + 1 rows
            k = row["bucket"]
            slope = row["slope"] / n + l2 * weights[k] * (k < BUCKETS)
            spread[k] += slope * slope  # a step for each weight by its own slopes, so that rare n-grams learn too
            weights[k] -= rate * slope / math.sqrt(spread[k])
    return weights


def filter_urls(pages: DataFrame, rules: Rules, weights: list[float], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, decision = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select(
        "page_id", "host", "path", name.alias("rule"), decision.alias("decision"),
        _score(grams(F.col("host"), F.col("path")), _weights(weights)).alias("score"),
    ).select(
        "page_id", "host", "path", "rule",
        F.coalesce("decision", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )


# The small labelled table that the model is fitted on unless another is given: names of hosts people block, and of
# hosts they don't. Addresses are made from them in the same forms for both, so that only the names tell.
BLOCKED_HOSTS = """
casino-royal online-casino casino-bonus mega-casino slots-jackpot poker-win win-big lottery-win free-spins bets-live sport-bets free-credits
cheap-meds pills-shop viagra-store cheap-watches replica-bags diet-pills free-iphone win-prizes adult-dating adult-video hot-x xxx-tube porn-site cam-girls
bets-free free-poker bestbets free-bingo bets24 freebets casino-vip ads-tracking ads-server ads-network adclick track-pixel tracker click-track banner-ads spam-mail spamhub link-farm farm-links seo-farm quick-loans payday-loan crypto-double
""".split()
ALLOWED_HOSTS = """
news daily-news weather city-library library museum garden gardening-club recipes home-cooking school high-school university science open-science history
travel mountain-trails cycling running football chess music orchestra theatre film-review books book-review poetry paintings photography architecture
health hospital dentist nursing childcare parents farmers-market farming agriculture forest birds ocean river climate energy solar engineering robotics
software linux databases compilers mathematics physics chemistry biology astronomy economy finance banking insurance law courts parliament townhall
river-side city-guide school-board house-paint bread-recipe sea-shore
thermal throne other another nation station thunder winter shelter brother gather anthem ethan athens theory
""".split()


def labelled_urls(spark: SparkSession, blocked: list[str] = BLOCKED_HOSTS, allowed: list[str] = ALLOWED_HOSTS) -> DataFrame:
    """(url, label) of the names above, each under several addresses."""
    fronts, ends, languages, tails = ("", "www.", "blog.", "m."), ("com", "org", "net"), ("en", "fr", "de", "es"), ("", ".html", "/", "?page=2")
    rows = [
        {"url": f"https://{fronts[(k + v) % 4]}{name}.example.{ends[(k + v) % 3]}/{languages[(k // 3 + v) % 4]}/{17 * k + v}{tails[(k // 2 + v) % 4]}", "label": label}
        for label, names in ((1, blocked), (0, allowed)) for k, name in enumerate(names) for v in range(3)
    ]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, label: int>>")))
